from dqspark.operators.quality import quality_index


def test_score_formula_on_ten_rows(spark):
    # the stored 10-row result: 7 columns, 2 nulls, 1 anomaly, distinct 10 10 8 9 10 10 2
    rows = []
    for i in range(10):
        rows.append((i, f"n{i}", f"e{min(i, 8)}" if i != 3 else None, 20 + i if i != 4 else None, f"c{i}",
                     1000 + i, "Anomaly" if i == 0 else "Normal"))
    df = spark.createDataFrame(rows, "id long, name string, email string, age long, city string, "
                                     "salary long, anomaly_flag string")
    r = quality_index(df, raw_count=15).first()
    assert (r.completeness, r.uniqueness, r.validity, r.consistency, r.accuracy) == (97.1, 66.7, 90.0, 84.3, 90.0)
    assert r.cqi_score == 85.62


def test_score_range(spark, people):
    r = quality_index(people, raw_count=39, anomaly_count=0).first()
    assert 0 <= r.cqi_score <= 100
    assert set(r.asDict()) == {"completeness", "uniqueness", "validity", "consistency", "accuracy", "cqi_score"}


def test_sanitize_nested(spark):
    from dqspark.functions.scalar import sanitize
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame(
        [(1, [1.0, inf, nan, None], {"a": -inf, "b": 2.0}, (nan, "x", [inf, 3.0]), 4.0),
         (2, None, None, None, nan)],
        "id int, xs array<double>, m map<string,double>, s struct<f:double,t:string,ys:array<double>>, d double")
    out = {r.id: r for r in sanitize(df).collect()}
    assert out[1].xs == [1.0, None, None, None]
    assert out[1].m == {"a": None, "b": 2.0}
    assert out[1].s.f is None and out[1].s.t == "x" and out[1].s.ys == [None, 3.0]
    assert out[1].d == 4.0
    assert out[2].xs is None and out[2].m is None and out[2].s is None and out[2].d is None
    assert sanitize(df).schema == df.schema
