import math

import numpy as np

from pyspark.sql import functions as F

from dqspark.operators import anomaly
from dqspark.operators.anomaly import detect_anomalies


def test_outlier_flagged(spark):
    df = spark.createDataFrame([(v,) for v in [10, 11, 12, 10, 11, 100, 9, 10, 11, 12]], "value long")
    out, n = detect_anomalies(df)
    assert n == 1 and [r.value for r in out.where("anomaly_flag = 'Anomaly'").collect()] == [100]


def test_small_table_all_normal(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "value long")
    out, n = detect_anomalies(df)
    assert n == 0 and {r.anomaly_flag for r in out.collect()} == {"Normal"}


def test_no_numeric_column(spark):
    df = spark.createDataFrame([(str(i),) for i in range(10)], "s string")
    out, n = detect_anomalies(df)
    assert n == 0 and "anomaly_flag" in out.columns


def test_count_rule_and_layout_independence(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    n_rows = li.count()
    a, n1 = detect_anomalies(li.repartition(3))
    b, n2 = detect_anomalies(li.repartition(11))
    assert n1 == n2 == math.ceil(0.1 * (n_rows - 1))
    # whole rows with their flag, as multisets (keys are not unique in this table)
    fa = sorted(tuple(r) for r in a.collect())
    fb = sorted(tuple(r) for r in b.collect())
    assert fa == fb


def test_repeated_row_is_sampled_by_its_share(spark):
    from dqspark.operators.anomaly import _draws, fit_forest
    shares = []
    for value in (3.0, 17.0, 250.0, 9999.0):
        rows = spark.range(6000).selectExpr(f"IF(id % 3 = 0, {value}, id * 1.0) AS v")
        forest, psi = fit_forest(rows, ["v"], n_trees=10)
        assert psi == 256 and forest.select("tree").distinct().count() == 10
        counted = rows.groupBy(F.col("v").alias("d1")).agg(F.count(F.lit(1)).alias("m")).withColumn("d2", F.lit(0))
        drawn = _draws(counted, 42).orderBy("u").limit(1200)
        shares.append(drawn.where(F.col("d1") == value).count() / 1200)
    assert all(0.28 < x < 0.39 for x in shares), shares


def test_many_copies_are_dealt_in_chunks(spark, monkeypatch):
    from dqspark.operators import anomaly
    monkeypatch.setattr(anomaly, "CHUNK", 100)
    counted = spark.createDataFrame([(1, 1, 1), (2, 2, 100), (3, 3, 101), (4, 4, 1234)], "d1 long, d2 long, m long")
    rows = anomaly._draws(counted, 1)
    assert {r.d1: (r["count"], r.ks) for r in rows.groupBy("d1").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("k").alias("ks")).collect()} \
        == {1: (1, 1), 2: (100, 100), 3: (101, 101), 4: (1234, 1234)}
    assert rows.select("u").distinct().count() == rows.count()


def test_native_scores_equal_the_numpy_walk(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), int(b), None if i % 9 else float("inf")) for i, (a, b) in enumerate(zip(rng.normal(size=400), rng.integers(0, 5, 400)))]
    df = spark.createDataFrame(rows, "a double, b int, c double")
    cols = ["a", "b", "c"]
    fdf, psi = anomaly.fit_forest(df, cols, n_trees=20)
    forest = anomaly.Forest(fdf, psi)
    both = df.select(anomaly.score_column(forest, cols).alias("s"), anomaly.score_native(forest, cols).alias("t"))
    assert "Python" not in df.select(anomaly.score_native(forest, cols))._jdf.queryExecution().executedPlan().toString()
    assert all(abs(r.s - r.t) < 1e-12 for r in both.collect())


def test_native_score_is_compiled_conditions(spark):
    # conditions that Spark compiles, over features made once a row; missing and infinite values as 0
    rows = [(float(i % 7), i, None if i % 9 else float("inf")) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b int, c double")
    forest = anomaly.Forest(*anomaly.fit_forest(df, ["a", "b", "c"], n_trees=20))
    both = anomaly.with_native_score(df.withColumn("s", anomaly.score_column(forest, ["a", "b", "c"])), forest, ["a", "b", "c"], "t")
    assert both.columns == ["a", "b", "c", "s", "t"]
    plan = both.select("t")._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and not any(line.lstrip(" :+-").startswith("*") and "lambda" in line for line in plan.splitlines())
    assert all(abs(r.s - r.t) < 1e-12 for r in both.collect())


def test_block_walk_equals_a_plain_walk_of_each_row(spark, monkeypatch):
    # blocks smaller than the batch, values on the splits, trees of several depths
    monkeypatch.setattr(anomaly.Forest, "BLOCK", 7)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(rng.normal(size=300), rng.integers(0, 4, 300))], "a double, b int")
    fdf, psi = anomaly.fit_forest(df, ["a", "b"], n_trees=12, max_samples=40)
    forest = anomaly.Forest(fdf, psi)
    x = np.concatenate([rng.normal(size=(40, 2)), [[t, t] for f, t, *_ in [tree[:2] for tree in forest.trees] for t in t[f >= 0][:3]]])
    for feat, split, left, right, leaf in forest.trees:
        assert len(feat) == len(leaf)
    want = []
    for row in x:
        total = 0.0
        for feat, split, left, right, leaf in forest.trees:
            k = 0
            while feat[k] >= 0:
                k = left[k] if row[feat[k]] <= split[k] else right[k]
            total += leaf[k]
        want.append(total / len(forest.trees))
    assert forest.path_lengths(x).tolist() == want
    assert all((first[feat_of >= 0] + 1 < len(first)).all() for feat_of, (_, _, first, _, _) in
               ((np.where(np.isinf(w[1]), -1, w[0]), w) for w in forest.walks))
