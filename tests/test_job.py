import os

from dqspark.plans.cleaning import clean_table, run_tracked


def test_people_golden(spark, people):
    r = clean_table(spark, people, "code", 85)
    assert r.raw_count == 39 and r.exact_removed == 9 and r.fuzzy_removed == 5 and r.clean_count == 25
    assert r.total_repairs == 6                                # towns of the ids 2, 6, 10, 14, 18, 22
    assert [(x.column, x.type, x["count"]) for x in r.repair_log.collect()] == [("town", "null_filled_text", 6)]
    assert r.anomaly_count == 3                                # ceil(0.1 * 24)
    # 25 of 39 rows left; distinct shares 25/25 ids, 25/25 codes, 20/25 towns, 5/25 shares, 2/25 flags
    assert r.cqi["completeness"] == 100.0 and r.cqi["uniqueness"] == 64.1 and r.cqi["accuracy"] == 88.0
    # the near copies of the ids 6 and 106 miss their towns too, and so do 18's equal row and 6's
    assert r.profile_table["total_nulls"] == 9
    assert r.clean_count <= r.raw_count


def test_chosen_columns_replace_those_found_by_name(spark):
    rows = [(f"n{i}", 900 + i, f"m{i}", float(i % 3)) for i in range(12)]
    df = spark.createDataFrame(rows, "name string, years long, contact string, x double")
    plain = clean_table(spark, df, "name", 100)
    assert plain.total_repairs == 0
    chosen = clean_table(spark, df, "name", 100, age_columns=["years"], email_columns=["contact"], feature_cols=["x"])
    assert {(x.column, x.type, x["count"]) for x in chosen.repair_log.collect()} == {
        ("years", "invalid_age_fixed", 12), ("contact", "invalid_email_flagged", 12)}


def test_csv_options_reach_the_reader(spark, tmp_path):
    p = tmp_path / "latin.csv"
    p.write_bytes("name,n\ncafé,1\nthé,2\n".encode("latin-1"))
    r = clean_table(spark, str(p), "name", 85, encoding="ISO-8859-1", multiline=False)
    assert {x.name for x in r.table.collect()} == {"café", "thé"}


def test_sample_golden(spark, sample_csv):
    r = clean_table(spark, sample_csv, "name", 85)
    assert r.raw_count == 15 and r.exact_removed == 0 and r.fuzzy_removed == 3 and r.clean_count == 12
    assert r.total_repairs == 6
    assert r.anomaly_count == 2
    assert r.cqi == {"completeness": 97.6, "uniqueness": 80.0, "validity": 83.3,
                     "consistency": 77.4, "accuracy": 83.3, "cqi_score": 84.33}
    assert r.profile_table == {"total_records": 15, "total_columns": 6, "total_nulls": 2, "null_rate": 2.22}
    assert [m.duplicate for m in r.fuzzy_matches.orderBy("rank_i").collect()] == \
        ["Charlie Brownn", "Frank Castlle", "Henry Forde"]
    assert r.preview().count() == 12


def test_tracked_run_writes_reports(spark, sample_csv, tmp_path):
    out = str(tmp_path / "run")
    r = run_tracked(spark, sample_csv, out, "run1", "name", 85)
    for name in ("profile_report", "fuzzy_matches", "repair_log", "cqi_report", "clean.csv", "anomaly_model"):
        assert os.path.isdir(os.path.join(out, name)), name
    from dqspark.plans.runs import RunStore
    store = RunStore(spark, f"{out}/runs")
    m = {x.key: x.value for x in store.metrics().collect()}
    assert m["clean_count"] == 12 and m["fuzzy_duplicates_removed"] == 3 and m["cqi_score"] == r.cqi["cqi_score"]
    p = {x.key: x.value for x in store.params().collect()}
    assert p["fuzzy_col"] == "name" and p["threshold_band"] == "Balanced"
    from dqspark.operators.anomaly import load_forest
    f = load_forest(spark, os.path.join(out, "anomaly_model"))
    assert len(f.trees) == 100
