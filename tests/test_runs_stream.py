import os
import time
from datetime import datetime

from conftest import SAMPLE_CSV
from pyspark.sql import functions as F

from dqspark.plans.jobs import register_upload, run_job
from dqspark.plans.runs import RunStore
from dqspark.streaming.ingest import ingest_landing


def test_job_records_and_history(spark, tmp_path, sample_csv):
    store = RunStore(spark, str(tmp_path / "store"))
    meta = register_upload(spark, store, sample_csv, "job1")
    assert meta["rows"] == 15 and len(meta["preview"]) == 5 and len(meta["input_checksum"]) == 12
    res = run_job(spark, store, sample_csv, "job1", "name", 85)
    assert res["status"] == "complete"
    bad = tmp_path / "bad.csv"
    bad.write_text("")
    register = None
    try:
        register = register_upload(spark, store, str(bad), "job2")
    except Exception:  # noqa: BLE001 - an unreadable upload is refused
        pass
    res2 = run_job(spark, store, str(bad), "job3", "name", 85)
    assert res2["status"] == "error"
    # a stored output without a run record (legacy)
    legacy = tmp_path / "store" / "outputs" / "old42_clean.csv"
    os.makedirs(legacy)
    (legacy / "part-0.csv").write_text("a\n1\n2\n")
    hollow = tmp_path / "store" / "outputs" / "none 7_clean.csv"
    os.makedirs(hollow)
    (hollow / "part-0.csv").write_text("a\n")
    hist = {r.job_id: r for r in store.history().collect()}
    assert hist["job1"].status == "complete" and hist["job1"].clean_records == 12
    assert hist["job3"].status == "error"
    assert hist["old42"].clean_records == 2 and hist["old42"].status == "complete"
    assert hist["none 7"].clean_records == 0 and hist["none 7"].status == "complete"
    c = store.counters().first()
    assert c.active_jobs == 0 and c.total_jobs == 2
    assert register is None or register["rows"] == 0


def test_landing_stream_processes_each_file_once(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    store_root, ckpt = str(tmp_path / "store"), str(tmp_path / "ckpt")
    (landing / "a.csv").write_text(SAMPLE_CSV)
    q = ingest_landing(spark, str(landing), store_root, ckpt)
    q.awaitTermination(300)
    (landing / "b.csv").write_text(SAMPLE_CSV.replace("Alice", "Alicia"))
    (landing / "notes.txt").write_text("ignored")
    q = ingest_landing(spark, str(landing), store_root, ckpt)
    q.awaitTermination(300)
    q = ingest_landing(spark, str(landing), store_root, ckpt)     # nothing new
    q.awaitTermination(300)
    latest = RunStore(spark, store_root).latest().collect()
    assert sorted(r.filename for r in latest) == ["a.csv", "b.csv"]
    assert all(r.status == "complete" and r.clean_records == 12 for r in latest)
    # a lost commit replays batches: the same files keep their job ids, so no new jobs appear
    q = ingest_landing(spark, str(landing), store_root, str(tmp_path / "ckpt_fresh"))
    q.awaitTermination(300)
    again = RunStore(spark, store_root).latest().collect()
    assert sorted(r.job_id for r in again) == sorted(r.job_id for r in latest)
    assert all(r.status == "complete" and r.clean_records == 12 for r in again)


def test_bad_file_is_reported_and_the_next_one_done(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    store_root = str(tmp_path / "store")
    (landing / "a_bad.csv").write_text("name,n\nx,1\ny,,3\n")
    (landing / "b_good.csv").write_text("name,n\nx,1\ny,2\n")
    for ckpt in ("ckpt", "ckpt", "ckpt_fresh"):                 # a restart, and a replay of all batches
        ingest_landing(spark, str(landing), store_root, str(tmp_path / ckpt), files_per_batch=2).awaitTermination(300)
        store = RunStore(spark, store_root)
        latest = {r.filename: r for r in store.latest().collect()}
        assert latest["a_bad.csv"].status == "error" and "more fields" in latest["a_bad.csv"].error
        assert latest["b_good.csv"].status == "complete" and latest["b_good.csv"].clean_records == 2
        assert len(latest) == store.ledger().count() == 2
        assert all(len(r.job_id) == 32 for r in latest.values())
        assert store.runs().count() == 4                        # nothing added by the replay


def test_empty_store_reads_empty(spark, tmp_path):
    # nothing written yet: every view is empty, no local-disk checks involved
    store = RunStore(spark, str(tmp_path / "never_written"))
    assert store.runs().count() == 0 and store.latest().count() == 0
    assert store.outputs().count() == 0 and store.history().count() == 0
    c = store.counters().first()
    assert c.active_jobs == 0 and c.total_jobs == 0


def _state(store, name="runs"):
    return sorted(map(str, store._read(name).collect()))


def test_compaction_shows_old_or_new_never_both(spark, tmp_path, monkeypatch):
    store = RunStore(spark, str(tmp_path / "store"))
    for i in range(6):
        store.record(f"j{i % 3}", ["uploaded", "complete"][i // 3], rows=i)
    old = spark.createDataFrame([("k1", "a", "b", datetime(2020, 1, 1 + i % 2)) for i in range(5)], "run_id string, key string, value string, ts timestamp")
    store.append("params", old, F.col("ts"))
    store.log_params("r", {"p": 1, "q": None})
    before = _state(store), _state(store, "params"), _state(store, "metrics")
    assert store.compact("runs") == 0 and store.compact("metrics") == 0          # today is not over
    assert store.compact("runs", before="9999-12-31") == 1
    assert store.compact("params") == 2                                          # the two old days
    assert store.compact("params") == 0 and store.compact("runs", before="9999-12-31") == 0
    assert (_state(store), _state(store, "params"), _state(store, "metrics")) == before
    # rows after a merge: seen only once the period is merged again, so nothing is counted twice
    store.append("params", old.limit(1), F.col("ts"))
    assert store.compact("params") == 1
    assert len(_state(store, "params")) == len(before[1]) + 1
    # a merge that stops before its manifest row changes nothing
    store.append("params", old.select("run_id", "key", "value", F.lit(datetime(2020, 5, 5)).alias("ts")), F.col("ts"))
    seen = _state(store, "params")
    (tmp_path / "store" / "compact" / "params" / "run=stopped" / "period=2020-05-05").mkdir(parents=True)
    spark.read.parquet(f"{store.root}/log/params/period=2020-05-05").write.mode("append").parquet(
        f"{store.root}/compact/params/run=stopped/period=2020-05-05")
    assert _state(store, "params") == seen
