"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced completely with the ``noop`` sink (every row computed, none
collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from dqspark.operators import dedup  # noqa: E402
from dqspark.plans.queries import QUERIES  # noqa: E402
from dqspark.session import local_session  # noqa: E402
from dqspark.sources.tables import table  # noqa: E402

HEADLINE = ["profile_columns", "profile_table", "exact_dedup", "top_values", "value_frequency",
            "fuzzy_pairs", "fuzzy_dedup", "fuzzy_dedup_customers", "repair_full", "repair_numeric", "sanitise",
            "quality_index", "run_history", "anomaly_flags", "clean_part", "file_checksum"]


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), extra={"spark.driver.memory": "16g"})
    times: dict[str, float] = {}
    # warm-up: JVM, Python workers, file listing
    force(table(spark, sf_dir, "region").select(F.col("r_name")))
    for name in names:
        fn = QUERIES[name][0]
        t0 = time.time()
        force(fn(spark, sf_dir))
        times[name] = round(time.time() - t0, 3)
    fuzzy = {}
    for label, tab, col, thr, cap in [("part.p_name@85", "part", "p_name", 85, 2000),
                                      ("documents.text@85", "documents", "text", 85, 2000)]:
        if os.environ.get("BENCH_SKIP_FUZZY_STATS"):
            break
        t0 = time.time()
        r = dedup.fuzzy_dedup(table(spark, sf_dir, tab), col, thr, cap)
        force(r.table)
        sec = round(time.time() - t0, 3)
        times[f"fuzzy_{tab}"] = sec
        fuzzy[label] = {"values": r.values, "all_pairs": r.values * (r.values - 1) // 2,
                        "candidate_generator": r.strategy, "candidate_pairs": r.candidates,
                        "candidate_count_exact": r.strategy == "prefix",   # band: counted upper bound
                        "pairs_matched": r.pairs, "survivor_rounds": r.rounds,
                        "rows_removed": r.removed, "sec": sec}
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "fuzzy": fuzzy}))


if __name__ == "__main__":
    main()
