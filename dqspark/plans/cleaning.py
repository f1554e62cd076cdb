"""The full job (K8) and the tracked run (K9).

profile(raw) -> exact dedup -> near-duplicate dedup on ``match_col`` -> repair ->
anomaly flags -> quality index. Every stage is a DataFrame function; the job
only decides where to cut lineage:

* after parsing a CSV path: the profile and the exact dedup read its columns several times;
* after exact dedup: its shuffle output feeds counts, ranking and the anti join;
* after scoring (inside ``detect_anomalies``): the scored table feeds the cut, the
  flags, the quality aggregate, the preview and the sink, so the forest scores
  each row once. Row counts after the first cut are derived, not counted.

Cuts write Parquet (or ``checkpoint()``, for small tables) into the session's checkpoint
folder, so a lost executor re-runs at most the stage after the last cut.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.functions.scalar import default_match_column, sanitize, threshold_band
from dqspark.operators import anomaly, dedup, profile, quality, repair
from dqspark.session import ensure_checkpoint_dir, staged
from dqspark.sources import csv as csv_source
from dqspark.sources import sinks

PREVIEW_ROWS = 50        # T4
UPLOAD_PREVIEW_ROWS = 5  # T5


@dataclass
class CleanResult:
    profile_table: dict
    profile_columns: list[dict]
    exact_removed: int
    fuzzy_removed: int
    fuzzy_matches: DataFrame          # all matches; ``first_matches`` shows the first ones
    total_repairs: int
    repair_log: DataFrame
    anomaly_count: int
    cqi: dict
    raw_count: int
    clean_count: int
    table: DataFrame                  # full clean table with anomaly_flag
    columns: list[str]
    stats: dict = field(default_factory=dict)

    def preview(self, n: int = PREVIEW_ROWS, order_by: list[str] | None = None) -> DataFrame:
        """T4 + C1: first rows, NaN/inf as null; in the order of ``order_by`` (else as the scan gives them)."""
        return first_rows(self.table, n, order_by)

    def first_matches(self, n: int = dedup.MATCHES_SHOWN) -> DataFrame:
        """The first ``n`` matches, for display."""
        return self.fuzzy_matches.orderBy("rank_i", "rank_j").limit(n)

    def issues(self, spark: SparkSession) -> DataFrame:
        return quality.issue_summary(spark, self.exact_removed, self.fuzzy_removed, self.total_repairs,
                                     self.anomaly_count, self.raw_count, self.clean_count)


def first_rows(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, NaN/inf as null (ordered: a bounded top ``n`` of each task)."""
    shown = sanitize(df)
    return (shown.orderBy(*[F.col(f"`{c}`") for c in order_by]) if order_by else shown).limit(n)


def load(spark: SparkSession, source: DataFrame | str, encoding: str | None = None, multiline: bool = True,
         schema: T.StructType | None = None) -> DataFrame:
    return csv_source.read_csv(spark, source, encoding, multiline, schema) if isinstance(source, str) else source


def clean_table(spark: SparkSession, source: DataFrame | str, match_col: str | None = "name",
                threshold: float = dedup.DEFAULT_THRESHOLD,
                max_values: int | None = dedup.DEFAULT_MAX_VALUES,
                approx: bool = False, age_columns: list[str] | None = None,
                email_columns: list[str] | None = None, feature_cols: list[str] | None = None,
                order_col: str | None = None, **csv_options) -> CleanResult:
    """K8: the seven stages on a table or a CSV path. ``order_col`` ranks equally frequent match values
    by where they are first seen.

    ``age_columns``, ``email_columns`` and ``feature_cols`` replace the choice by name and
    type; ``csv_options`` are ``encoding``, ``multiline`` and ``schema`` of a CSV path.
    """
    ensure_checkpoint_dir(spark)
    t0 = time.time()
    raw = load(spark, source, **csv_options)
    parsed = isinstance(source, str)
    if parsed:                                          # CSV text is parsed once
        raw = staged(raw, "raw")
    if match_col is None:
        match_col = default_match_column(raw.columns)   # P4

    ptab, pcols = profile.profile(raw, approx, rescan=parsed)
    ptab_row = ptab.first().asDict()
    pcols_rows = [r.asDict() for r in pcols.orderBy("position").collect()]
    raw_count = int(ptab_row["total_records"])

    deduped, exact_removed = dedup.exact_dedup(raw)
    deduped = staged(deduped, "exact-dedup")
    exact_count = raw_count - exact_removed

    fz = dedup.fuzzy_dedup(deduped, match_col, threshold, max_values, order_col=order_col)
    matches = fz.matches.checkpoint()

    repaired, total_repairs, log = repair.repair(fz.table, age_columns, email_columns, approx)
    clean_count = exact_count - fz.removed
    # scored once and staged inside: the cut, the count and the sink read it
    final, anomaly_count = anomaly.detect_anomalies(repaired, approx=approx, n_rows=clean_count,
                                                    feature_cols=feature_cols)
    cqi = quality.quality_index(final, raw_count, anomaly_count, approx, rescan=True).first().asDict()
    return CleanResult(ptab_row, pcols_rows, exact_removed, fz.removed, matches, total_repairs, log,
                       anomaly_count, cqi, raw_count, clean_count, final, final.columns,
                       {"values": fz.values, "pairs": fz.pairs, "rounds": fz.rounds,
                        "elapsed": round(time.time() - t0, 2)})


def run_tracked(spark: SparkSession, source: DataFrame | str, out_dir: str, run_id: str,
                match_col: str = "name", threshold: float = dedup.DEFAULT_THRESHOLD,
                store=None, **options) -> CleanResult:
    """K9: the job plus reports (S8), metrics (S11), clean CSV (S7) and the model.

    ``options`` are those of ``clean_table``; a CSV path is UTF-8 unless told otherwise (S6).
    """
    from dqspark.plans.runs import RunStore
    store = store or RunStore(spark, f"{out_dir}/runs")
    csv_options = {k: options.pop(k) for k in ("encoding", "multiline", "schema") if k in options}
    spark_source = load(spark, source, **{"encoding": csv_source.UTF8, **csv_options})
    store.log_params(run_id, {"input_file": source if isinstance(source, str) else "<table>",
                              "fuzzy_col": match_col, "threshold": threshold})
    res = clean_table(spark, spark_source, match_col, threshold, **options)
    store.log_params(run_id, {"total_raw_records": res.profile_table["total_records"],
                              "total_columns": res.profile_table["total_columns"],
                              "threshold_band": spark.range(1).select(threshold_band(F.lit(threshold))).first()[0]})
    sinks.write_report(spark.createDataFrame([res.profile_table]), f"{out_dir}/profile_report")
    sinks.write_report(spark.createDataFrame(res.profile_columns), f"{out_dir}/profile_columns")
    wrote_matches = sinks.write_report(res.fuzzy_matches, f"{out_dir}/fuzzy_matches", only_if_rows=True)
    sinks.write_report(res.repair_log, f"{out_dir}/repair_log", only_if_rows=True)
    sinks.write_report(spark.createDataFrame([res.cqi]), f"{out_dir}/cqi_report")
    sinks.write_csv(res.table, f"{out_dir}/clean.csv")
    forest, psi = anomaly.forest_table(res.table.drop(quality.FLAG_COLUMN))
    if forest is not None:
        anomaly.save_forest(forest, f"{out_dir}/anomaly_model", psi)
    metrics = {"raw_null_rate": res.profile_table["null_rate"],
               "exact_duplicates_removed": res.exact_removed,
               "fuzzy_duplicates_removed": res.fuzzy_removed,
               "fuzzy_matches_found": res.fuzzy_matches.count() if wrote_matches else 0,
               "total_repairs": res.total_repairs, "repair_operations": res.repair_log.count(),
               "anomalies_flagged": res.anomaly_count, "clean_count": res.clean_count,
               "records_saved": res.raw_count, **res.cqi}
    store.log_metrics(run_id, metrics)
    return res
