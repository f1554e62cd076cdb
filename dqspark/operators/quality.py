"""Quality index (K1-K7): five dimensions and a total, from one aggregate.

completeness = 1 - missing cells / cells of the clean table (``anomaly_flag`` included)
uniqueness   = clean rows / raw rows
validity     = 1 - anomalies / clean rows
consistency  = mean over columns of distinct values / clean rows
accuracy     = min(completeness, validity)
score        = mean of the five (each rounded to 4 digits) * 100, 2 digits

Dimensions are reported as percent with one digit, clamped to 0..100. The clean
table's counts come from the profile's column counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.functions.scalar import clamp_pct, quality_verdict
from dqspark.operators.profile import profile_stats

ANOMALY = "Anomaly"
NORMAL = "Normal"
FLAG_COLUMN = "anomaly_flag"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def quality_index(clean: DataFrame, raw_count: int | Column, anomaly_count: int | Column | None = None,
                  approx: bool = False, rescan: bool = False) -> DataFrame:
    """K6: one row ``completeness, uniqueness, validity, consistency, accuracy, cqi_score``.

    With ``anomaly_count=None`` anomalies are counted from ``anomaly_flag``.
    """
    if anomaly_count is None and FLAG_COLUMN in clean.columns:
        anomaly_count = clean.where(F.col(FLAG_COLUMN) == ANOMALY).count()
    st = profile_stats(clean, approx, rescan=rescan)
    anomalies = _lit(anomaly_count if anomaly_count is not None else 0)
    ncols = len(clean.columns)
    n = F.greatest(F.col("n"), F.lit(1))
    nulls = sum((F.col(f"m{i}") for i in range(ncols)), F.lit(0).cast("long"))
    cells = F.greatest(n * ncols, F.lit(1))
    consistency = (sum((F.col(f"u{i}") / n for i in range(ncols)), F.lit(0.0)) / ncols) if ncols else F.lit(0.0)
    k = st.select(
        F.round(1 - nulls / cells, 4).alias("c"),
        F.round(n / F.greatest(_lit(raw_count), F.lit(1)), 4).alias("u"),
        F.round(1 - anomalies / n, 4).alias("v"),
        F.round(consistency, 4).alias("s"))
    k = k.withColumn("a", F.round(F.least("c", "v"), 4))
    return k.select(
        clamp_pct(F.col("c")).alias("completeness"),
        clamp_pct(F.col("u")).alias("uniqueness"),
        clamp_pct(F.col("v")).alias("validity"),
        clamp_pct(F.col("s")).alias("consistency"),
        clamp_pct(F.col("a")).alias("accuracy"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0),
                   F.round((F.col("c") + F.col("u") + F.col("v") + F.col("s") + F.col("a")) / 5 * 100, 2)))
        .alias("cqi_score"))


def with_verdict(index: DataFrame) -> DataFrame:
    """C12 on the score row."""
    return index.withColumn("verdict", quality_verdict(F.col("cqi_score")))


def issue_summary(spark, exact_removed: int, fuzzy_removed: int, total_repairs: int,
                  anomaly_count: int, raw_count: int, clean_count: int) -> DataFrame:
    """K7: stage counts as a long table ``(issue, count)``."""
    rows = [("exact_duplicates", exact_removed), ("fuzzy_duplicates", fuzzy_removed),
            ("repairs", total_repairs), ("anomalies", anomaly_count), ("raw_records", raw_count),
            ("clean_records", clean_count), ("removed_records", raw_count - clean_count)]
    return spark.createDataFrame([(k, int(v)) for k, v in rows], "issue string, count long")
