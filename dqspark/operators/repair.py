"""Repairs (R1-R6): one statistics pass, exact medians where needed, one ``select``.

Rules (in log order: numeric columns, then text columns, schema order):

- R1 numeric missing -> column median (0 when the column has no median);
- R2 age columns (name contains ``age``): values below 0 or above 120 -> the median
  of the column after R1, bad values included. Filling with the median does not
  move the median, so the R1 median is reused (no median: R1 filled 0, so 0);
- R3 text missing -> ``"Unknown"``;
- R4 email columns (name contains ``email``): values without ``@`` -> null, applied
  after R3, so a missing email is filled, found invalid and nulled (counted twice);
- R5 +-inf -> null in float columns, last, not logged.

A repaired numeric column becomes ``double``; untouched columns keep their type.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.functions.scalar import (age_column, email_column, finite_or_null, is_float,
                                      is_numeric, is_text, missing)
from dqspark.operators import stats

# Fixed values of the repair rules.
AGE_MIN = 0
AGE_MAX = 120
AGE_DEFAULT = 30            # used when an age column has no median
TEXT_FILL = "Unknown"
EMAIL_MARK = "@"

NULL_FILLED_NUMERIC = "null_filled_numeric"
INVALID_AGE_FIXED = "invalid_age_fixed"
NULL_FILLED_TEXT = "null_filled_text"
INVALID_EMAIL_FLAGGED = "invalid_email_flagged"

LOG_SCHEMA = T.StructType([T.StructField("step", T.IntegerType(), False),
                           T.StructField("column", T.StringType(), False),
                           T.StructField("type", T.StringType(), False),
                           T.StructField("count", T.LongType(), False)])


def _c(name: str):
    return F.col(f"`{name}`")


def bad_age(c):
    return (c < AGE_MIN) | (c > AGE_MAX)


def has_mark(c):
    """Contains ``@``; missing counts as no."""
    return F.coalesce(F.contains(c, F.lit(EMAIL_MARK)), F.lit(False))


def repair_plan(df: DataFrame, age_columns: list[str] | None = None,
                email_columns: list[str] | None = None, approx: bool = False) -> tuple[list[dict], dict[str, float]]:
    """Compute counts and medians; returns (log entries, fill values per numeric column)."""
    fields = df.schema.fields
    numeric = [f for f in fields if is_numeric(f.dataType)]
    text = [f for f in fields if is_text(f.dataType)]
    ages = {f.name for f in numeric if (f.name in age_columns if age_columns is not None else age_column(f.name))}
    emails = {f.name for f in text if (f.name in email_columns if email_columns is not None else email_column(f.name))}

    aggs = []
    for f in numeric:
        aggs.append(F.count_if(missing(_c(f.name), f.dataType)).alias(f"nm:{f.name}"))
        if f.name in ages:
            aggs.append(F.count_if(~missing(_c(f.name), f.dataType) & bad_age(_c(f.name))).alias(f"ba:{f.name}"))
    for f in text:
        aggs.append(F.count_if(_c(f.name).isNull()).alias(f"nt:{f.name}"))
        if f.name in emails:
            aggs.append(F.count_if(~has_mark(_c(f.name))).alias(f"be:{f.name}"))
    # ranges and sketch windows for the exact medians ride on the same scan
    probs = [] if approx else [0.5]
    for i, f in enumerate(numeric):
        aggs += stats.range_aggs(stats.value_of(df, f.name), i, probs)
    row = df.agg(*aggs).first() if aggs else None
    ranges = {f.name: stats.range_of(row, i, probs) for i, f in enumerate(numeric)}

    want_median = [f.name for f in numeric
                   if row[f"nm:{f.name}"] > 0 or (f.name in ages and row[f"ba:{f.name}"] > 0)]
    if not want_median:
        med = {}
    elif approx:     # A9 approx: one sketch aggregate instead of exact refinement rounds
        q = stats.approx_quantiles(df, {c: [0.5] for c in want_median})
        med = {c: q[(c, 0.5)] for c in want_median}
    else:
        med = stats.medians(df, want_median, ranges)

    log, fills = [], {}
    for f in numeric:
        m = med.get(f.name)
        nulls = row[f"nm:{f.name}"]
        fill = 0.0 if m is None or math.isnan(m) else m
        if nulls > 0:
            fills[f.name] = ("null", fill)
            log.append({"column": f.name, "type": NULL_FILLED_NUMERIC, "count": nulls})
        if f.name in ages:
            bad = row[f"ba:{f.name}"]
            if bad > 0:
                # median after R1: unchanged by filling with it; 0 when R1 filled 0
                m2 = fill if nulls > 0 else m
                age_fill = AGE_DEFAULT if m2 is None or math.isnan(m2) else m2
                fills[f.name + "\x00age"] = ("age", age_fill)
                log.append({"column": f.name, "type": INVALID_AGE_FIXED, "count": bad})
    for f in text:
        nulls = row[f"nt:{f.name}"]
        if nulls > 0:
            log.append({"column": f.name, "type": NULL_FILLED_TEXT, "count": nulls})
        if f.name in emails:
            bad = row[f"be:{f.name}"]     # filled nulls have no "@": counted again here
            if bad > 0:
                log.append({"column": f.name, "type": INVALID_EMAIL_FLAGGED, "count": bad})
    for i, e in enumerate(log):
        e["step"] = i
    return log, fills


def apply_repairs(df: DataFrame, log: list[dict], fills: dict) -> DataFrame:
    done = {(e["column"], e["type"]) for e in log}
    cols = []
    for f in df.schema.fields:
        c = _c(f.name)
        repaired = False
        if is_numeric(f.dataType):
            if (f.name, NULL_FILLED_NUMERIC) in done:
                c = F.when(missing(c, f.dataType), F.lit(fills[f.name][1])).otherwise(c.cast("double"))
                repaired = True
            if (f.name, INVALID_AGE_FIXED) in done:
                c = F.when(bad_age(c), F.lit(fills[f.name + "\x00age"][1])).otherwise(c.cast("double"))
                repaired = True
            if is_float(f.dataType) or repaired:
                c = finite_or_null(c.cast("double"))
            cols.append(c.cast("double" if repaired else f.dataType).alias(f.name))
        elif is_text(f.dataType):
            if (f.name, NULL_FILLED_TEXT) in done:
                c = F.coalesce(c, F.lit(TEXT_FILL))
            if (f.name, INVALID_EMAIL_FLAGGED) in done:
                c = F.when(has_mark(c), c)
            cols.append(c.alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def repair_log_frame(spark: SparkSession, log: list[dict]) -> DataFrame:
    return spark.createDataFrame([(e["step"], e["column"], e["type"], int(e["count"])) for e in log], LOG_SCHEMA)


def repair(df: DataFrame, age_columns: list[str] | None = None,
           email_columns: list[str] | None = None, approx: bool = False) -> tuple[DataFrame, int, DataFrame]:
    """Returns (repaired table, total repairs (A12), repair log)."""
    log, fills = repair_plan(df, age_columns, email_columns, approx)
    return (apply_repairs(df, log, fills), sum(int(e["count"]) for e in log),
            repair_log_frame(df.sparkSession, log))
