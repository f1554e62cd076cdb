"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The score bands and words shown to users.
STATUS_WORDS = ("Clean", "Has Nulls")                     # no nulls / some nulls
VERDICT_WORDS = ("Excellent", "Acceptable", "Poor")
VERDICT_EXCELLENT = 80       # quality score at or above: "Excellent"
VERDICT_ACCEPTABLE = 60      # quality score at or above: "Acceptable", else "Poor"
SEVERITY_WORDS = ("High", "Medium")
SEVERITY_HIGH = 90           # match similarity at or above: "High", else "Medium"
BAND_WORDS = ("Strict", "Balanced", "Lenient")
BAND_STRICT = 90             # threshold at or above: "Strict"
BAND_BALANCED = 80           # threshold at or above: "Balanced", else "Lenient"

FLOAT_TYPES = (T.DoubleType, T.FloatType)


def is_float(dt: T.DataType) -> bool:
    return isinstance(dt, FLOAT_TYPES)


def is_numeric(dt: T.DataType) -> bool:
    """Numbers (booleans are not numbers here, as in the reference)."""
    return isinstance(dt, T.NumericType)


def is_text(dt: T.DataType) -> bool:
    """Text columns."""
    return isinstance(dt, T.StringType)


def missing(c: Column, dt: T.DataType) -> Column:
    """True where a value counts as missing: null, or NaN in a float column."""
    if is_float(dt):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(c: Column, dt: T.DataType) -> Column:
    """The value, or null when missing (so NaN is not counted as a distinct value)."""
    if is_float(dt):
        return F.when(~F.isnan(c), c)
    return c


def digest_pair(*cs: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of the values under different seeds, 128 bits together. NaN equals NaN, -0.0
    equals 0.0. Hashes pass over nulls, so null marks are hashed beside several values."""
    marks = [c.isNull() for c in cs] if len(cs) > 1 else []
    return F.xxhash64(F.lit(1), *cs, *marks), F.xxhash64(F.lit(2), *cs, *marks)


def is_inf(c: Column) -> Column:
    return (c == F.lit(float("inf"))) | (c == F.lit(float("-inf")))


def finite_or_null(c: Column) -> Column:
    """NaN and +-inf become null; other values pass."""
    return F.when(F.isnan(c) | is_inf(c), F.lit(None)).otherwise(c)


def _holds_float(dt: T.DataType) -> bool:
    if is_float(dt):
        return True
    if isinstance(dt, T.ArrayType):
        return _holds_float(dt.elementType)
    if isinstance(dt, T.MapType):
        return _holds_float(dt.valueType)
    if isinstance(dt, T.StructType):
        return any(_holds_float(f.dataType) for f in dt.fields)
    return False


def finite_deep(c: Column, dt: T.DataType) -> Column:
    """C1 at any depth: NaN and +-inf to null inside arrays, map values and structs.

    Higher-order functions (``transform``, ``transform_values``) run in the JVM.
    """
    if not _holds_float(dt):
        return c
    if is_float(dt):
        return finite_or_null(c).cast(dt)
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: finite_deep(x, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda _, v: finite_deep(v, dt.valueType))
    fields = [finite_deep(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields]
    return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*fields)).cast(dt)


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and +-inf to null in every float value, nested ones included."""
    return df.select(*[finite_deep(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
                       for f in df.schema.fields])


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percent of ``part`` in ``whole`` (divisor at least 1), rounded."""
    return F.round(part / F.greatest(whole, F.lit(1)) * 100.0, digits)


def clamp_pct(ratio: Column) -> Column:
    """A 0-1 ratio as percent with one digit, clamped to 0..100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(ratio * 100.0, 1)))


def column_status(null_count: Column) -> Column:
    """C11."""
    return F.when(null_count == 0, F.lit(STATUS_WORDS[0])).otherwise(F.lit(STATUS_WORDS[1]))


def quality_verdict(score: Column) -> Column:
    """C12."""
    return (F.when(score >= VERDICT_EXCELLENT, F.lit(VERDICT_WORDS[0]))
            .when(score >= VERDICT_ACCEPTABLE, F.lit(VERDICT_WORDS[1]))
            .otherwise(F.lit(VERDICT_WORDS[2])))


def match_severity(similarity: Column) -> Column:
    """C13."""
    return F.when(similarity >= SEVERITY_HIGH, F.lit(SEVERITY_WORDS[0])).otherwise(F.lit(SEVERITY_WORDS[1]))


def threshold_band(threshold: Column) -> Column:
    """C14."""
    return (F.when(threshold >= BAND_STRICT, F.lit(BAND_WORDS[0]))
            .when(threshold >= BAND_BALANCED, F.lit(BAND_WORDS[1]))
            .otherwise(F.lit(BAND_WORDS[2])))


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, two places."""
    return F.round(F.timestamp_diff("MICROSECOND", start, end) / F.lit(1_000_000.0), 2)


def duration_text(seconds: Column) -> Column:
    """Seconds as ``"<h>h <m>m <s>s"``."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%dh %dm %ds", F.floor(s / 3600).cast("long"),
                           F.floor((s % 3600) / 60).cast("long"), (s % 60).cast("long"))


def repair_label(kind: Column) -> Column:
    """Underscores to spaces."""
    return F.regexp_replace(kind, "_", " ")


def job_id_of(file_name: Column) -> Column:
    """The part of a file name before the first underscore."""
    return F.substring_index(F.element_at(F.split(file_name, "/"), -1), "_", 1)


def utc_iso(ts: Column) -> Column:
    """A timestamp (session time zone UTC) as ISO-8601 text with ``Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def age_column(name: str) -> bool:
    """P3 (Q6): any column whose lower-cased name contains ``age``."""
    return "age" in name.lower()


def email_column(name: str) -> bool:
    """Any column whose lower-cased name contains ``email``."""
    return "email" in name.lower()


def default_match_column(columns: list[str]) -> str | None:
    """First column whose name contains ``name`` (case-blind), else the first."""
    for c in columns:
        if "name" in c.lower():
            return c
    return columns[0] if columns else None
