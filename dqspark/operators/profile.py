"""Profiling (A1-A7, A19): counts of all columns from narrow records, then reshaped to reports.

Spark turns several exact distinct counts of one aggregate into an Expand: every row is
copied once per column, each copy as wide as all columns. Here no row is copied:

* a row gives one narrow record ``(column, digest)`` per column (a missing value has no
  digest). ``groupBy(column, digest)`` counts them with map-side combine, so a value
  held by a third of all rows, or a missing one, is one record a task; the groups are
  spread by digest, so a column of distinct values is counted by all tasks. A second, tiny
  aggregate per column gives rows, missing and distinct values. Integers are their own
  digest, other values of at most 64 bits have one hash (one to one on 64 bits), so both are
  exact; texts and the like have 128-bit digests, so no text is shuffled;
* with ``rescan=True`` (a table that is cheap to read again, such as files) integers that lie
  close together within the tasks (keys, codes) go into bitmaps instead: ``groupBy(column,
  bucket)`` with ``bitmap_construct_agg``, 4 KB for 32,768 possible values. Which columns do is
  decided by cost from their count and range in each task (one pass over the integer columns
  alone); bitmaps never shuffle more than a record of 20 bytes for each row. Both ways are exact.

``approx=True`` swaps in HyperLogLog sketches (one aggregate, fixed-size buffers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.functions.scalar import digest_pair, missing, pct, present


def _col(name: str):
    return F.col(f"`{name}`")


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FIXED = (T.BooleanType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
BUCKET = 32_768          # values of one bitmap
BITMAP_BYTES = 4096      # of one bitmap
RECORD_BYTES = 20        # of one shuffled (column, digest) record


def bitmap_columns(df: DataFrame) -> list[str]:
    """Integer columns whose buckets, as bitmaps, shuffle fewer bytes than their digests may.

    A task holds at most ``span / 32768 + 1`` buckets and at most ``min(rows, span + 1)`` values.
    """
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGERS)]
    if not ints:
        return []
    values = [_col(c).cast("long").alias(f"v{i}") for i, c in enumerate(ints)]
    per_task = df.select(F.spark_partition_id().alias("task"), *values).groupBy("task").agg(
        *[x for i in range(len(ints)) for x in (F.count(f"v{i}").alias(f"n{i}"),
                                                (F.max(f"v{i}").cast("double") - F.min(f"v{i}").cast("double")).alias(f"s{i}"))])
    cost = []
    for i in range(len(ints)):
        n, span = F.col(f"n{i}"), F.col(f"s{i}")
        cost += [F.sum((F.floor(span / BUCKET) + 2) * float(BITMAP_BYTES)).alias(f"b{i}"),
                 F.sum(F.least(n.cast("double"), span + 1) * float(RECORD_BYTES)).alias(f"d{i}")]
    row = per_task.agg(*cost).first()
    return [c for i, c in enumerate(ints) if row[f"b{i}"] is not None and row[f"b{i}"] < row[f"d{i}"]]


def _hashed(c: Column, dtype: T.DataType) -> Column:
    """What is hashed: nested values as JSON, since hashes pass over the nulls inside them."""
    if isinstance(dtype, T.MapType):
        c = F.array_sort(F.map_entries(c))
    return F.to_json(c, {"ignoreNullFields": "false"}) if isinstance(dtype, (T.MapType, T.ArrayType, T.StructType)) else c


def _records(rows: list) -> Column:
    return F.inline(F.array(*[F.struct(*r) for r in rows]))


def column_counts(df: DataFrame, bitmaps: list[str]) -> DataFrame:
    """``(i, n, m, u)`` per column position: rows, missing and distinct values."""
    digests, buckets = [], []
    for i, f in enumerate(df.schema.fields):
        c = _col(f.name)
        there = ~missing(c, f.dataType)
        if f.name in bitmaps:
            v = c.cast("long")
            buckets.append([F.lit(i).alias("i"), F.bitmap_bucket_number(v).alias("b"), F.bitmap_bit_position(v).alias("pos")])
            continue
        if isinstance(f.dataType, INTEGERS):
            d1, d2 = c.cast("long"), F.lit(0).cast("long")
        else:
            d1, d2 = digest_pair(_hashed(c, f.dataType))
            if isinstance(f.dataType, FIXED):
                d2 = F.lit(0).cast("long")
        digests.append([F.lit(i).alias("i"), F.when(there, d1).alias("d1"), F.when(there, d2).alias("d2")])
    parts = []
    if digests:
        parts.append(df.select(_records(digests)).groupBy("i", "d1", "d2").agg(F.count(F.lit(1)).alias("c"))
                     .groupBy("i").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("d1").isNull(), F.col("c")).otherwise(0)).alias("m"),
                                       F.count("d1").alias("u")))
    if buckets:
        parts.append(df.select(_records(buckets)).groupBy("i", "b")
                     .agg(F.count(F.lit(1)).alias("c"), F.bitmap_count(F.bitmap_construct_agg("pos")).alias("u"))
                     .groupBy("i").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("b").isNull(), F.col("c")).otherwise(0)).alias("m"),
                                       F.sum(F.when(F.col("b").isNotNull(), F.col("u")).otherwise(0)).alias("u")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def profile_stats(df: DataFrame, approx: bool = False, rsd: float = 0.01, rescan: bool = False) -> DataFrame:
    """One row: ``n`` plus ``m{i}`` (missing) and ``u{i}`` (distinct, missing not counted)."""
    fields = df.schema.fields
    if approx or not fields:
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, f in enumerate(fields):
            c = _col(f.name)
            aggs.append(F.count_if(missing(c, f.dataType)).alias(f"m{i}"))
            aggs.append(F.approx_count_distinct(present(c, f.dataType), rsd).alias(f"u{i}"))
        return df.agg(*aggs)
    counts = column_counts(df, bitmap_columns(df) if rescan else [])
    one = lambda i, c: F.coalesce(F.max(F.when(F.col("i") == i, F.col(c))), F.lit(0).cast("long"))
    return counts.agg(one(0, "n").alias("n"), *[x for i in range(len(fields)) for x in (one(i, "m").alias(f"m{i}"), one(i, "u").alias(f"u{i}"))])


def profile_columns(df: DataFrame, stats: DataFrame | None = None, approx: bool = False, rescan: bool = False) -> DataFrame:
    """``column, dtype, null_count, null_rate, unique_count`` in schema order."""
    stats = stats if stats is not None else profile_stats(df, approx, rescan=rescan)
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col(f"m{i}").alias("null_count"), F.col(f"u{i}").alias("unique_count"))
        for i, f in enumerate(df.schema.fields)])
    return (stats.select("n", F.inline(rows))
            .select("position", "column", "dtype", "null_count",
                    pct(F.col("null_count"), F.col("n")).alias("null_rate"),
                    "unique_count"))


def profile_table(df: DataFrame, stats: DataFrame | None = None, approx: bool = False) -> DataFrame:
    """``total_records, total_columns, total_nulls, null_rate``."""
    stats = stats if stats is not None else profile_stats(df, approx)
    ncols = len(df.columns)
    total_nulls = sum((F.col(f"m{i}") for i in range(ncols)), F.lit(0).cast("long")) if ncols else F.lit(0).cast("long")
    return stats.select(
        F.col("n").alias("total_records"),
        F.lit(ncols).alias("total_columns"),
        total_nulls.alias("total_nulls"),
        pct(total_nulls, F.col("n") * ncols).alias("null_rate"))


def profile(df: DataFrame, approx: bool = False, rescan: bool = False) -> tuple[DataFrame, DataFrame]:
    """Table row and column rows from one cached statistics row."""
    stats = profile_stats(df, approx, rescan=rescan).cache()
    return profile_table(df, stats), profile_columns(df, stats)
