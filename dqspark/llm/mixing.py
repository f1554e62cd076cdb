"""Mixing sources to target weights by pivotal dependent rounding.

A document's expected number of copies is its source's target over its source's size.
The whole part is taken for sure; the fractional parts are rounded by the pivotal
method: two documents exchange word mass at random until one of them is integral, so
every document keeps its expectation and a source's words stay on target up to half of one
document, the last one, which goes to its nearer side. The exchange runs in blocks, and what one block leaves over (at most one
fractional document) meets the leftovers of other blocks one level up: a reduction tree
whose tasks each see a bounded number of rows, whatever a source holds.

Defined cases: null text has size 0; size 0 is never taken; a null source is a source of
its own, last in order; repeated rows are separate documents, each with a coin and a block of
its own, drawn by its occurrence number among its equals (in ``take``, rows that differ in columns other
than id, source and text alone share a coin); sources are ordered by code point, so
there are no ties among them, and documents of equal size and coin stay in the order they are
read; texts of any length are counted whole; other columns are never read by the rounding; an
empty table gives an empty result. Reruns agree: the random numbers are hashes of the document,
its occurrence number and the seed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import WORD, stored

#: Weights dealt to the sources by code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target stops at so many times its source's size.
MOST_COPIES = 3
#: Documents that one task of the reduction tree sees at a time.
BLOCK = 4096
_SLACK = 1e-9
#: Occurrences of one row that are numbered by one task.
CHUNK = 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): weights share all words, capped, the excess reshared.

    ``sizes`` has one row per source (source, source_size, docs). The order of the sources
    comes from a range partitioning and per-partition offsets. Each round of resharing is
    one small aggregate; only its scalars reach the driver, and it ends when no target is
    above its cap. With w the weights of the open sources and s their caps the shared level
    rises each round, so a source that is capped stays capped.
    """
    spread = stored(sizes.repartitionByRange(F.col("source").asc_nulls_last())
                    .withColumn("part", F.spark_partition_id()), "mix-sources")
    counts = spread.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = spread.withColumn("inside", inside - 1).join(F.broadcast(before), "part")
    place = ((F.col("before") + F.col("inside")) % len(weights)).cast("int")
    ranked = ranked.select("source", "source_size", "docs",
                           F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1).alias("weight"),
                           (F.lit(float(MOST_COPIES)) * F.col("source_size")).alias("cap"))
    ranked = stored(ranked, "mix-ranked")
    total = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("held"),
                         F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("open")).first()
        if not row["open"]:
            break
        new = (total - row["held"]) / row["open"]
        if new <= level:
            break
        level = new
    return ranked.select("source", "source_size", "docs",
                         F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _round_block(size: np.ndarray, frac: np.ndarray, coin: np.ndarray) -> np.ndarray:
    """Pivotal rounding along one block: the running document meets the next one.

    Word mass ``size * frac`` moves between the two until one is 0 or 1; which way is drawn
    with the odds that keep both expectations. At most one document stays fractional.
    """
    p = frac.tolist()
    s, u = size.tolist(), coin.tolist()
    live = -1
    for i in range(len(p)):
        if p[i] <= _SLACK or p[i] >= 1 - _SLACK:
            p[i] = float(round(p[i]))
            continue
        if live < 0:
            live = i
            continue
        a, b = s[live], s[i]
        up = min((1 - p[live]) * a, p[i] * b)      # mass that can go to the running one
        down = min(p[live] * a, (1 - p[i]) * b)    # mass that it can give
        move = up if u[i] * (up + down) < down else -down
        p[live] += move / a
        p[i] -= move / b
        for k in (live, i):
            if p[k] <= _SLACK or p[k] >= 1 - _SLACK:
                p[k] = float(round(p[k]))
        left = [k for k in (live, i) if 0.0 < p[k] < 1.0]
        live = left[0] if left else -1
    return np.array(p)


def _round_blocks(df: DataFrame, level: int, seed: int) -> DataFrame:
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: what stays fractional at the end is a small one.
        pdf = pdf.sort_values(["size", "pick"], ascending=[False, True], kind="stable")
        coin = (((pdf["pick"].to_numpy().astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (level + seed + 1) % 2**64))
                 * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11)).astype(np.float64) / 2.0**53
        pdf["frac"] = _round_block(pdf["size"].to_numpy(float), pdf["frac"].to_numpy(float), coin)
        return pdf

    return df.groupBy("source_key", "block").applyInPandas(block, schema=df.schema)


def numbered(rows: DataFrame) -> DataFrame:
    """Every row with ``occurrence``, its number among equal rows (from 0).

    Rows are counted with partial aggregation and dealt out again in chunks, so a row that
    repeats through a third of the table is neither gathered nor numbered by one task.
    """
    own = rows.columns
    counted = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK).cast("long"))))
    dealt = chunks.repartition(*own, "_at")
    last = F.least(F.col("_at") + (CHUNK - 1), F.col("_n") - 1)
    return dealt.withColumn("occurrence", F.explode(F.sequence("_at", last))).select(*own, "occurrence")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 7, row: Column | None = None) -> DataFrame:
    """Per document: ``row``, size, source_size, target (its source's), copies and taken words."""
    row = F.struct(F.col("doc_id").cast("long").alias("doc_id")) if row is None else row
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"),
                       word_count(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("digest"), row.alias("row"))
    base = stored(numbered(base).withColumn(
        "pick", F.xxhash64(F.lit(seed), "id", "source", "size", "digest", "occurrence")).drop("occurrence", "digest"), "mix-docs")
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size"),
                                                        F.count(F.lit(1)).alias("docs")), weights)
    targets = stored(targets, "mix-targets").withColumn("source_key", F.xxhash64("source", F.col("source").isNull()))
    joined = base.join(targets, base["source"].eqNullSafe(targets["source"])).select(
        "id", "pick", "size", "row", "source_key", "source_size", "docs", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("want"))
    whole = F.floor(F.col("want") + _SLACK)
    frac = F.when((F.col("size") > 0) & (F.col("want") - whole > _SLACK), F.col("want") - whole).otherwise(0.0)
    joined = joined.withColumn("whole", whole).withColumn("frac", frac)
    top = targets.agg(F.max("docs")).first()[0] or 0
    level, rows, sure = 0, joined, []
    while True:
        blocks = max(1, -(-int(top) // BLOCK))
        todo = rows.withColumn("block", F.pmod(F.xxhash64("pick", F.lit(level)), F.lit(blocks)))
        rows = stored(_round_blocks(todo, level, seed).drop("block"), f"mix-level{level}")
        open_ = (F.col("frac") > 0) & (F.col("frac") < 1)
        if blocks == 1:
            # One fractional document a source is left: the nearer side, at most half of it off target.
            sure.append(rows.withColumn("frac", F.when(open_, (F.col("frac") >= 0.5).cast("double")).otherwise(F.col("frac"))))
            break
        sure.append(rows.where(~open_))
        rows, top, level = rows.where(open_), blocks, level + 1
    out = sure[0]
    for more in sure[1:]:
        out = out.unionByName(more)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("frac").cast("long")).otherwise(0).cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).cast("long").alias("taken"))


def take(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The mix itself: every row as many times as it is taken, with its own columns.

    Only sizes and row digests go through the rounding; the rows are joined back by digest.
    Equal rows share a digest, so one of them stands for the copies of all.
    """
    cells = [F.col(f"`{c}`") for c in docs.columns]
    digest = F.struct(F.xxhash64(*cells).alias("a"), F.xxhash64(F.lit(1), *cells).alias("b"))
    took = mix(docs, weights, seed, digest).groupBy("row").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("equal")).where("copies > 0")
    rows = docs.select(digest.alias("digest"), F.struct("*").alias("whole")).join(
        took, F.col("digest") == F.col("row")).select("digest", "whole", "copies", "equal")
    single = rows.where("equal = 1")
    several = rows.where("equal > 1").groupBy("digest").agg(
        F.first("whole").alias("whole"), F.first("copies").alias("copies"), F.first("equal").alias("equal"))
    return single.unionByName(several).select(
        "whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole.*")
