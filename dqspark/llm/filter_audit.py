"""Operator 11: how five filters interact, over all 120 orders of applying them.

Every document gets the set of filters it fails (a mask of five bits). In the order with
lexicographic rank r the document is removed by the first filter of the order that is in its
mask. All orders that begin with the same s filters form one interval of (5 - s)! ranks, so a
mask is removed at step s over a few such intervals: one for each way to write s - 1 filters
outside the mask and then one inside it. Counts are added where an interval begins, taken off
where it ends, and a running sum over the 120 ranks gives every order's totals.

Defined cases: a null text is empty; a null ``lang`` is the part ``''``; a document without a
row in ``labels`` is neither good nor toxic, and with several rows it is good (toxic) if any of
them says so; a null ``doc_id`` is larger or smaller than nothing, so it never fails E and has no
labels; repeated rows are documents of their own (equal ids are not smaller, so they do not fail
E through one another); ties do not arise, since every removal is decided by the mask. Texts of any
length are read whole, one at a time. An empty table has no parts and gives no rows. Columns
other than ``doc_id``, ``text`` and ``lang`` (``doc_id``, ``quality`` and ``toxic`` in the
labels) are never read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations, permutations
from math import factorial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import slices, stored

FILTERS = "ABCDE"
SIZE = len(FILTERS)
ORDERS = factorial(SIZE)
#: Limits of the contract's filters (fixed values).
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOL = re.compile(rb"[#$%&*|]")
COUNTS = ("n", "good", "toxic")

_FACTS = "doc_id long, part string, digest binary, mask int"


def text_mask(data: bytes, n_chars: int) -> int:
    """Bits of the filters A to D that a text fails; ``data`` is its UTF-8."""
    words = data.split()            # bytes split at exactly the six ASCII white-space characters
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = (len(words) < MIN_WORDS,
             100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words),
             100 * capitals > MAX_CAPITAL_PERCENT * n_chars,
             SYMBOL.search(data) is not None)
    return sum(1 << i for i, f in enumerate(fails) if f)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            chars = pc.utf8_length(part.column("text")).to_pylist()
            digests, masks = [], []
            for data, n in zip(part.column("text").cast(pa.binary()), chars, strict=True):
                raw = data.as_py()
                digests.append(hashlib.sha256(raw).digest())
                masks.append(text_mask(raw, n))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                names=["doc_id", "part", "digest", "mask"])


def text_facts(docs: DataFrame) -> DataFrame:
    """(doc_id, part, SHA-256 of the text, mask of A to D): all that leaves the scan of the texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(_facts, _FACTS)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail.

    E needs the smallest id of every text, but no document is joined back to it: documents are
    counted by (text, part, labels) together with the smallest id of each such cell, so a text
    held by a third of the table is one row of partial counts per task, and only the few cells
    of a text meet in a window.
    """
    rows = text_facts(docs).groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("c"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    marked = rows.join(marks, "doc_id", "left").select(
        "doc_id", "digest", "part", "mask", "c", F.coalesce("is_good", F.lit(False)).alias("is_good"),
        F.coalesce("is_toxic", F.lit(False)).alias("is_toxic"))
    cells = marked.groupBy("digest", "mask", "part", "is_good", "is_toxic", F.col("doc_id").isNull().alias("no_id")).agg(
        F.sum("c").alias("n"), F.min(F.struct("doc_id", "c")).alias("first"))
    smallest = F.min(F.col("first.doc_id")).over(Window.partitionBy("digest"))
    cells = cells.withColumn("smallest", smallest).withColumn(
        "free", F.when(F.col("no_id"), F.col("n")).when(F.col("first.doc_id") == F.col("smallest"), F.col("first.c"))
        .otherwise(F.lit(0)))
    both = F.array(F.struct(F.col("mask").alias("mask"), F.col("free").alias("n")),
                   F.struct((F.col("mask") + F.lit(1 << (SIZE - 1))).alias("mask"), (F.col("n") - F.col("free")).alias("n")))
    return cells.select("part", "is_good", "is_toxic", F.explode(both).alias("x")).groupBy("part", "x.mask").agg(
        F.sum("x.n").alias("n"), F.sum(F.when(F.col("is_good"), F.col("x.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), F.col("x.n")).otherwise(0)).alias("toxic")).where("n > 0")


def lehmer_rank(order: tuple[int, ...]) -> int:
    """Lexicographic rank of a permutation of 0 .. SIZE - 1: its Lehmer code read in factorial base."""
    return sum(sum(b < a for b in order[i + 1:]) * factorial(SIZE - 1 - i) for i, a in enumerate(order))


def intervals(mask: int) -> list[tuple[int, int, int, int]]:
    """(step, filter, first rank, end rank) of every interval of orders that removes ``mask`` at ``step``."""
    inside = [i for i in range(SIZE) if mask >> i & 1]
    outside = [i for i in range(SIZE) if not mask >> i & 1]
    found = []
    for before in range(len(outside) + 1):
        for chosen in combinations(outside, before):
            for head in permutations(chosen):
                for f in inside:
                    used = (*head, f)
                    rest = sorted(set(range(SIZE)) - set(used))
                    at = lehmer_rank((*used, *rest))
                    found.append((before + 1, f, at, at + factorial(SIZE - 1 - before)))
    return found


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step with the counts of the contract; zeros included."""
    spark = docs.sparkSession
    counts = stored(mask_counts(docs, labels), "filter-masks")
    # Fixed size: 31 masks and their intervals' ends, whatever the tables hold.
    ends = spark.createDataFrame(
        [(m, step, rank, sign) for m in range(1, 1 << SIZE) for step, _, lo, hi in intervals(m)
         for rank, sign in ((lo, 1), (hi, -1)) if rank < ORDERS], "mask int, step int, rank int, sign int")
    orders = spark.createDataFrame(
        [(lehmer_rank(p), "".join(FILTERS[i] for i in p), k + 1, p[k]) for p in permutations(range(SIZE)) for k in range(SIZE)],
        "rank int, filter_order string, step int, filter int")
    events = counts.join(F.broadcast(ends), "mask").groupBy("part", "step", "rank").agg(
        *[F.sum(F.col(c) * F.col("sign")).alias(c) for c in COUNTS])
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0)).alias(f"fails{i}")
             for i in range(SIZE)]
    only = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"only{i}") for i in range(SIZE)]
    parts = counts.groupBy("part").agg(
        F.sum("n").alias("all_docs"), F.array(*fails).alias("fails"), F.array(*only).alias("only"))
    # Difference array: (part, step) x 120 ranks, counts where intervals begin and end, summed up along the ranks.
    cells = parts.select("part").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(SIZE)))) \
        .withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.join(events, ["part", "step", "rank"], "left").select(
        "part", "step", "rank", *[F.sum(F.coalesce(c, F.lit(0))).over(along).alias(c) for c in COUNTS])
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return sums.join(F.broadcast(orders), ["rank", "step"]).join(parts, "part").select(
        "part", "filter_order", "step",
        (F.col("all_docs") - F.sum("n").over(steps)).cast("long").alias("kept"),
        F.col("n").cast("long").alias("removed"),
        (F.col("fails")[F.col("filter")] - F.col("n")).cast("long").alias("redundant"),
        F.col("only")[F.col("filter")].cast("long").alias("unique_fails"),
        F.col("good").cast("long").alias("good_lost"), F.col("toxic").cast("long").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "filter")).cast("long").alias("shapley"))
