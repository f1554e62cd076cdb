"""D3: greedy survivors over similarity edges, in rank order.

The reference walks values in rank order: a value is kept unless an earlier *kept*
value matches it; a dropped value drops nothing. That is the lexicographically
first maximal independent set of the edge graph (not connected components).

Spark form, in rounds over the edges (rank_i < rank_j) between undecided values:

* a value without an undecided earlier neighbour is kept. The edges are range partitioned
  by their later value, and each partition is walked as a sorted stream: a value is dropped
  by any kept neighbour, kept if all its earlier neighbours are dropped, and left open while
  one of them, in a partition before, is open. If none is open the walk is over; else edges of decided
  values go, and the next round begins; every round settles at least the first open partition, and most settle all;
* a value with exactly one undecided earlier neighbour is kept if and only if that one is
  dropped. Such values point at their neighbour and form trees; pointer jumping (every
  pointer takes its target's pointer, with the parity of the way) finds the top of each
  tree in O(log depth) steps, so a chain of near copies does not cost a round per pair.
  A tree whose top is kept is settled whole; one whose top has several earlier
  neighbours waits for it.

``window_matches`` walks a bounded window of short values (the lowest ranks of a large set) without
edges, which alike values make by the million: the lowest rank left is kept and scored against all
others left, in one numpy step a character; what it matches goes.

Stored tables of each round (and jump) hold ranks only. A walk holds the verdicts of its
own partition's values; nothing is gathered in one group or on the driver, and a lost
executor re-runs the current round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from dqspark.session import staged

#: Rounds before pointers are followed: most graphs are settled by then.
PLAIN_ROUNDS = 2


@dataclass
class Survivors:
    states: DataFrame        # (rank, keep) for every node that has an edge
    dropped: DataFrame       # (rank) of the values that are not kept
    rounds: int              # rounds run
    jumps: int               # steps of pointer jumping in all of them


def _tree_tops(e: DataFrame) -> tuple[DataFrame | None, int]:
    """(node, top, odd): for values with one earlier neighbour, the top of their tree and the parity
    of the way there. None if no tree is deeper than one step, where a plain round does as well."""
    own = e.groupBy("rank_j").agg(F.count(F.lit(1)).alias("n"), F.min("rank_i").alias("top")).where("n = 1")
    tops = staged(own.select(F.col("rank_j").alias("node"), "top", F.lit(True).alias("odd")), "survivor-pointers")
    steps = 0
    while True:
        above = tops.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("odd").alias("more"))
        if tops.join(above, "top", "left_semi").limit(1).count() == 0:
            return (tops if steps else None), steps
        tops = staged(tops.join(above, "top", "left").select(
            "node", F.coalesce("next", "top").alias("top"),
            (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd")), "survivor-jump")
        steps += 1


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, keep) of the later values of a partition, sorted by them; keep is null where it cannot decide."""
    verdicts: dict[int, bool | None] = {}       # of this partition's values; None: open
    current, dropped, open_ = None, False, False
    for batch in batches:
        ranks, keeps = [], []
        for i, j, settles in zip(*(batch.column(c).to_pylist() for c in ("rank_i", "rank_j", "settles")), strict=True):
            if j != current:
                if current is not None:
                    verdicts[current] = verdict = False if dropped else None if open_ else True
                    ranks.append(current)
                    keeps.append(verdict)
                current, dropped, open_ = j, False, False
            earlier = True if settles else verdicts.get(i)
            dropped |= earlier is True
            open_ |= earlier is None
        yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64()), pa.array(keeps, pa.bool_())], names=["rank", "keep"])
    if current is not None:
        last = False if dropped else None if open_ else True
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([last], pa.bool_())], names=["rank", "keep"])


def _window_walk(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r, v) for batch in batches
                      for r, v in zip(batch.column("rank").to_pylist(), batch.column("value").to_pylist(), strict=True))
        if not rows:
            return
        ranks = np.array([r for r, _ in rows], np.int64)
        points = [np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32) for _, v in rows]
        lens = np.array([len(p) for p in points], np.int64)
        alphabet, codes = np.unique(np.concatenate(points), return_inverse=True)
        grid = np.full((int(lens.max()), len(rows)), len(alphabet))     # the code past a text's end has no pattern bits
        owner = np.repeat(np.arange(len(rows)), lens)
        grid[np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens), owner] = codes
        all_ones = np.uint64(2**64 - 1)
        while len(ranks) > 1:
            size, rest = int(lens[0]), lens[1:]
            pattern = np.zeros(len(alphabet) + 1, np.uint64)
            np.bitwise_or.at(pattern, grid[:size, 0], np.uint64(1) << np.arange(size, dtype=np.uint64))
            s = np.full(len(rest), all_ones)
            for step in range(int(rest.max())):
                u = s & pattern[grid[step, 1:]]
                s = (s + u) | (s - u)
            low = all_ones >> np.uint64(64 - size) if size else np.uint64(0)
            lcs = size - np.bitwise_count(s & low).astype(np.int64)
            total = size + rest
            score = np.where(total == 0, 100.0, (1.0 - (total - 2 * lcs) / np.maximum(total, 1)) * 100.0)
            hit = score >= threshold
            if hit.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(hit.sum()), ranks[0])), pa.array(ranks[1:][hit]), pa.array(score[hit])],
                    names=["rank_i", "rank_j", "similarity"])
            ranks, lens, grid = ranks[1:][~hit], rest[~hit], grid[:, 1:][:, ~hit]
    return walk


def window_matches(nodes: DataFrame, threshold: float) -> DataFrame:
    """``(rank_i, rank_j, similarity)``: each dropped value of a window with its first kept match. One task walks
    the window, so the caller bounds it; values have at most 64 characters."""
    return (nodes.select("rank", "value").repartition(1)
            .mapInArrow(_window_walk(float(threshold)), "rank_i long, rank_j long, similarity double"))


def greedy_survivors(edges: DataFrame, max_rounds: int | None = None) -> Survivors:
    """Rounds until every node is decided. ``max_rounds`` only guards a job: reaching
    it with edges left raises (undecided nodes are never reported as kept)."""
    e = edges.select(F.col("rank_i").cast("long").alias("rank_i"), F.col("rank_j").cast("long").alias("rank_j"))
    first, gone, rounds, jumps = None, [], 0, 0
    while True:
        later = e.select(F.col("rank_j").alias("rank_i")).distinct().withColumn("waits", F.lit(True))
        seen = Observation()                                # rows and open values are counted as they are written
        marked = staged(e.join(later, "rank_i", "left").select("rank_i", "rank_j", F.col("waits").isNull().alias("settles"))
                        .observe(seen, F.count(F.lit(1)).alias("edges")), "survivor-round")
        first = marked if first is None else first
        left = seen.get["edges"]
        if not left:
            break
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"survivors undecided after {rounds} rounds ({left} edges left)")
        if rounds >= PLAIN_ROUNDS:
            tops, steps = _tree_tops(marked)
            jumps += steps
            if tops is not None:
                heads = marked.where("settles").select(F.col("rank_i").alias("top")).distinct()
                even = tops.where("not odd").join(heads, "top", "left_semi").select(F.col("node").alias("rank_i"), F.lit(True).alias("even"))
                marked = staged(marked.join(even, "rank_i", "left").select(
                    "rank_i", "rank_j", (F.col("settles") | F.col("even").isNotNull()).alias("settles")), "survivor-trees")
        seen = Observation()
        walked = staged(marked.repartitionByRange("rank_j").sortWithinPartitions("rank_j").mapInArrow(_walk, "rank long, keep boolean")
                        .observe(seen, F.count_if(F.col("keep").isNull()).alias("open")), "survivor-walk")
        rounds += 1
        if not seen.get["open"]:                            # every later value has its verdict
            gone.append(walked.where("not keep").select("rank"))
            break
        kept = walked.where("keep").select("rank")
        drop = walked.where("not keep").select("rank").union(
            marked.join(kept.withColumnRenamed("rank", "rank_i"), "rank_i", "left_semi").select("rank_j")).distinct()
        gone.append(drop)
        decided = drop.union(kept)
        e = (marked.where("not settles").join(decided.withColumnRenamed("rank", "rank_j"), "rank_j", "left_anti")
             .join(decided.withColumnRenamed("rank", "rank_i"), "rank_i", "left_anti").select("rank_i", "rank_j"))
    spark = edges.sparkSession
    dropped = gone[0] if gone else spark.createDataFrame([], "rank long")
    for more in gone[1:]:
        dropped = dropped.unionByName(more)
    if len(gone) > 1:                                       # the values of one round are distinct and stored
        dropped = staged(dropped.distinct(), "survivor-dropped")
    nodes = first.select(F.col("rank_i").alias("rank")).union(first.select("rank_j")).distinct()
    states = nodes.join(dropped.withColumn("gone", F.lit(True)), "rank", "left").select("rank", F.col("gone").isNull().alias("keep"))
    return Survivors(states, dropped, rounds, jumps)
