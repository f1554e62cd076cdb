"""Deduplication: exact (D1) and near-duplicate.

Near-duplicate plan over the match column ``col``:

  rows --groupBy(value) (map-side combined)--> frequencies (A8)
       --rank by (count desc, value asc)--> nodes (W1; ``max_values`` caps to
         the most frequent values as the reference does; ``None`` ranks all)
       --blocks of ranks, each three times as large as all before it: a block meets only the values
         kept so far (J1), what matches goes; the rest is joined with itself (J1) and
         walked greedily (D3; alike short values in windows)--> dropped values, each with its first kept match (W2)
       --left anti join (J2)--> rows without dropped values

Rows sharing a kept value all stay, rows sharing a dropped value all go, rows
with a missing value always stay. Identical values share one node, so a value
held by a third of all rows is one node with a big count, not a hot group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.functions.scalar import digest_pair
from dqspark.operators.blocking import first_matches, first_partners, join_rows_below, short_stats, similarity_edges
from dqspark.operators.survivors import greedy_survivors, window_matches
from dqspark.session import ensure_checkpoint_dir, staged, staged_counted

DEFAULT_THRESHOLD = 85
DEFAULT_MAX_VALUES = None      # all values; a caller may ask for the k most frequent ones
MATCHES_KEPT = 50              # T2
MATCHES_SHOWN = 20             # T3: a display limit, never applied to what is stored
DIGEST_BYTES = 64              # of one digest pair in a broadcast table
BROADCAST_BYTES = 64 << 20     # digest sets below this many bytes are broadcast
DROP_BYTES = 8 << 20           # and drop sets (short texts, which take several times that on the driver)


def fresh_name(taken: list[str], name: str) -> str:
    """``name`` with as many leading underscores as make it new (names differ by case only: the same)."""
    low = {t.lower() for t in taken}
    while name in low:
        name = "_" + name
    return name


def _c(name: str):
    return F.col(f"`{name}`")


# --------------------------------------------------------------------------- D1

def exact_dedup(df: DataFrame) -> tuple[DataFrame, int]:
    """D1 + A13: whole-row distinct (missing equals missing) and rows removed.

    Only 128-bit digests of the rows are shuffled (combined map-side, so a row repeated in a
    third of the table is one record a task). A row whose digest is its own stays where it is; rows
    that share one are compared in full, so equal digests are confirmed and a clash of
    digests loses no row. The set of repeated digests is broadcast when it is measured below
    ``BROADCAST_BYTES``; beyond that so many rows repeat that all are grouped in full, once.
    """
    cols, (d1, d2) = df.columns, digest_pair(*[_c(c) for c in df.columns])
    marks = [fresh_name(cols, "d1"), fresh_name(cols, "d2")]
    rows = df.withColumns({marks[0]: d1, marks[1]: d2})
    repeated = staged(rows.groupBy(*marks).agg(F.count(F.lit(1)).alias("__copies")).where(F.col("__copies") > 1),
                      "repeated-rows")
    size, copies = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("__copies"), F.lit(0))).first()
    if size == 0:
        return df, 0
    if size * DIGEST_BYTES <= BROADCAST_BYTES:
        known = F.broadcast(repeated.select(*marks))
        firsts = staged(rows.join(known, marks, "left_semi").select(*[_c(c) for c in cols]).dropDuplicates(), "first-copies")
        alone = rows.join(known, marks, "left_anti").select(*[_c(c) for c in cols])
        return alone.unionByName(firsts), int(copies) - firsts.count()
    kept = staged(df.dropDuplicates(), "exact-dedup")
    return kept, df.count() - kept.count()


# --------------------------------------------------------------------------- A8, T1, W1

def value_frequencies(df: DataFrame, col: str, order_col: str | None = None) -> DataFrame:
    """``(value, count)`` of the present values of ``col`` as text (C5); with ``order_col`` also
    ``first``, the smallest value of that column on the value's rows."""
    aggs = [F.count(F.lit(1)).alias("count")] + ([F.min("first").alias("first")] if order_col else [])
    cols = [_c(col).cast("string").alias("value")] + ([_c(order_col).alias("first")] if order_col else [])
    return df.select(*cols).where(F.col("value").isNotNull()).groupBy("value").agg(*aggs)


def _rank_order(freq: DataFrame) -> list:
    """Count descending, then where first seen (if known, unknown last), then value."""
    return [F.desc("count"), *([F.asc_nulls_last("first")] if "first" in freq.columns else []), F.asc("value")]


def top_values(freq: DataFrame, k: int) -> DataFrame:
    """T1 + W1: the ``k`` most frequent values, ties by value, with their rank (1-based).

    A plain ``orderBy.limit`` sends every partition's top ``k`` rows, texts included,
    to one task. Instead:

    1. the histogram of counts, only its ``k`` largest counts (at most ``k`` small
       rows), gives the k-th largest count ``c`` and how many values reach it;
    2. only values with ``count >= c`` can be in the result, however many tie at ``c``;
       they are range sorted over the cluster and the first ``k`` are kept by partition
       offsets.

    The rank window then sees at most ``k`` rows.
    """
    spark = freq.sparkSession
    ensure_checkpoint_dir(spark)
    # both passes below read the frequencies: aggregate the table once
    freq = freq.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        hist = (freq.groupBy("count").agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.desc("count")).limit(k).collect())
        above, cut = 0, None
        for r in hist:
            if above + r["n"] >= k:
                cut = r["count"]
                break
            above += r["n"]
        # fewer than k values in all: every one is in
        cand = freq if cut is None else freq.where(F.col("count") >= F.lit(cut))
        order = _rank_order(freq)
        ranked = (cand.orderBy(*order)
                  .select(*freq.columns, F.spark_partition_id().alias("__pid"),
                          F.monotonically_increasing_id().alias("__pos"))
                  .checkpoint())      # fixes the sorted layout for the offsets below
        sizes = sorted((r["__pid"], r["n"]) for r in
                       ranked.groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect())
        keep, left = [], k            # partitions are in sort order
        for pid, n in sizes:
            if left <= 0:
                break
            keep.append((pid, min(n, left)))
            left -= n
        # row index inside a partition = id minus the partition's base (pid << 33)
        idx = F.col("__pos") - F.shiftleft(F.col("__pid").cast("long"), 33)
        cond = F.lit(False)
        for pid, take in keep:
            cond = cond | ((F.col("__pid") == pid) & (idx < take))
        top = ranked.where(cond).select(*freq.columns)
    finally:
        freq.unpersist()
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("first")


def rank_all(freq: DataFrame) -> DataFrame:
    """W1 without a cap: a global range sort, then ranks from 1 without gaps.

    ``monotonically_increasing_id`` after the sort holds the partition (high bits) and the
    place in it; the result is checkpointed so the ids are fixed even if a stage is
    recomputed. The row counts before each partition (one row per partition) turn it into
    a rank, so no task sees more than its own partition.
    """
    ensure_checkpoint_dir(freq.sparkSession)
    placed = (freq.orderBy(*_rank_order(freq))
              .withColumn("__id", F.monotonically_increasing_id()).checkpoint()
              .withColumn("__part", F.shiftright("__id", 33)))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.col("__id") - F.shiftleft(F.col("__part"), 33)
    return placed.join(F.broadcast(before), "__part").select(
        "value", "count", (F.col("__before") + inside + 1).cast("long").alias("rank")).checkpoint()


def ranked_values(df: DataFrame, col: str, max_values: int | None = DEFAULT_MAX_VALUES,
                  order_col: str | None = None) -> DataFrame:
    """``(value, count, rank)``; ties by value, or by where first seen in the order of ``order_col``."""
    freq = value_frequencies(df, col, order_col)
    return top_values(freq, max_values) if max_values is not None else rank_all(freq)


# --------------------------------------------------------------------------- D4, D5

@dataclass
class FuzzyResult:
    table: DataFrame          # rows left
    removed: int              # rows removed (A13)
    matches: DataFrame        # D5: original, duplicate, similarity, rank_i, rank_j (all)
    values: int               # ranked values
    pairs: int                # pairs scored >= threshold; those of dropped values are not looked for, and of a value
                              # that falls to one kept in a block before, the first pair alone
    rounds: int               # survivor rounds
    dropped: DataFrame        # (value, count) of dropped values
    candidates: int = 0       # candidate pairs verified (band join: its counted upper bound)
    strategy: str = ""        # candidate generators used: band, prefix or both

    def first_matches(self, n: int = MATCHES_KEPT) -> DataFrame:
        """The first ``n`` matches in (rank_i, rank_j) order."""
        return self.matches.orderBy("rank_i", "rank_j").limit(n)


FIRST_BLOCK = 4096           # ranks in the first block of the walk
BLOCK_GROWTH = 3             # a later block is this many times as large as all before it together
EDGE_ROWS_MAX = 12_000_000   # join rows that one block may make with itself; with more it is split
WALK_WINDOW = 4096           # values that one task walks without edges, in a larger set of short values
ALIKE = 0.25                 # at most this share of a window was kept: what follows is walked in windows, not joined
SPLIT_FROM = 512             # values; fewer are never split
SPLIT_AT = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2)   # shares of a split block that may be walked first


@dataclass
class Walk:
    matches: DataFrame        # (rank_i, rank_j, similarity): each dropped rank with its first kept match
    pairs: int
    rounds: int
    candidates: int
    strategy: str


def greedy_walk(nodes: DataFrame, n_values: int, threshold: float, first_block: int = FIRST_BLOCK) -> Walk:
    """The greedy walk over ``nodes(rank 1..n, value)`` without the edges of dropped values.

    Ranks are taken in blocks, each ``BLOCK_GROWTH`` times as large as all before it together. A value's fate
    depends on earlier kept values alone, so a block is first matched with the values kept
    so far; only what is left is joined with itself and walked (D3). Work grows with
    values x kept values: templated names, where nearly all pairs match, keep few. Each
    block's results are checkpointed, so a lost executor re-runs one block at most.

    Of more than ``WALK_WINDOW`` short values, what is left of a block is walked in windows as long as these keep few:
    the first window by itself (``window_matches``), the rest after losing what the window's kept values match.
    Varied values, which make few edges, are joined and walked in rounds as before.
    """
    spark = nodes.sparkSession
    found: list[DataFrame] = []
    pairs = rounds = candidates = 0
    used: set[str] = set()
    windows = n_values > WALK_WINDOW <= first_block
    alike = False

    def left_of(block: DataFrame, before: DataFrame) -> DataFrame:
        """The values of a block that no value kept before matches."""
        nonlocal pairs, candidates
        info: dict = {}
        hits, n = first_partners(block, threshold, before, info)
        candidates += info["candidates"]
        used.add(info["strategy"])
        pairs += n
        if not n:
            return block
        found.append(hits)
        return staged(block.join(hits.select(F.col("rank_j").alias("rank")), "rank", "left_anti"), "walk-block")

    def kept_of(block: DataFrame, keys: DataFrame | None = None, fits: bool = False) -> DataFrame:
        """The values kept of a block that no value before it matches. A block whose values match
        one another too often is taken in parts: most of the second falls to what the first keeps.
        ``keys`` are the block's stored hashes, ``fits`` says that their join was counted."""
        nonlocal pairs, rounds, candidates, alike
        info: dict = {}
        stats = short_stats(block, threshold)
        n_block = sum(stats.counts.values()) if stats is not None else block.count()
        if n_block < 2:
            return block
        if windows and stats is not None and (alike or n_block <= WALK_WINDOW):
            if n_block > WALK_WINDOW:
                # the sketch may miss by as many ranks as are left out
                cut = block.approxQuantile("rank", [0.9 * WALK_WINDOW / n_block], 0.1 * WALK_WINDOW / n_block)[0]
                first = staged(kept_of(block.where(F.col("rank") <= cut)), "walk-kept")
                return first.unionByName(kept_of(left_of(block.where(F.col("rank") > cut), first)))
            hits, n = staged_counted(window_matches(block, threshold), "window-matches")
            alike = n_block - n <= ALIKE * n_block
            used.add("window")
            pairs += n
            candidates += n
            rounds += 1
            found.append(hits)
            return block.join(hits.select(F.col("rank_j").alias("rank")), "rank", "left_anti")
        limit = EDGE_ROWS_MAX if n_block > min(first_block, SPLIT_FROM) and not fits else None
        edges = similarity_edges(block, threshold, info=info, max_join_rows=limit, stats=stats, keys=keys)
        if edges is None:
            cuts = block.approxQuantile("rank", list(SPLIT_AT), 0.001)
            rows = join_rows_below(info["keys"], cuts)
            low = [k for k, n in enumerate(rows) if n <= EDGE_ROWS_MAX]
            cut = cuts[low[-1] if low else 0]
            first = staged(kept_of(block.where(F.col("rank") <= cut), info["keys"].where(F.col("rank") <= cut), bool(low)), "walk-kept")
            return first.unionByName(kept_of(left_of(block.where(F.col("rank") > cut), first)))
        edges, n = staged_counted(edges.select("rank_i", "rank_j", "similarity"), "similarity-edges")
        candidates += info["candidates"]
        used.add(info["strategy"])
        pairs += n
        if not n:
            return block
        surv = greedy_survivors(edges.select("rank_i", "rank_j"))
        rounds += surv.rounds
        # what a kept value matches later on is dropped, and nothing else is
        found.append(staged(first_matches(edges.join(surv.dropped.withColumnRenamed("rank", "rank_i"), "rank_i", "left_anti")),
                            "first-kept"))
        return block.join(surv.dropped, "rank", "left_anti")

    kept: DataFrame | None = None
    start, size = 0, first_block
    while start < n_values:
        block = nodes.select("rank", "value").where((F.col("rank") > start) & (F.col("rank") <= start + size))
        more = kept_of(block if kept is None else left_of(block, kept))
        kept = more if kept is None else kept.unionByName(more)
        start, size = start + size, max(size, BLOCK_GROWTH * (start + size))
        if start < n_values:
            kept = staged(kept, "walk-kept")
    if not found:
        found = [spark.createDataFrame([], "rank_i long, rank_j long, similarity double")]
    matches = found[0]
    for part in found[1:]:
        matches = matches.unionByName(part)
    if len(found) > 1:                                  # later plans read one table, not one of each block
        matches = staged(matches, "walk-matches")
    return Walk(matches, pairs, rounds, candidates, "+".join(sorted(used)))


def fuzzy_dedup(df: DataFrame, col: str, threshold: float = DEFAULT_THRESHOLD,
                max_values: int | None = DEFAULT_MAX_VALUES,
                first_block: int = FIRST_BLOCK, order_col: str | None = None) -> FuzzyResult:
    """Drop every row whose ``col`` value is a near copy of an earlier kept value.

    Values are ranked by count; ``order_col`` ranks equally frequent ones by where they are first seen.
    """
    spark = df.sparkSession
    if col not in df.columns:          # P5
        empty = spark.createDataFrame([], "original string, duplicate string, similarity double, "
                                          "rank_i long, rank_j long")
        return FuzzyResult(df, 0, empty, 0, 0, 0, spark.createDataFrame([], "value string, count long"))
    ensure_checkpoint_dir(spark)
    nodes = ranked_values(df, col, max_values, order_col)
    if max_values is not None:
        nodes = nodes.checkpoint()
    n_values = nodes.count()
    walk = greedy_walk(nodes, n_values, threshold, first_block)
    dropped = (nodes.join(walk.matches.select(F.col("rank_j").alias("rank")), "rank")
               .select("value", "count", "rank")).checkpoint()
    stats = dropped.agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("rows"),
                        F.sum(F.octet_length("value")).alias("bytes")).first()
    removed = int(stats["rows"] or 0)
    small = (stats["bytes"] or 0) + 16 * (stats["n"] or 0) <= DROP_BYTES     # measured

    drop_side = dropped.select(F.col("value").alias("__drop_value"))
    if small:
        drop_side = F.broadcast(drop_side)
    table = df.join(drop_side, _c(col).cast("string") == F.col("__drop_value"), "left_anti") if stats["n"] else df

    # texts are joined to the one row per dropped value
    originals = nodes.select(F.col("rank").alias("rank_i"), F.col("value").alias("original"))
    duplicates = dropped.select(F.col("rank").alias("rank_j"), F.col("value").alias("duplicate"))
    if small:
        duplicates = F.broadcast(duplicates)
    matches = (walk.matches.join(duplicates, "rank_j").join(originals, "rank_i")
               .select("original", "duplicate", "similarity", "rank_i", "rank_j"))
    return FuzzyResult(table, removed, matches, n_values, walk.pairs, walk.rounds,
                       dropped.select("value", "count"), walk.candidates, walk.strategy)
