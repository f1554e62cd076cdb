"""Similarity self-join of ranked values, exact, without comparing all pairs.

Input ``nodes(rank long, value string)``; output ``edges(rank_i, rank_j, similarity)``
for every pair ``rank_i < rank_j`` whose D2 score reaches the threshold ``t``.

Filters (no false negatives; a pair needs ``LCS >= L = ceil(t (la + lb) / 200)``):

1. length: ``min(la, lb) >= L``, i.e. the partner length lies within
   ``[l t / (200 - t), l (200 - t) / t]``;
2. prefix filter on numbered characters (``e#3`` = third ``e``): the LCS is a
   common sub-multiset, so two matching values share at least ``L`` numbered
   characters, and at least ``alpha(l) = ceil(t l / (200 - t))`` over all partner
   lengths. With one global token order (rising frequency, then token), two
   values sharing ``alpha`` tokens share a token among their first
   ``l - alpha + 1`` ones. The bound is asymmetric: as the shorter side of a
   pair a value needs ``ceil(t l / 100)`` shared tokens, so its prefix there is
   only ``l - ceil(t l / 100) + 1`` long (about 15 % of it at t = 85, against
   26 % as the longer side). Shorter-side prefixes are joined to longer-side ones;
3. the same filter on numbered adjacent pairs of characters (``th#2``). An alignment of
   ``L`` matches has ``L - 1`` steps, of which at most ``la - L`` leave out characters of one
   text and ``lb - L`` of the other; the rest are shared pairs, at least
   ``3 L - 1 - (la + lb)``. That is positive from ``t`` > 66.7 and a length of a few
   characters on (55 % of the pairs at t = 85). Prefixes are longer, but pairs are
   far rarer than characters. With ``PAIRS_SHARED`` more tokens in each prefix, two values
   must share that many there and not just one, which unrelated texts rarely do. Each length
   band of the longer side uses the kind of token whose counted cost is less;
4. character-bag and pair-bag overlap and 5. the score itself with early exit, both
   in the verifying Arrow UDF (per batch).

Three exact candidate generators, chosen from counted sizes:

* band join, for node sets whose same-or-next-band pairs number at most
  ``BAND_PAIRS_MAX`` (always true under the 2,000-value cap): every pair in the
  same or the next length band that passes the length bound, salted so a band
  holding most values still spreads over many tasks. On long prose, whose
  characters are few and shared, this beats the prefix join by far (each pair
  shares hundreds of prefix tokens there, so the join emits ~200 rows per pair);
* deletion join, for short values that may differ in few characters: a pair matches
  exactly when deleting ``la - L`` characters of one and ``lb - L`` of the other can leave the
  same text, so values meet on the hashes of what such deletions leave (``deletion_pairs``).
  Nearly every row it makes is a match, however alike the values' characters are (templated
  names, numbers); its rows are counted from the lengths alone and it is taken when they
  are few against the band pairs;
* prefix join otherwise (uncapped value sets), described below, unless its
  exact raw output (counted per join key before joining) costs more than the
  band pairs would (``BAND_COST_RATIO``) and those stay under the counted bound
  ``BAND_PAIRS_COST_MAX``. All pairs of a band are thus only ever emitted in a
  counted, bounded number.

With ``against`` (earlier values), only pairs of one earlier and one new value are
made, by the same generators: the side a partner must come from is part of the join
key, so pairs inside either set are never formed.

Prefix join: tokens come from a vectorised Arrow UDF (code points, as in Python);
token frequencies are one ``groupBy`` (map-side combined); prefixes are a window
per value; candidates are an equi-join on ``(token, length band)`` where each
shorter-side row is sent to its own and the next band only, then de-duplicated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.functions.similarity import similarity
from dqspark.session import staged, staged_counted


def _numbered(v: str) -> np.ndarray:
    """``code point << 32 | occurrence`` for each character, in text order."""
    cp = np.frombuffer(v.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    order = np.argsort(cp, kind="stable")           # equal characters keep text order
    ranked = cp[order]
    idx = np.arange(len(cp))
    first = np.ones(len(cp), dtype=bool)
    first[1:] = ranked[1:] != ranked[:-1]
    run_start = np.maximum.accumulate(np.where(first, idx, 0))
    occurrence = np.empty(len(cp), dtype=np.int64)
    occurrence[order] = idx - run_start + 1
    return (cp << 32) | occurrence


@F.pandas_udf(T.ArrayType(T.LongType()))
def numbered_chars(values: pd.Series) -> pd.Series:
    """Numbered characters as exact longs: ``code point << 32 | occurrence``.

    ``"aba"`` -> ``[a#1, b#1, a#2]``; by code point, as Python strings count.
    Vectorised per text: a stable sort by code point numbers equal characters.
    """
    return pd.Series([None if v is None else _numbered(v) for v in values])


PAIR_REPEATS = (1 << 21) - 1    # a pair seen more often than this repeats its token, which only adds candidates


def _numbered_pairs(v: str) -> np.ndarray:
    cp = np.frombuffer(v.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    code = (cp[:-1] << 21) | cp[1:]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    idx = np.arange(len(code))
    first = np.ones(len(code), dtype=bool)
    first[1:] = ranked[1:] != ranked[:-1]
    run_start = np.maximum.accumulate(np.where(first, idx, 0))
    occurrence = np.empty(len(code), dtype=np.int64)
    occurrence[order] = np.minimum(idx - run_start, PAIR_REPEATS)
    return -1 - ((code << 21) | occurrence)


@F.pandas_udf(T.ArrayType(T.LongType()))
def numbered_pairs(values: pd.Series) -> pd.Series:
    """Numbered adjacent pairs of characters as negative longs, so they never meet a numbered character."""
    return pd.Series([None if v is None else _numbered_pairs(v) for v in values])


def length_band(length, threshold: float):
    """Geometric length band; partners of a value lie in its band or the next."""
    r = (200.0 - threshold) / threshold
    if r <= 1.0:          # threshold 100: partners have equal length
        return length.cast("long")
    # band width a hair over log(r): a partner at most r times longer is at most one
    # band up, with room for rounding in the logarithms
    width = math.log(r) * (1.0 + 1e-9)
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.lit(width)).cast("long")


def short_alpha(length, threshold: float):
    """Overlap needed when this value is the shorter side: ``ceil(t l / 100)``,
    since ``L = ceil(t (lx + ly) / 200) >= ceil(t lx / 100)`` for ``ly >= lx``."""
    return F.ceil(length.cast("double") * threshold / 100.0 - 1e-9).cast("long")


def alpha(length, threshold: float):
    """Overlap every partner of a value of this length must share."""
    return F.ceil(length.cast("double") * threshold / (200.0 - threshold) - 1e-9).cast("long")


def pair_alpha(length, threshold: float):
    """Adjacent pairs that every partner of a value of this length shares, from
    ``3 L - 1 - (la + lb)`` with the shortest partner (``t`` > 66.7)."""
    return F.ceil(length.cast("double") * (3 * threshold - 200.0) / (200.0 - threshold) - 1.0 - 1e-9).cast("long")


def short_pair_alpha(length, threshold: float):
    """The same when this value is the shorter side (its partner at least as long)."""
    return F.ceil(length.cast("double") * (3 * threshold - 200.0) / 100.0 - 1.0 - 1e-9).cast("long")


def pairs_bound_band(band, threshold: float):
    """Whether both bounds above are positive for every pair whose longer side lies in ``band``.

    The shorter side is then at least as long as the lower end of the band before.
    """
    if threshold <= 200.0 / 3:
        return F.lit(False)
    r = (200.0 - threshold) / threshold
    shortest = (band - 1).cast("double") if r <= 1.0 else F.exp((band - 1) * F.lit(math.log(r)))
    return (shortest * (1 - 1e-6) * (3 * threshold - 200.0) / 100.0 > 1.001) & \
        (shortest * (1 - 1e-6) * (3 * threshold - 200.0) / (200.0 - threshold) > 1.001)


def _parallelism(spark) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def _old(df: DataFrame):
    """Whether a value is one of the earlier ones; all are partners of each other without that column."""
    return F.col("old") if "old" in df.columns else F.lit(False)


def _wanted(df: DataFrame):
    """The side that a value's partners come from."""
    return ~F.col("old") if "old" in df.columns else F.lit(False)


def candidate_pairs(nodes: DataFrame, threshold: float, n_nodes: int | None = None,
                    max_join_rows: int | None = None, tokens: str = "auto",
                    info: dict | None = None) -> tuple[DataFrame | None, int]:
    """Pairs (rank_i < rank_j) passing the length and prefix filters; nodes with a boolean
    column ``old`` only pair across it.

    ``tokens``: ``"chars"``, ``"pairs"`` (adjacent pairs wherever their bound is positive) or
    ``"auto"``, which counts the join's exact output (before grouping) of both kinds in each
    length band from per-key counts and takes the cheaper: its rows, and ``BAND_COST_RATIO`` for each
    candidate, of which there are at most rows / tokens shared and at most the band's pairs.
    Each kind gives a superset of the matches.

    Returns the pairs (checkpointed: later stages and retries start from them)
    and their number. Tokens and prefixes are each used more than once and are persisted
    for the duration of this call, so the tokenizing UDFs run once per value.
    With ``max_join_rows``, ``(None, rows)`` is returned when the counted output exceeds it.
    ``info``, when given, receives the counted join rows by kind, and those of the choice.
    """
    t = float(threshold)
    if not 0 < t <= 100:
        raise ValueError("threshold must be in (0, 100]")
    if tokens not in ("auto", "chars", "pairs"):
        raise ValueError("tokens must be auto, chars or pairs")
    spark = nodes.sparkSession
    par = _parallelism(spark)
    n_nodes = n_nodes if n_nodes is not None else nodes.count()
    with_pairs = tokens != "chars" and t > 200.0 / 3
    array = F.concat(numbered_chars("value"), numbered_pairs("value")) if with_pairs else numbered_chars("value")
    # spread the tokenizing UDF; ranked nodes may arrive in a single partition
    v = (nodes.repartition(max(par, -(-n_nodes // 2000)))
         .select("rank", "value", F.length("value").alias("len"), _old(nodes).alias("old"),
                 _wanted(nodes).alias("want"))
         .withColumn("band", length_band(F.col("len"), t)))
    toks = v.select("rank", "len", "band", "old", "want", F.explode(array).alias("token")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        freq = toks.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
        w = Window.partitionBy("rank", "pair").orderBy("freq", "token")
        # a value's long prefix serves it as the longer side of a pair, its short
        # prefix as the shorter side (see short_alpha); there are len - 1 adjacent pairs
        size = F.when(F.col("pair"), F.col("len") - 1).otherwise(F.col("len"))
        long_alpha, low_alpha = alpha(F.col("len"), t), short_alpha(F.col("len"), t)
        if with_pairs:
            long_alpha = F.when(F.col("pair"), pair_alpha(F.col("len"), t)).otherwise(long_alpha)
            low_alpha = F.when(F.col("pair"), short_pair_alpha(F.col("len"), t)).otherwise(low_alpha)
        # of o shared tokens, all but the last alpha - more lie in a prefix of size - alpha + more
        more, low_more = F.lit(1), F.lit(1)
        if with_pairs:
            more = F.when(F.col("pair"), F.greatest(F.lit(1), F.least(F.lit(PAIRS_SHARED), long_alpha))).otherwise(more)
            low_more = F.when(F.col("pair"), F.greatest(F.lit(1), F.least(F.lit(PAIRS_SHARED), low_alpha))).otherwise(low_more)
        prefix = (toks.join(freq, "token")
                  .withColumn("pair", F.col("token") < 0)
                  .withColumn("o", F.row_number().over(w))
                  .withColumn("long", F.col("o") <= size - long_alpha + more)
                  .withColumn("short", F.col("o") <= size - low_alpha + low_more)
                  .withColumn("slack_y", long_alpha - more)
                  .withColumn("slack_x", low_alpha - low_more)
                  .where("long or short")
                  .select("rank", "len", "band", "old", "want", "token", "pair", "long", "short",
                          "slack_x", "slack_y")
                  .persist(StorageLevel.MEMORY_AND_DISK))
        try:
            longer = prefix.where("long").select(
                "token", "pair", F.col("band").alias("b"), F.col("old").alias("side"),
                F.col("rank").alias("rank_y"), F.col("len").alias("len_y"), "slack_y")
            shorter = prefix.where("short").select(
                "token", "pair", F.col("want").alias("side"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("b"),
                F.col("rank").alias("rank_x"), F.col("len").alias("len_x"), "slack_x")
            if with_pairs:          # adjacent pairs only where their bounds are positive
                bound = pairs_bound_band(F.col("b"), t)
                longer, shorter = longer.where(~F.col("pair") | bound), shorter.where(~F.col("pair") | bound)
            keys = ["token", "pair", "b", "side"]
            choice = None
            if max_join_rows is not None or with_pairs:
                by_band = (shorter.groupBy(*keys).agg(F.count(F.lit(1)).alias("s"))
                           .join(longer.groupBy(*keys).agg(F.count(F.lit(1)).alias("l")), keys, "full")
                           .groupBy("b").agg(
                               F.coalesce(F.sum(F.when(~F.col("pair"), F.col("s") * F.col("l"))), F.lit(0)).alias("chars"),
                               F.coalesce(F.sum(F.when(F.col("pair"), F.col("s") * F.col("l"))), F.lit(0)).alias("pairs"))
                           .withColumn("use", pairs_bound_band(F.col("b"), t) if with_pairs else F.lit(False)))
                if tokens == "auto" and with_pairs:
                    # pairs of the band: within it each is met from both sides
                    near = F.explode(F.array(F.struct(F.col("band").alias("b"), F.lit(0.5).alias("share")),
                                             F.struct((F.col("band") + 1).alias("b"), F.lit(1.0).alias("share"))))
                    x_side = (v.select(near.alias("n"), F.col("want").alias("side")).select("n.*", "side")
                              .groupBy("b", "side").agg(F.sum("share").alias("x")))
                    most = (v.groupBy(F.col("band").alias("b"), F.col("old").alias("side")).agg(F.count(F.lit(1)).alias("y"))
                            .join(x_side, ["b", "side"]).groupBy("b").agg(F.sum(F.col("x") * F.col("y")).alias("most")))
                    most_pairs = F.coalesce(F.col("most"), F.lit(0))
                    cost_chars = F.col("chars") + BAND_COST_RATIO * F.least(F.col("chars"), most_pairs)
                    cost_pairs = F.col("pairs") + BAND_COST_RATIO * F.least(F.col("pairs") / PAIRS_SHARED, most_pairs)
                    by_band = by_band.join(most, "b", "left").withColumn("use", F.col("use") & (cost_pairs < cost_chars))
                # one small row per length band
                choice = by_band.withColumn("rows", F.when(F.col("use"), F.col("pairs")).otherwise(F.col("chars"))).checkpoint()
                counted = choice.agg(F.sum("chars"), F.sum(F.when(pairs_bound_band(F.col("b"), t), F.col("pairs"))
                                                           .otherwise(F.col("chars"))), F.sum("rows")).first()
                if info is not None:
                    info.update(join_rows_chars=int(counted[0] or 0), join_rows_pairs=int(counted[1] or 0),
                                join_rows=int(counted[2] or 0))
                if max_join_rows is not None and (counted[2] or 0) > max_join_rows:
                    return None, int(counted[2])
            if choice is not None:
                chosen = choice.select("b", F.col("use").alias("pair"))
                longer, shorter = longer.join(chosen, ["b", "pair"]), shorter.join(chosen, ["b", "pair"])
            hi = (200.0 - t) / t
            both = F.col("len_x") + F.col("len_y")
            least = F.ceil(both.cast("double") * t / 200.0 - 1e-9).cast("long")        # matches needed
            overlap = F.when(F.col("pair"), 3 * least - 1 - both).otherwise(least)     # tokens shared by a match
            # x is the shorter side (of equal lengths the lower rank); the longer side lies in x's
            # band or the next
            shorter_side = ((F.col("len_x") < F.col("len_y"))
                            | ((F.col("len_x") == F.col("len_y")) & (F.col("rank_x") < F.col("rank_y"))))
            pairs = (shorter.join(longer, keys)
                     .where(shorter_side & (F.col("len_y") <= F.col("len_x") * hi + 1e-9))
                     .select("rank_x", "rank_y", (overlap - F.greatest("slack_x", "slack_y")).alias("required"))
                     .groupBy("rank_x", "rank_y", "required").agg(F.count(F.lit(1)).alias("shared"))
                     .where(F.col("shared") >= F.col("required"))
                     .select(F.least("rank_x", "rank_y").alias("rank_i"),
                             F.greatest("rank_x", "rank_y").alias("rank_j"))
                     .checkpoint())
            n_pairs = pairs.count()
        finally:
            prefix.unpersist()
    finally:
        toks.unpersist()
    return pairs, n_pairs


PAIRS_SHARED = 8                  # adjacent pairs that two prefixes must share
BAND_PAIRS_MAX = 4_000_000        # band joins up to this many pairs replace the prefix join
# CPU per band pair (bag bound in Python) against per raw prefix-join row (shuffle,
# de-duplication), measured on documents at sf 0.1: about 15 us against 2.4 us
BAND_COST_RATIO = 6
BAND_PAIRS_COST_MAX = 40_000_000  # never more band pairs than this, whatever the cost check says
BAND_SALTS = 16                   # a band is split over this many tasks
BROADCAST_TEXT_BYTES = 8 << 20    # node texts measured below this size join the pairs without a shuffle
PAIRS_A_TASK = 20_000             # pairs verified by one task
LONG_TEXT_BYTES = 4096            # pairs of texts longer than this on average are spread one by one
LONG_TEXT_TASKS = 1024            # over this many tasks at most, or one for each PAIRS_A_TASK pairs
PAIRS_A_TASK_SHORT = 100_000      # the same where all texts are known to be short
ROW_BYTES = 200                   # of a broadcast row on the driver besides its text


def _banded(nodes: DataFrame, threshold: float) -> DataFrame:
    return (nodes.withColumn("len", F.length("value"))
            .withColumn("band", length_band(F.col("len"), threshold)))


def band_stats(banded: DataFrame) -> tuple[int, int, int]:
    """One small aggregate: (values, text bytes, band-join pairs), the pairs being
    ``sum c_b (c_b - 1) / 2 + c_b c_(b+1)`` over the length bands, or across ``old``
    ``sum o_b w_b + o_b w_(b+1) + w_b o_(b+1)``."""
    h = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.count_if(_old(banded)).alias("o"),
                                   F.sum(F.octet_length("value") + 16).alias("bytes"))
    up = h.select((F.col("band") - 1).alias("band"), F.col("c").alias("c_up"), F.col("o").alias("o_up"))
    c, o = F.col("c"), F.col("o")
    c_up, o_up = F.coalesce(F.col("c_up"), F.lit(0)), F.coalesce(F.col("o_up"), F.lit(0))
    if "old" in banded.columns:
        pairs = o * (c - o) + o * (c_up - o_up) + (c - o) * o_up
    else:
        pairs = c * (c - 1) / 2 + c * c_up
    row = (h.join(up, "band", "left")
           .agg(F.sum("c").alias("n"), F.sum("bytes").alias("bytes"), F.sum(pairs).alias("pairs"))
           .first())
    return int(row["n"] or 0), int(row["bytes"] or 0), int(row["pairs"] or 0)


def band_pairs(banded: DataFrame, threshold: float, salts: int = BAND_SALTS) -> DataFrame:
    """Pairs (rank_i < rank_j) in the same or next length band that pass the length bound.

    The shorter side (ties: lower rank) is sent to its own and the next band and to
    every salt; the longer side sits in its band under one salt. Each pair meets once.
    """
    hi = (200.0 - threshold) / threshold
    x = (banded.select(F.col("rank").alias("rank_x"), F.col("len").alias("len_x"), _wanted(banded).alias("side"),
                       F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("b"))
         .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    y = banded.select(F.col("rank").alias("rank_y"), F.col("len").alias("len_y"), F.col("band").alias("b"),
                      _old(banded).alias("side"),
                      F.pmod(F.xxhash64("rank"), F.lit(salts)).cast("int").alias("salt"))
    return (x.join(y, ["b", "salt", "side"])
            .where(((F.col("len_x") < F.col("len_y"))
                    | ((F.col("len_x") == F.col("len_y")) & (F.col("rank_x") < F.col("rank_y"))))
                   & (F.col("len_y") <= F.col("len_x") * hi + 1e-9))
            .select(F.least("rank_x", "rank_y").alias("rank_i"), F.greatest("rank_x", "rank_y").alias("rank_j")))


DELETION_LENGTH = 64              # longer values are not looked at for a deletion join
DELETION_KEYS = 5_000             # hashes of one value at most
DELETIONS_FROM = 200_000          # fewer band pairs than this are simply verified
HASHES_A_PAIR = 10                # hashes (about 0.3 us each) that cost as much as verifying one band pair, at most
DELETION_CELLS = 1 << 20          # hashes made at a time
KEY_BYTES = 64                    # of one hash in a broadcast table
BROADCAST_KEY_BYTES = 16 << 20    # hashes of the earlier values below this size are broadcast


@dataclass
class ShortStats:
    """Of values of at most ``DELETION_LENGTH`` characters, from one small aggregate."""
    counts: dict[tuple[int, bool], int]    # (length, old): values
    text_bytes: int
    old_bytes: int                         # of the earlier values
    band_pairs: int


def short_stats(nodes: DataFrame, threshold: float) -> ShortStats | None:
    """Counts by length, with the band join's pairs worked out from them (see ``band_stats``); None when
    some value is longer than ``DELETION_LENGTH``."""
    capped = F.least(F.length("value"), F.lit(DELETION_LENGTH + 1))
    rows = nodes.groupBy(capped.alias("len"), _old(nodes).alias("old")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 16).alias("bytes")).collect()
    if any(r["len"] > DELETION_LENGTH for r in rows):
        return None
    ratio = (200.0 - threshold) / threshold
    bands: dict[tuple[int, bool], int] = {}
    for r in rows:
        band = r["len"] if ratio <= 1.0 else math.floor(math.log(max(r["len"], 1)) / (math.log(ratio) * (1.0 + 1e-9)))
        bands[band, r["old"]] = bands.get((band, r["old"]), 0) + r["n"]
    across, pairs = "old" in nodes.columns, 0
    for (band, old), n in bands.items():
        if across:
            pairs += n * (bands.get((band + 1, not old), 0) + (bands.get((band, False), 0) if old else 0))
        else:
            pairs += n * (n - 1) // 2 + n * bands.get((band + 1, old), 0)
    return ShortStats({(r["len"], r["old"]): r["n"] for r in rows}, sum(r["bytes"] for r in rows),
                      sum(r["bytes"] for r in rows if r["old"]), pairs)


def deletion_plan(counts: dict[tuple[int, bool], int], threshold: float, across: bool) -> dict[tuple[int, bool], list[int]]:
    """How many characters a value of each length (and side) may lose so that a partner's text is left:
    one number for each number of matches ``L`` that a partner's length asks for."""
    plan: dict[tuple[int, bool], set[int]] = {}
    for n, old in counts:
        for m, other in counts:
            least = max(0, math.ceil(threshold * (n + m) / 200.0 - 1e-9))
            if (not across or old != other) and least <= min(n, m):
                plan.setdefault((n, old), set()).add(n - least)
    return {k: sorted(v) for k, v in plan.items()}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (each step can be undone, so different numbers stay different)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _deletion_hashes(points: np.ndarray, lost: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, wanted)`` of texts of one length (a row each) after every choice of ``lost`` deletions.

    A text's hash is the sum of its mixed characters times powers by place; what stands behind
    ``k`` deletions moves ``k`` places to the front, so a choice is a sum of ``lost + 1`` differences of
    running sums. Of a run of equal characters the first ones are deleted, other choices give the same text.
    """
    n, size = points.shape
    choices = np.array(list(combinations(range(size), lost)), np.int64).reshape(math.comb(size, lost), lost)
    with np.errstate(over="ignore"):
        letters = _mixed(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(0x9E6C63D0876A9A47))]), dtype=np.uint64)
        total = np.zeros((n, len(choices)), np.uint64)
        for k in range(lost + 1):
            sums = np.zeros((n, size + 1), np.uint64)
            np.cumsum(letters[:, k:] * power[:size - k], axis=1, out=sums[:, k + 1:])
            if k < lost:
                total += sums[:, choices[:, k]]
            else:
                total += sums[:, [size]]
            if k:
                total -= sums[:, choices[:, k - 1] + 1]
        hashes = _mixed(total + np.uint64(size - lost + 1) * np.uint64(0xD6E8FEB86659FD93))
    wanted = np.ones(total.shape, bool)
    same = np.zeros((n, size + 1), bool)
    same[:, 1:size] = points[:, 1:] == points[:, :-1]
    for k in range(lost):
        free = choices[:, k] > 0 if k == 0 else choices[:, k - 1] != choices[:, k] - 1
        wanted &= ~(same[:, choices[:, k]] & free)
    return hashes.view(np.int64), wanted


def _deletion_keys(plan: dict[tuple[int, bool], list[int]]):
    """Map (rank, value, old) batches to (rank, old, key) rows."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, olds = batch.column("rank").to_numpy(), batch.column("old").to_numpy(zero_copy_only=False)
            points = [np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32) for v in batch.column("value").to_pylist()]
            lens = np.array([len(p) for p in points], np.int64)
            for (size, old), losses in plan.items():
                rows = np.flatnonzero((lens == size) & (olds == old))
                step = max(1, DELETION_CELLS // max(math.comb(size, lost) for lost in losses))
                for at in range(0, len(rows), step):
                    part = rows[at:at + step]
                    grid = np.array([points[i] for i in part], np.uint32).reshape(len(part), size)
                    for lost in losses:
                        hashes, wanted = _deletion_hashes(grid, lost)
                        key = hashes[wanted]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(ranks[part], wanted.sum(1))), pa.array(np.full(len(key), old)), pa.array(key)],
                            names=["rank", "old", "key"])
    return keys


def _hashed(part: DataFrame, counts: dict[tuple[int, bool], int], plan: dict[tuple[int, bool], list[int]], rank: str) -> DataFrame:
    """``(key, rank)`` of what deletions leave of the values; ``counts`` says how many there are."""
    parts = max(_parallelism(part.sparkSession), -(-sum(counts.values()) // 20_000))
    return (part.select("rank", "value", _old(part).alias("old")).repartition(parts)
            .mapInArrow(_deletion_keys(plan), "rank long, old boolean, key long").select("key", F.col("rank").alias(rank)))


def _joined_across(nodes: DataFrame, counts: dict[tuple[int, bool], int], plan: dict[tuple[int, bool], list[int]]) -> DataFrame:
    """``(rank_x, rank_y)`` of an earlier and a new value, once for each hash they share."""
    early, late = _hashed(nodes.where("old"), counts, plan, "rank_x"), _hashed(nodes.where("not old"), counts, plan, "rank_y")
    size = sum(n * _keys_of(plan, k) for k, n in counts.items() if k[1]) * KEY_BYTES
    return late.join(F.broadcast(early) if size <= BROADCAST_KEY_BYTES else early, "key")


def join_rows_below(keys: DataFrame, cuts: list[float]) -> list[int]:
    """Rows that the join of ``keys`` with itself makes among the ranks up to each cut (one pass)."""
    below = [F.count_if(F.col("rank") <= c).alias(f"c{k}") for k, c in enumerate(cuts)]
    row = keys.groupBy("key").agg(*below).agg(
        *[F.sum(F.col(f"c{k}") * (F.col(f"c{k}") - 1) / 2) for k in range(len(cuts))]).first()
    return [int(x or 0) for x in row]


def deletion_pairs(nodes: DataFrame, counts: dict[tuple[int, bool], int], threshold: float,
                   max_join_rows: int | None = None, keys: DataFrame | None = None,
                   info: dict | None = None) -> tuple[DataFrame | None, int]:
    """Pairs (rank_i < rank_j) that share a text left by as many deletions as the threshold allows.

    Every match is one of them; others only share a hash by chance. Returns the pairs (stored)
    and their number; with ``max_join_rows``, ``(None, rows)`` when the join, counted from its keys, has more.
    ``keys``: the hashes of ``nodes`` where they are stored already; ``info`` receives those stored here.
    """
    plan = deletion_plan(counts, threshold, "old" in nodes.columns)
    if "old" in nodes.columns:
        joined = _joined_across(nodes, counts, plan)
    else:
        keys = staged(_hashed(nodes, counts, plan, "rank"), "deletion-keys") if keys is None else keys
        if info is not None:
            info["keys"] = keys
        if max_join_rows is not None:
            rows = join_rows_below(keys, [float("inf")])[0]
            if rows > max_join_rows:
                return None, rows
        joined = (keys.withColumnRenamed("rank", "rank_x").join(keys.withColumnRenamed("rank", "rank_y"), "key")
                  .where(F.col("rank_x") < F.col("rank_y")))
    return staged_counted(joined.select(F.least("rank_x", "rank_y").alias("rank_i"), F.greatest("rank_x", "rank_y").alias("rank_j"))
                          .distinct(), "deletion-pairs")


def _keys_of(plan: dict[tuple[int, bool], list[int]], k: tuple[int, bool]) -> int:
    return sum(math.comb(k[0], lost) for lost in plan.get(k, ()))


def _deletions_pay(stats: ShortStats, threshold: float, across: bool) -> bool:
    plan = deletion_plan(stats.counts, threshold, across)
    most = max((_keys_of(plan, k) for k in stats.counts), default=0)
    hashes = sum(n * _keys_of(plan, k) for k, n in stats.counts.items())
    return stats.band_pairs > DELETIONS_FROM and most <= DELETION_KEYS and hashes <= HASHES_A_PAIR * stats.band_pairs


def _across(nodes: DataFrame, against: DataFrame) -> DataFrame:
    return (against.select("rank", "value", F.lit(True).alias("old"))
            .unionByName(nodes.select("rank", "value", F.lit(False).alias("old"))))


def first_partners(nodes: DataFrame, threshold: float, against: DataFrame, info: dict) -> tuple[DataFrame, int]:
    """For each value of ``nodes`` that a value of ``against`` (of lower ranks) matches, the match of the lowest
    rank: stored ``(rank_i, rank_j, similarity)``, and their number.

    Values that share a deletion's hash match, but for a clash of hashes. So the lowest rank is taken while they are
    joined (combined in each task) and one pair a value is scored, not all of them. Should the score refuse one, or
    where no deletion join pays, all pairs are scored.
    """
    t = float(threshold)
    both = _across(nodes, against)
    stats = short_stats(both, t)
    if stats is not None and _deletions_pay(stats, t, True):
        counts, spark = stats.counts, nodes.sparkSession
        n_new = sum(n for (_, old), n in counts.items() if not old)
        n_old = sum(counts.values()) - n_new
        parts = max(_parallelism(spark), -(-n_new // PAIRS_A_TASK_SHORT))
        left = against.select(F.col("rank").alias("rank_i"), F.col("value").alias("value_i"))
        small = stats.old_bytes + ROW_BYTES * n_old <= BROADCAST_TEXT_BYTES
        lowest = (_joined_across(both, counts, deletion_plan(counts, t, True))
                  .groupBy(F.col("rank_y").alias("rank_j")).agg(F.min("rank_x").alias("rank_i")))
        scored = (lowest.repartition(parts, "rank_j")
                  .join(nodes.select(F.col("rank").alias("rank_j"), F.col("value").alias("value_j")), "rank_j")
                  .join(F.broadcast(left) if small else left, "rank_i")
                  .select("rank_i", "rank_j", similarity(F.col("value_i"), F.col("value_j"), t).alias("similarity")))
        seen = Observation()
        firsts = staged(scored.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("similarity") < t).alias("refused")),
                        "first-kept")
        if not seen.get["refused"]:
            n = int(seen.get["rows"])
            info.update(strategy="deletions", candidates=n)
            return firsts, n
    edges = similarity_edges(nodes, t, info=info, against=against, stats=stats)
    edges = staged(edges.select("rank_i", "rank_j", "similarity"), "similarity-edges")
    return staged_counted(first_matches(edges), "first-kept")


def first_matches(edges: DataFrame) -> DataFrame:
    """W2 on ranks: per later rank the smallest earlier one, with its score."""
    return (edges.groupBy("rank_j").agg(F.min(F.struct("rank_i", "similarity")).alias("m"))
            .select(F.col("m.rank_i").alias("rank_i"), "rank_j", F.col("m.similarity").alias("similarity")))


def similarity_edges(nodes: DataFrame, threshold: float, strategy: str = "auto",
                     info: dict | None = None, against: DataFrame | None = None,
                     max_join_rows: int | None = None, stats: ShortStats | None = None,
                     keys: DataFrame | None = None) -> DataFrame | None:
    """J1 + D2: ``(rank_i, rank_j, value_i, value_j, similarity)`` with similarity >= threshold.

    With ``against(rank, value)``, holding other ranks, only pairs of a value of ``nodes``
    and one of ``against``.

    ``strategy``: ``"band"``, ``"prefix"``, ``"deletions"`` or ``"auto"`` (deletion join when its
    counted hashes cost less than the band pairs, else band join when its counted pairs are at
    most ``BAND_PAIRS_MAX``). With ``max_join_rows``, None is returned when a deletion join of ``nodes`` with
    itself would make more rows: the caller splits its values then, and finds the stored hashes in ``info``; with ``keys`` (those
    of ``nodes``) none are made. ``stats`` are those of the same values where they are known. Candidates are sorted by ``rank_i``
    inside each partition so the verifier reuses a value's bit pattern and
    character counts across its partners; it applies the character-bag bound
    before the LCS. Texts are joined to the pairs by rank. ``info``, when
    given, receives the generator used and the candidate count (for the band
    join, its counted upper bound before the length check).
    """
    t = float(threshold)
    spark = nodes.sparkSession
    if strategy not in ("auto", "band", "prefix", "deletions"):
        raise ValueError("strategy must be auto, band, prefix or deletions")
    nodes = nodes.select("rank", "value") if against is None else _across(nodes, against)
    banded = _banded(nodes, t)
    stats = stats or short_stats(nodes, t)
    if stats is not None:
        n_nodes, text_bytes, n_band = sum(stats.counts.values()), stats.text_bytes, stats.band_pairs
    else:
        n_nodes, text_bytes, n_band = band_stats(banded)
    pairs, used = None, "prefix"
    if strategy == "deletions" and stats is None:
        raise ValueError(f"a deletion join needs values of at most {DELETION_LENGTH} characters")
    if strategy == "deletions" or (strategy == "auto" and stats is not None
                                   and (keys is not None or _deletions_pay(stats, t, against is not None))):
        pairs, n_pairs = deletion_pairs(nodes, stats.counts, t, max_join_rows, keys, info)
        if pairs is None:
            return None
        used = "deletions"
    if pairs is None and (strategy == "prefix" or (strategy == "auto" and n_band > BAND_PAIRS_MAX)):
        # the prefix join wins on short, varied values; on long texts of one
        # language its raw output can exceed the band pairs many times over
        limit = BAND_COST_RATIO * n_band if strategy == "auto" and n_band <= BAND_PAIRS_COST_MAX else None
        pairs, n_pairs = candidate_pairs(nodes, t, n_nodes, limit, info=info)
    if pairs is None:
        pairs, n_pairs, used = band_pairs(banded, t), n_band, "band"    # an upper bound of the count
    if info is not None:
        info.update(strategy=used, candidates=int(n_pairs), band_pairs=int(n_band), values=int(n_nodes))
    left = nodes.select(F.col("rank").alias("rank_i"), F.col("value").alias("value_i"))
    right = nodes.select(F.col("rank").alias("rank_j"), F.col("value").alias("value_j"))
    # verification is CPU-bound: size partitions by pair count (an explicit count
    # is not merged away by AQE); chunks of 256 partners of one value stay together
    # for the caches, and a value with very many partners still spreads out
    short = stats is not None                        # texts of one machine word: a few microseconds a pair
    parts = max(_parallelism(spark) * (1 if short else 4), -(-n_pairs // (PAIRS_A_TASK_SHORT if short else PAIRS_A_TASK)))
    partners = 256
    if text_bytes > LONG_TEXT_BYTES * n_nodes:       # seconds a pair: a value's partners are dealt out one by one
        parts, partners = max(parts, min(n_pairs, LONG_TEXT_TASKS)), 1
    spread = [F.col("rank_i"), F.floor(F.col("rank_j") / partners)]
    if text_bytes + ROW_BYTES * n_nodes <= BROADCAST_TEXT_BYTES:       # measured, not assumed: only ranks are shuffled
        cand = (pairs.repartition(parts, *spread).sortWithinPartitions("rank_i")
                .join(F.broadcast(left), "rank_i").join(F.broadcast(right), "rank_j"))
    else:
        cand = pairs.join(left, "rank_i").join(right, "rank_j").repartition(parts, *spread) \
            .sortWithinPartitions("rank_i")
    scored = cand.select("rank_i", "rank_j", "value_i", "value_j",
                         similarity(F.col("value_i"), F.col("value_j"), t).alias("similarity"))
    return scored.where(F.col("similarity") >= t)
