"""Operator 12: hard negatives by maximum inner product, with LEMP-style coordinate pruning.

Rows are ordered by decreasing length (Euclidean norm) and cut into buckets of bounded size. A
bucket holds its integer vectors and, for each coordinate, the bucket's rows sorted by their
normalised value there. For an anchor and a score wanted at least, a bucket needs the cosine
``wanted / (anchor length * longest row)``; above 1 the whole bucket is passed over. Otherwise the
angle between row and anchor is bounded, so on each focus coordinate (the anchor's largest ones)
a row's value lies in a feasible range, found by binary search in the sorted list. The shortest
list is intersected with the other focus ranges, and only what is left is scored exactly.

Two searches use it: the five best rows of the anchor's own label (the wanted score is the fifth
best met so far), then, for each of these positives, the best rows of other labels whose score
lies between ``LOW`` percent of the positive's and the positive's own.

Anchors are a stated query set (ids divisible by ``every``); they travel in packed blocks of at
most ``BLOCK`` to the buckets, and a bucket with a block is one row of a task, so no group grows
with the table. Each pair of bucket and anchor returns at most five rows a positive.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no
part; a shorter vector counts as padded with zeros (the empty one is the zero vector); equal
scores are ordered by smaller id, and rows that repeat an id are rows of their own: an anchor's
other rows are all rows but itself. Two anchor rows with one id are two anchors, whose results
are both returned. A positive score below zero leaves an empty window. Scores are exact
while they fit 64 bits. Columns other than ``vec_id``, ``embedding`` and ``label`` are never read.
An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import stored

#: Fixed values of the contract.
EVERY, POSITIVES, NEGATIVES, LOW, SCALE, LABELS = 100, 5, 5, 80, 256, 10
#: Rows of a bucket, anchors of a block, focus coordinates of an anchor.
BUCKET, BLOCK, FOCUS = 8192, 512, 3
#: Cells (rows x coordinates) of a bucket at most, so that long vectors make smaller buckets.
CELLS = 1 << 21
#: Same-label rows scored first, to have a score that the others must reach.
FIRST = 32
#: Slack of the cosine bounds for rounding.
EPS = 1e-9

_BUCKETS = "lane int, bucket long, dims int, longest double, ids binary, labels binary, vecs binary"
_BLOCKS = "block long, dims int, ids binary, labels binary, keys binary, vecs binary"
_FOUND = "block long, key long, anchor_id long, label long, row_key long, row_id long, score long"
_PAIRS = "key long, anchor_id long, positive_key long, positive_id long, positive_score long, negative_id long, negative_score long"


def vectors(emb: DataFrame, moved: Column | None = None) -> DataFrame:
    """(vec_id, label, v bigint array, norm) of the rows that take part; ``moved`` marks labels to move on by one."""
    x = F.col("embedding")
    rows = emb.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                      x.cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
                      & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
    if moved is not None:
        rows = rows.withColumn("label", F.when(moved, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    rows = rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))
    return rows.withColumn("norm", F.aggregate(
        "v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"), F.sqrt))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix, padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lens = np.diff(column.offsets.to_numpy())
    if len(lens) and (lens == dims).all():
        return flat.reshape(len(lens), dims)
    out = np.zeros((len(lens), dims), np.int64)
    rows = np.repeat(np.arange(len(lens)), lens)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def _cut(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Arrow batches of one partition, in pieces of at most ``rows``."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(rows - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            n, at = n + take, at + take
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _small(m: np.ndarray) -> bytes:
    """A width byte and the integers in the narrowest width that holds them."""
    low, high = (int(m.min()), int(m.max())) if m.size else (0, 0)
    for code, kind in ((2, np.int16), (4, np.int32)):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return bytes([code]) + m.astype(kind).tobytes()
    return bytes([8]) + m.astype(np.int64).tobytes()


def _wide(data: bytes, dims: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.int64}[data[0]]
    return np.frombuffer(data, kind, offset=1).astype(np.int64).reshape(-1, dims)


def _norms(vecs: np.ndarray) -> np.ndarray:
    wide = vecs.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", wide, wide))


def _unit(vecs: np.ndarray) -> np.ndarray:
    norms = _norms(vecs)
    return vecs / np.where(norms == 0, 1, norms)[:, None]


def _build(dims: int, bucket: int, lanes: int):
    """Buckets from a partition sorted by decreasing length; the lane is the partition's number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for i, t in enumerate(_cut(batches, bucket)):
            vecs = _matrix(t.column("v").combine_chunks(), dims)
            yield pa.RecordBatch.from_pylist([{
                "lane": part % lanes, "bucket": (part << 32) + i, "dims": dims, "longest": float(_norms(vecs).max()),
                "ids": t.column("vec_id").to_numpy().tobytes() + t.column("key").to_numpy().tobytes(),
                "labels": t.column("label").to_numpy().tobytes(),
                "vecs": _small(vecs)}], schema=_arrow(_BUCKETS))
    return run


def _pack(dims: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for i, t in enumerate(_cut(batches, block)):
            yield pa.RecordBatch.from_pylist([{
                "block": (part << 32) + i, "dims": dims, "ids": t.column("vec_id").to_numpy().tobytes(),
                "labels": t.column("label").to_numpy().tobytes(), "keys": t.column("key").to_numpy().tobytes(),
                "vecs": _small(_matrix(t.column("v").combine_chunks(), dims))}], schema=_arrow(_BLOCKS))
    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


class Bucket:
    """One bucket of the index, as a task reads it; sorted lists of the coordinates in use are made once."""

    def __init__(self, row: dict):
        self.dims, self.longest = row["dims"], row["longest"]
        self.ids, self.keys = np.frombuffer(row["ids"], np.int64).reshape(2, -1)
        self.labels = np.frombuffer(row["labels"], np.int64)
        self.vecs = _wide(row["vecs"], self.dims)
        self.norms, self.unit = _norms(self.vecs), _unit(self.vecs)
        self.float = self.vecs.astype(np.float64)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.by_label = {int(v): np.flatnonzero(self.labels == v) for v in np.unique(self.labels)}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, values) of one coordinate, by increasing value."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def scores(self, rows: np.ndarray, anchor: np.ndarray, length: float) -> np.ndarray:
        """Exact inner products: in doubles where every partial sum is an integer below 2^53."""
        if length * self.longest < 2.0 ** 52:
            return (self.float[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vecs[rows] @ anchor

    def feasible(self, anchor: np.ndarray, length: float, wanted: float) -> np.ndarray | None:
        """Rows that may score ``wanted`` or more; None: all of them may."""
        if wanted <= 0:
            return None
        if length == 0 or self.longest == 0:
            return np.empty(0, np.int64)
        need = wanted / (length * self.longest)
        if need > 1 + EPS:
            return np.empty(0, np.int64)
        span = np.arccos(min(1.0, max(-1.0, need - EPS)))
        unit = anchor / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        ranges = []
        for f in focus:
            angle = np.arccos(min(1.0, max(-1.0, float(unit[f]))))
            low = np.cos(min(np.pi, angle + span)) - EPS
            high = np.cos(max(0.0, angle - span)) + EPS
            lo, hi = np.searchsorted(self.sorted_list(int(f))[1], [low, np.nextafter(high, 2)])
            ranges.append((int(hi - lo), int(lo), int(hi), int(f), low, high))
        ranges.sort()
        _, lo, hi, f, _, _ = ranges[0]
        rows = self.lists[f][0][lo:hi]
        for _, _, _, g, low, high in ranges[1:]:
            values = self.unit[rows, g]
            rows = rows[(values >= low) & (values <= high)]
        return rows[self.norms[rows] * (length * (1 + EPS)) >= wanted]      # a row's own length may already be too short


def _best(rows: np.ndarray, scores: np.ndarray, bucket: Bucket, k: int) -> np.ndarray:
    """Positions of the ``k`` best of ``rows``: higher scores, then smaller ids, then keys."""
    if len(rows) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= bar)
    else:
        near = np.arange(len(rows))
    return near[np.lexsort((bucket.keys[rows[near]], bucket.ids[rows[near]], -scores[near]))][:k]


def positives_of(bucket: Bucket, anchor: np.ndarray, key: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best other rows of the anchor's label in one bucket, and their scores."""
    own = bucket.by_label.get(label, np.empty(0, np.int64))
    own = own[bucket.keys[own] != key]
    length = float(np.sqrt(np.dot(anchor.astype(np.float64), anchor.astype(np.float64))))
    head = own[:max(FIRST, k)]
    scores = bucket.scores(head, anchor, length)
    if len(own) > len(head):
        wanted = int(np.sort(scores)[-k])
        rest = bucket.feasible(anchor, length, wanted)
        if rest is None:
            rows = own
        else:
            rest = rest[(bucket.labels[rest] == label) & (bucket.keys[rest] != key)]
            rows = np.union1d(head, rest)
        scores = bucket.scores(rows, anchor, length)
    else:
        rows = head
    at = _best(rows, scores, bucket, k)
    return rows[at], scores[at]


def negatives_of(bucket: Bucket, anchor: np.ndarray, label: int, bars: np.ndarray, k: int, low: int
                 ) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each positive score of ``bars``, the ``k`` best rows of other labels in its window."""
    length = float(np.sqrt(np.dot(anchor.astype(np.float64), anchor.astype(np.float64))))
    usable = bars[bars >= 0]
    none = (np.empty(0, np.int64), np.empty(0, np.int64))
    if not len(usable):
        return [none] * len(bars)
    rows = bucket.feasible(anchor, length, low * float(usable.min()) / 100)
    rows = np.arange(len(bucket.ids)) if rows is None else rows
    rows = rows[bucket.labels[rows] != label]
    scores = bucket.scores(rows, anchor, length)
    out = []
    for bar in bars:
        if bar < 0:
            out.append(none)
            continue
        # low * bar <= 100 * score, in whole numbers
        inside = np.flatnonzero((scores >= -((-low * int(bar)) // 100)) & (scores <= bar))
        at = inside[_best(rows[inside], scores[inside], bucket, k)]
        out.append((rows[at], scores[at]))
    return out


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Bucket]]:
    """Joined rows with their bucket; the last bucket is kept, since its blocks follow one another."""
    last, bucket = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != last:
                last, bucket = row["bucket"], Bucket(row)
            yield row, bucket


def _search_positives(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_FOUND)
        for row, bucket in _pairs_of(batches):
            keys, ids, labels = (np.frombuffer(row[c], np.int64) for c in ("a_keys", "a_ids", "a_labels"))
            out: list[list[int]] = [[] for _ in schema]
            for key, a, label, v in zip(keys, ids, labels, _wide(row["a_vecs"], bucket.dims), strict=True):
                rows, scores = positives_of(bucket, v, int(key), int(label), k)
                n = len(rows)
                for column, values in zip(out, ([row["block"]] * n, [key] * n, [a] * n, [label] * n, bucket.keys[rows],
                                                bucket.ids[rows], scores), strict=True):
                    column.extend(int(x) for x in values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
    return run


def _search_negatives(k: int, low: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(_PAIRS)
        for row, bucket in _pairs_of(batches):
            vecs = _wide(row["a_vecs"], bucket.dims)
            labels = np.frombuffer(row["a_labels"], np.int64)
            at = {int(x): i for i, x in enumerate(np.frombuffer(row["a_keys"], np.int64))}
            found: dict[int, list[dict]] = {}
            for p in row["positives"]:
                found.setdefault(p["key"], []).append(p)
            out: list[list[int]] = [[] for _ in schema]
            for key, positives in found.items():
                i = at[key]
                bars = np.array([p["score"] for p in positives], np.int64)
                for p, (rows, scores) in zip(positives, negatives_of(bucket, vecs[i], int(labels[i]), bars, k, low), strict=True):
                    for r, s in zip(rows, scores, strict=True):
                        for column, value in zip(out, (key, p["anchor_id"], p["row_key"], p["row_id"], p["score"],
                                                       int(bucket.ids[r]), int(s)), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)
    return run


def mine(emb: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
         moved: Column | None = None, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all anchors and positives."""
    rows = stored(vectors(emb, moved).withColumn("key", F.monotonically_increasing_id()), "vectors")  # keys are fixed here
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"),
                    F.coalesce(F.sum((F.col("vec_id") % every == 0).cast("long")), F.lit(0)).alias("anchors")).first()
    dims = max(1, size["dims"])
    bucket = max(1, min(bucket, CELLS // dims))
    lanes = max(1, -(-size["n"] // bucket))
    columns = ["vec_id", "key", "label", "v"]
    by_length = rows.repartitionByRange(lanes, F.col("norm").desc(), "key").sortWithinPartitions(F.col("norm").desc(), "key")
    index = stored(by_length.select(*columns).mapInArrow(_build(dims, bucket, lanes), _BUCKETS), "buckets")
    anchors = rows.where(F.col("vec_id") % every == 0).repartitionByRange(max(1, -(-size["anchors"] // block)), "key")
    packed = stored(anchors.select(*columns).mapInArrow(_pack(dims, block), _BLOCKS), "anchors").select(
        "block", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "keys", "vecs")])

    def meet(blocks: DataFrame) -> DataFrame:
        """Every block with every bucket: the stated query set against all rows, joined lane by lane."""
        sent = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        return index.repartition(lanes, "lane").join(sent.repartition(lanes, "lane").hint("merge"), "lane")

    found = meet(packed).mapInArrow(_search_positives(positives), _FOUND)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "row_id", "row_key")
    best = stored(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")
    per_block = best.groupBy("block").agg(F.collect_list(F.struct("key", "anchor_id", "row_key", "row_id", "score"))
                                          .alias("positives"))         # at most ``positives`` for each anchor of a block
    pairs = meet(packed.join(per_block, "block")).mapInArrow(_search_negatives(negatives, low), _PAIRS)
    order = Window.partitionBy("key", "positive_key").orderBy(F.col("negative_score").desc(), "negative_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
