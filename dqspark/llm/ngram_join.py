"""Exact Jaccard join of 5-word shingle sets by prefix filter and prefix tree.

1. Documents with equal shingle sets are one class (a 128-bit hash of the sorted set).
2. Two sets that reach the threshold share a shingle among the first ``n - ceil(t n) + 1``
   of each, in any order that is the same for all sets. The order puts shingles of crowded
   buckets last: a count-min row of 2^20 counters, gathered from all documents, tells which.
   Only (shingle, class) rows of prefixes are shuffled; shingles held by one class end there.
3. Classes that share a prefix shingle are members of the cluster led by the smallest of
   them. Shingles with the same leader share one cluster, so a group of near copies with a
   hundred common shingles is compared about once, and no pair is ever written out.
4. Inside a cluster, parity bitmaps (one to two bits per shingle) bound the symmetric
   difference of two sets from below, which rules out most pairs without their sets. What is
   left connects classes to candidate groups.
5. The texts of a candidate group meet in blocks of at most ``BLOCK`` members. Their sets are
   stored in a prefix tree in the order of falling frequency, and each probe walks it with
   the partial overlap shared along common paths; a subtree is left when the overlap so far
   plus what remains cannot reach the threshold, or its sizes do not fit. Pairs already
   connected are skipped, so a group yields at most members - 1 links.
6. Links go to connected components; a component's id is its smallest doc_id.

Shingles are 64-bit hashes: a collision matters only inside one compared pair. Equality of
sets is judged on 128 bits.

Defined cases: null and blank texts have the empty set and are linked with nothing; a text
of fewer than five words is one shingle; equal texts share a component; repeated rows come
back repeated; a row without ``doc_id`` takes part, and its component is the smallest
``doc_id`` it is linked with, or null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import U64, WordHashes, doc_texts, mix64, slices, sorted_groups, stored
from dqspark.llm.components import components

WORDS = 5
#: Similarity in per cent: 100 * |x and y| >= PERCENT * |x or y|.
PERCENT = 80
BUCKETS, CHUNKS = 1 << 20, 64
#: A bucket is crowded so many standard deviations above the mean.
CROWDED = 6.0
#: Members of a block of the prefix-tree join, and of the bitmap filter.
BLOCK, FILTER_BLOCK = 256, 1024
#: Classes a task remembers to send their prefix only once (a saving, not a limit).
SEEN = 500_000
_NO_ID = (1 << 63) - 1


_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U64)


def shingle_sets(texts: list[str], cache: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of whole texts; A-Z is lower-cased, other letters are not.

    The shingles of all texts are hashed in one go; those that span two texts are not read.
    """
    split = [t.encode("utf-8", "replace").lower().split() for t in texts]
    h = cache.of([w for words in split for w in words])
    k = max(0, len(h) - WORDS + 1)
    s = np.zeros(k, U64)
    for j in range(WORDS):
        s += h[j:j + k] * _PLACE[j]
    s = mix64(s)
    out, at = [], 0
    for words in split:
        n = len(words)
        if n >= WORDS:
            own = np.sort(s[at:at + n - WORDS + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        else:
            out.append(np.array([xxhash.xxh64_intdigest(h[at:at + n].tobytes())], U64) if n else h[:0])
        at += n
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(s: np.ndarray) -> bytes:
    """Parity bits: bit ``hash mod b`` flips for each shingle, b the next power of two above the size."""
    bits = max(64, 1 << (len(s) - 1).bit_length()) if len(s) else 64
    return np.packbits(np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def set_rows(docs: DataFrame) -> DataFrame:
    """One pass over the texts. Per document (doc_id, t, n, k1, k2, bits): set size, class and
    bitmap, ``t`` a hash of the text. Per task also its bucket counts as (chunk, load) rows,
    each set it sees counted once.
    """
    width = BUCKETS // CHUNKS

    def run(batches):
        cache, seen, load = WordHashes(), set(), np.zeros(BUCKETS, np.uint32)
        for big in batches:
            for batch in slices(big, 128):
                sets = shingle_sets(batch["text"].to_pylist(), cache)
                keys = [set_key(s) for s in sets]
                fresh = []
                for s, key in zip(sets, keys, strict=True):
                    if key not in seen and len(s):
                        fresh.append(s)
                        if len(seen) < SEEN:
                            seen.add(key)
                if fresh:
                    np.add.at(load, (np.concatenate(fresh) % U64(BUCKETS)).astype(np.int64), 1)
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], batch["t"], pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                     pa.array([bitmap(s) for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    schema=_ROWS)
        none = lambda kind: pa.nulls(CHUNKS, kind)
        yield pa.RecordBatch.from_arrays(
            [none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.binary()),
             pa.array(range(CHUNKS), pa.int32()),
             pa.array([load[i * width:(i + 1) * width].tobytes() for i in range(CHUNKS)], pa.binary())], schema=_ROWS)

    return docs.mapInArrow(run, "doc_id long, t long, n long, k1 long, k2 long, bits binary, chunk int, load binary")


_ROWS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
                   ("bits", pa.binary()), ("chunk", pa.int32()), ("load", pa.binary())])


def crowding(loads: DataFrame) -> np.ndarray:
    """A class per bucket: 0, or 1 + log2 of how far its count stands out. 1 MB, whatever the input.

    The tasks that own a chunk add up the counters as they stream by.
    """
    width = BUCKETS // CHUNKS

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, load in zip(batch["chunk"].to_pylist(), batch["load"].to_pylist(), strict=True):
                sums.setdefault(chunk, np.zeros(width, np.int64))
                sums[chunk] += np.frombuffer(load, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(
            [x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "load"])

    total = np.zeros(BUCKETS, np.int64)
    for r in loads.repartition("chunk").mapInArrow(add, "chunk int, load binary").collect():   # 8 MB in all
        total[r["chunk"] * width:(r["chunk"] + 1) * width] = np.frombuffer(r["load"], np.int64)
    spread = max(1.0, float(np.sqrt(total.mean())))
    out = (total - total.mean()) / spread
    return np.where(out < CROWDED, 0, 1 + np.log2(np.maximum(out, 1))).astype(np.uint8)


def prefix_rows(docs: DataFrame, crowded: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(token, k1, hot): the prefix shingles of every class, once per task and class."""
    levels = docs.sparkSession.sparkContext.broadcast(crowded)

    def run(batches):
        cache, seen, level = WordHashes(), set(), levels.value
        for big in batches:
            for batch in slices(big, 128):
                tokens, keys, hot, lens = [np.zeros(0, U64)], [], [np.zeros(0, bool)], []
                for s in shingle_sets(batch["text"].to_pylist(), cache):
                    key = set_key(s)[0]
                    if not len(s) or key in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(key)
                    c = level[(s % U64(BUCKETS)).astype(np.int64)]
                    take = np.argsort(c, kind="stable")[:prefix_length(len(s), percent)]      # s is in hash order
                    tokens.append(s[take])
                    hot.append(c[take] > 0)
                    keys.append(key)
                    lens.append(len(take))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), lens)),
                     pa.array(np.concatenate(hot))], names=["token", "k1", "hot"])

    return docs.select("text").mapInArrow(run, "token long, k1 long, hot boolean")


def clusters(prefixes: DataFrame) -> DataFrame:
    """(leader, k1): classes that share a prefix shingle, under the smallest of them.

    Shingles of quiet buckets have few holders by construction, so a window gathers them;
    those of crowded buckets are reduced to their extremes first and joined back, which
    neither gathers a shingle's holders nor depends on how many there are.
    """
    same = Window.partitionBy("token")
    quiet = (prefixes.where("not hot").select("token", "k1")
             .withColumn("leader", F.min("k1").over(same)).withColumn("last", F.max("k1").over(same))
             .where("leader <> last").select("leader", "k1"))
    hot = prefixes.where("hot").select("token", "k1")
    ends = hot.groupBy("token").agg(F.min("k1").alias("leader"), F.max("k1").alias("last")).where("leader <> last")
    return quiet.unionByName(hot.join(ends, "token").select("leader", "k1")).distinct()


class PrefixTree:
    """Sets as rising rank sequences; a node holds a run of ranks shared by all sets below it."""

    def __init__(self, seqs: list[np.ndarray], sizes: list[int]):
        order = sorted(range(len(seqs)), key=lambda i: seqs[i].astype(">u4").tobytes())
        self.runs, self.kids, self.ends, self.low, self.high, self.longest = [], [], [], [], [], []
        stack = [(0, len(order), 0, -1)]
        while stack:
            lo, hi, depth, parent = stack.pop()
            first, last = seqs[order[lo]], seqs[order[hi - 1]]
            m = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:m] != last[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            node = len(self.runs)
            self.runs.append(first[depth:end])
            self.kids.append([])
            here = [sizes[order[i]] for i in range(lo, hi)]
            self.low.append(min(here))
            self.high.append(max(here))
            self.longest.append(max(len(seqs[order[i]]) for i in range(lo, hi)))
            if parent >= 0:
                self.kids[parent].append(node)
            i = lo
            while i < hi and len(seqs[order[i]]) == end:
                i += 1
            self.ends.append([order[j] for j in range(lo, i)])
            while i < hi:
                j, v = i, seqs[order[i]][end]
                while j < hi and seqs[order[j]][end] == v:
                    j += 1
                stack.append((i, j, end, node))
                i = j
        self.sizes = sizes

    def probe(self, mask: np.ndarray, below: np.ndarray, kept: int, n: int, percent: int, skip) -> list[int]:
        """Indices of sets similar to the probe (``mask`` over ranks, ``below`` counts its ranks
        under a rank, ``kept`` all of them, ``n`` its full size) that ``skip`` does not rule out."""
        found, stack = [], [(0, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            low, high = max(self.low[node], -(-percent * n // 100)), self.high[node]
            if high < low or 100 * n < percent * low:
                continue
            run = self.runs[node]
            if len(run):
                overlap += int(mask[run].sum())
                depth += len(run)
                rest = kept - int(below[run[-1] + 1])
            else:
                rest = kept
            most = overlap + min(rest, self.longest[node] - depth)
            if 100 * most < percent * (n + low - most):
                continue
            for i in self.ends[node]:
                size = self.sizes[i]
                if 100 * overlap >= percent * (n + size - overlap) and not skip(i):
                    found.append(i)
            stack.extend((k, overlap, depth) for k in self.kids[node])
        return found


class _Forest:
    """Union-find over a group's members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def join_group(sets: list[np.ndarray], left: list[int], right: list[int] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect every similar pair (left x right, or within left) of a group."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1                       # a shingle of one member adds to no overlap
    order = np.lexsort((values, -counts))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    n_shared = int(shared.sum())
    stops = np.cumsum([len(s) for s in sets])
    ranks = []
    for part in np.split(inverse, stops[:-1]):
        r = rank[part]
        ranks.append(np.sort(r[r < n_shared]))
    sizes = [len(s) for s in sets]
    tree = PrefixTree([ranks[i] for i in left], [sizes[i] for i in left])
    forest, links = _Forest(len(sets)), []
    mask = np.zeros(n_shared + 1, bool)
    for p in left if right is None else right:
        r = ranks[p]
        mask[r] = True
        below = np.zeros(n_shared + 2, np.int64)
        np.cumsum(mask, out=below[1:])
        for i in tree.probe(mask, below, len(r), sizes[p], percent, lambda i, p=p: forest.find(left[i]) == forest.find(p)):
            if left[i] != p and forest.join(left[i], p):
                links.append((left[i], p))
        mask[r] = False
    return links


def dealt_in_blocks(members: DataFrame, group: str, size: int) -> DataFrame:
    """Deal each group's members into blocks and send every block to each pair it is part of.

    Adds (lo, hi): the pair of blocks, and ``block``: the member's own. A group that fits one
    block is sent once.
    """
    sizes = members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    m = members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("k1", F.lit(3)), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")


def _fold(m: np.ndarray, words: int) -> np.ndarray:
    while m.shape[1] > words:
        half = m.shape[1] // 2
        m = m[:, :half] ^ m[:, half:]
    return m


def candidate_edges(n: np.ndarray, bits: list[bytes], left: np.ndarray, right: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes fit and whose bitmaps differ in few enough bits.

    A differing bit is at least one shingle that only one of the two holds, so a pair at or
    above the threshold is never ruled out.
    """
    words = np.array([len(b) // 8 for b in bits])
    label, out = np.arange(len(n)), []
    rows = {w: (np.flatnonzero(words == w), np.stack([np.frombuffer(bits[i], U64) for i in np.flatnonzero(words == w)]))
            for w in np.unique(words).tolist()}
    in_left = np.zeros(len(n), bool)
    in_left[left] = True
    for p in left if right is None else right:
        for w, (idx, m) in rows.items():
            if not w // 4 <= words[p] <= w * 4:
                continue
            use = (100 * np.minimum(n[idx], n[p]) >= percent * np.maximum(n[idx], n[p])) & in_left[idx] & (label[idx] != label[p])
            if right is None:
                use &= idx < p
            at = np.flatnonzero(use)
            if not len(at):
                continue
            least = int(min(w, words[p]))
            mine = _fold(np.frombuffer(bits[p], U64)[None], least)
            differ = np.bitwise_count(_fold(m[at], least) ^ mine).sum(1)
            for i in idx[at[(100 + percent) * differ <= (100 - percent) * (n[idx[at]] + n[p])]].tolist():
                if label[i] != label[p]:
                    out.append((i, int(p)))
                    label[label == max(label[i], label[p])] = min(label[i], label[p])
    return out


def candidate_groups(members: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(group, k1): classes connected by pairs that the bitmaps do not rule out."""
    held = dealt_in_blocks(members, "leader", FILTER_BLOCK).join(classes.select("k1", "k2", "n", "bits"), "k1")

    def run(batches):
        for (_, lo, hi), rows in sorted_groups(batches, ["leader", "lo", "hi"]):
            blocks = np.array([r["block"] for r in rows])
            left = np.flatnonzero(blocks == lo)
            right = None if lo == hi else np.flatnonzero(blocks == hi)
            if len(rows) < 2 or not len(left) or (right is not None and not len(right)):
                continue
            pairs = candidate_edges(np.array([r["n"] for r in rows]), [r["bits"] for r in rows], left, right, percent)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([rows[i]["k1"] for i, _ in pairs], pa.int64()),
                                                  pa.array([rows[j]["k1"] for _, j in pairs], pa.int64())], names=["a", "b"])

    edges = (held.select("leader", "lo", "hi", "block", "k1", "n", "bits").repartition("leader", "lo", "hi")
             .sortWithinPartitions("leader", "lo", "hi").mapInArrow(run, "a long, b long"))
    return components(edges).select(F.col("root").alias("group"), F.col("node").alias("k1"))


def links(docs: DataFrame, classes: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) class structs that connect all similar classes. ``classes``: k1, k2, id, t."""
    wanted = dealt_in_blocks(groups, "group", BLOCK).join(classes.select("k1", "k2", "id", "t"), "k1")
    texts = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "t", "text")
    held = wanted.join(texts, ["id", "t"]).select("group", "lo", "hi", "block", "k1", "k2", "text")

    def run(batches):
        cache = WordHashes()
        for (_, lo, hi), rows in sorted_groups(batches, ["group", "lo", "hi"]):
            rows = list({(r["k1"], r["k2"]): r for r in rows}.values())
            left = [i for i, r in enumerate(rows) if r["block"] == lo]
            right = None if lo == hi else [i for i, r in enumerate(rows) if r["block"] == hi]
            if len(rows) < 2 or not left or right == []:
                continue
            pairs = join_group(shingle_sets([r["text"] for r in rows], cache), left, right, percent)
            if pairs:
                key = lambda i: {"k1": rows[i]["k1"], "k2": rows[i]["k2"]}
                yield pa.RecordBatch.from_pylist([{"a": key(i), "b": key(j)} for i, j in pairs], schema=_EDGE)

    return (held.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi")
            .mapInArrow(run, "a struct<k1:long,k2:long>, b struct<k1:long,k2:long>"))


_KEY = pa.struct([("k1", pa.int64()), ("k2", pa.int64())])
_EDGE = pa.schema([("a", _KEY), ("b", _KEY)])


def near_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    d = doc_texts(docs).withColumn("t", F.xxhash64("text"))
    scanned = stored(set_rows(d), "ngram-rows")
    rows = scanned.where("chunk is null").select("doc_id", "t", "n", "k1", "k2", "bits")
    rep = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.col("t")))
    classes = stored(rows.where("n > 0").groupBy("k1", "k2").agg(
        rep.alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")).select(
        "k1", "k2", "n", "bits", "rep.id", "rep.t"), "ngram-classes")
    crowded = crowding(scanned.where("chunk is not null").select("chunk", "load"))
    members = stored(clusters(stored(prefix_rows(d, crowded, percent), "ngram-prefixes")), "ngram-members")
    groups = stored(candidate_groups(members, classes, percent), "ngram-groups")
    roots = components(links(d, classes, groups, percent))
    linked = stored(roots.select("node.k1", "node.k2", "root").join(classes.select("k1", "k2", "id"), ["k1", "k2"]), "ngram-nodes")
    least = linked.groupBy("root").agg(F.min("id").alias("component"))
    named = classes.select("k1", "k2", "id").join(
        linked.join(least, "root").select("k1", "k2", "component"), ["k1", "k2"], "left").select(
        "k1", "k2", F.coalesce("component", "id").alias("component"))
    out = rows.join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif("component", F.lit(_NO_ID)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that give their component its id, repeated rows once; texts without words
    and rows without ``doc_id`` stay. Columns and types are those of ``docs``."""
    ids = near_groups(docs, percent).where("component_id is not null").select(
        F.col("component_id").alias("__representative")).distinct()
    kept = docs.where("doc_id is not null").join(ids, F.col("doc_id") == F.col("__representative"), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))
