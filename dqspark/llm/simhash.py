"""Document fingerprints: weighted SimHash and permuted block tables.

The terms of a text are its lower-cased word pairs (one word alone is its own term). Each
distinct term votes with its 128-bit hash, weighted by 1 + ln(count): bit b of the
fingerprint is set when the weights of terms with that bit outweigh those without. The
likeness of two fingerprints is 1 - (differing bits) / 128.

``search`` finds all fingerprints within ``radius`` bits of the query fingerprints, exactly. The
128 bits are cut into ``BLOCKS``; block i may differ in t_i bits, and where the t_i + 1 sum to
more than the radius some block of any near pair keeps its bound (pigeonhole). One table per
block is keyed by the block's bits; a query looks up its own bits with every choice of at most
t_i of them turned over. ``RADIUS`` is 16: a text with 2 % of its words replaced lies 9 to 11
bits away on average, and within 16 bits in 95 to 99 % of the cases (100 words and more). The
queries are the documents whose id is divisible by ``EVERY``; they are looked up in all rows.

Documents are put in order by one range shuffle of the texts. Each range is then read as a
stream, and the last document of a range meets the first of the next one in a second, small step.

Defined cases: null, empty and blank texts have no terms and the all-zero fingerprint; a bit
whose votes tie is 0; equal texts have equal fingerprints; documents that share a ``doc_id``
follow each other in the order of a text hash; rows without ``doc_id`` come last and are no
queries; a single document is its own successor; an empty table gives an empty result; texts of
any length are read whole, one at a time; columns other than ``doc_id`` and ``text`` are never read,
so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dqspark.llm.common import U64, WordHashes, doc_texts, mix64, stored

BITS = 128
#: Bits in which a near fingerprint may differ, and which documents are queries of the search.
RADIUS, EVERY = 16, 50
#: Blocks as (half, first bit from the right, width), the wide ones first: they take spare bits of the radius first.
BLOCKS = (("lo", 0, 22), ("lo", 22, 21), ("lo", 43, 21), ("hi", 0, 16), ("hi", 16, 16), ("hi", 32, 16), ("hi", 48, 16))


def fingerprint(words: list[bytes], cache: WordHashes) -> tuple[int, int]:
    """The two 64-bit halves, as signed integers."""
    h = cache.of(words)
    if not len(h):
        return 0, 0
    if len(h) > 1:
        h = mix64(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:])
    terms, tf = np.unique(h, return_counts=True)
    weight = (1.0 + np.log(tf)).astype(np.float32)
    halves = np.empty((len(terms), 2), U64)
    halves[:, 0] = mix64(terms)
    halves[:, 1] = mix64(terms + U64(0xD1B54A32D192ED03))
    bits = np.unpackbits(halves.view(np.uint8), axis=1).astype(np.float32)
    votes = 2 * (weight @ bits) - weight.sum()
    out = np.packbits(votes > 0).view(np.int64)
    return int(out[0]), int(out[1])


def text_print(text: str, cache: WordHashes) -> tuple[int, int]:
    return fingerprint(text.encode("utf-8", "replace").lower().split(), cache)


def hex128(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


_EDITED = ("doc_id long, n_chars long, edited_sha256 string, hi long, lo long, e_hi long, e_lo long, n_hi long, n_lo long, "
           "range int, edge int, text string")
_ARROW = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind])
                    for name, kind in (c.split() for c in _EDITED.split(", "))])


def edited_text(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


class Walk:
    """A range of documents as a stream: each row is finished when the one after it is known."""

    def __init__(self) -> None:
        self.cache = WordHashes()

    def finish(self, row: dict, following: str, print_: tuple[int, int]) -> dict:
        edited = edited_text(row["text"], following)
        e_hi, e_lo = text_print(edited, self.cache)
        return {**row, "edited_sha256": hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), "e_hi": e_hi, "e_lo": e_lo,
                "n_hi": print_[0], "n_lo": print_[1], "edge": 0, "text": None}

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece, out = batch.slice(at, 256), []
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    hi, lo = text_print(text, self.cache)
                    row = {"doc_id": doc_id, "n_chars": len(text), "hi": hi, "lo": lo, "range": part, "text": text}
                    if held is None:
                        out.append({**row, "edge": 1})          # the first of the range, for the range before
                    else:
                        out.append(self.finish(held, text, (hi, lo)))
                    held = row
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{**held, "edge": 2}], schema=_ARROW)       # the last of the range

    def close(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Last rows joined with the first row of the next range."""
        for batch in batches:
            out = [self.finish({k: r[k] for k in ("doc_id", "n_chars", "hi", "lo", "range", "text")}, r["f_text"], (r["f_hi"], r["f_lo"]))
                   for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


def edit_and_fingerprint(docs: DataFrame) -> DataFrame:
    """Per document: length, fingerprint, that of its edited text, and both likenesses (see the contract).

    One id, or one text under one id, may hold any share of the rows: the text hash and the row's own
    number split them over ranges.
    """
    d = doc_texts(docs).withColumn("tie", F.xxhash64("text")).withColumn("own", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("own")]
    walked = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(
        lambda batches: Walk().run(batches), _EDITED)
    walked = stored(walked, "simhash-ranges")
    firsts = walked.where("edge = 1").select(F.col("range").alias("next"), F.col("text").alias("f_text"), F.col("hi").alias("f_hi"),
                                             F.col("lo").alias("f_lo"))
    # One short row per range: which range follows which; after the last comes the first.
    ranges = walked.where("edge = 2").select("range")
    turn = ranges.select("range", F.coalesce(F.lead("range").over(Window.orderBy("range")), F.min("range").over(Window.partitionBy()))
                         .alias("next"))
    lasts = walked.where("edge = 2").join(turn, "range").join(firsts, "next").select(*_ARROW.names, "f_text", "f_hi", "f_lo")
    d = walked.where("edge = 0").unionByName(lasts.mapInArrow(lambda batches: Walk().close(batches), _EDITED))
    like = lambda a, b: F.lit(1.0) - distance(F.col("hi"), F.col("lo"), F.col(a), F.col(b)) / F.lit(float(BITS))
    return d.select("doc_id", "n_chars", "edited_sha256", hex128(F.col("hi"), F.col("lo")).alias("fingerprint"),
                    hex128(F.col("e_hi"), F.col("e_lo")).alias("edited_fingerprint"), like("e_hi", "e_lo").alias("near_edited"),
                    like("n_hi", "n_lo").alias("near_next"), "hi", "lo")


def near_fingerprints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs (a < b) of distinct fingerprints ``hi``, ``lo`` that differ in at most ``radius`` bits.

    A pair that agrees in several blocks is reported by the first of them only.
    """
    blocks, width = radius + 1, BITS // (radius + 1)
    if width > 32:
        raise ValueError("radius must be at least 3, so that a block fits a 32-bit key")
    bits = F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0"))
    p = prints.select("hi", "lo").distinct()
    text = F.concat(F.lpad(F.conv(F.substring(bits, 1, 16), 16, 2), 64, "0"),
                    F.lpad(F.conv(F.substring(bits, 17, 16), 16, 2), 64, "0"))
    cuts = [i * BITS // blocks for i in range(blocks + 1)]
    p = p.withColumn("keys", F.array(*[F.substring(text, a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]))
    t = p.select("hi", "lo", "keys", F.posexplode("keys").alias("block", "key"))
    a, b = t.alias("a"), t.alias("b")
    first = F.array_position(F.zip_with("a.keys", "b.keys", lambda x, y: x == y), True) - 1
    return (a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.key") == F.col("b.key"))
                   & ((F.col("a.hi") < F.col("b.hi")) | ((F.col("a.hi") == F.col("b.hi")) & (F.col("a.lo") < F.col("b.lo"))))
                   & (distance(F.col("a.hi"), F.col("a.lo"), F.col("b.hi"), F.col("b.lo")) <= radius))
            .where(first == F.col("a.block"))
            .select(F.col("a.hi").alias("a_hi"), F.col("a.lo").alias("a_lo"), F.col("b.hi").alias("b_hi"),
                    F.col("b.lo").alias("b_lo"),
                    distance(F.col("a.hi"), F.col("a.lo"), F.col("b.hi"), F.col("b.lo")).alias("bits")))


def block_bounds(radius: int) -> list[int]:
    """Bits that may differ in each of ``BLOCKS``: the bounds plus one sum to ``radius`` + 1; -1 leaves a block out."""
    n = len(BLOCKS)
    return [(radius + 1) // n + (i < (radius + 1) % n) - 1 for i in range(n)]


def _block(i: int, hi: str, lo: str) -> Column:
    half, at, width = BLOCKS[i]
    return F.shiftrightunsigned(F.col(hi if half == "hi" else lo), at).bitwiseAND(F.lit((1 << width) - 1))


def _turned(width: int, bound: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(bound + 1) for bits in combinations(range(width), k)]


def _key(i: int, value: Column) -> Column:
    return F.lit(i << 32).cast("long").bitwiseOR(value)


def _looked_up(i: int, bound: int) -> Column:
    """Keys of a query in the table of block i: its bits with at most ``bound`` of them turned over."""
    own = _block(i, "q_hi", "q_lo")
    return F.transform(F.lit(_turned(BLOCKS[i][2], bound)).cast("array<bigint>"), lambda m: _key(i, own.bitwiseXOR(m)))


def search(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(q_hi, q_lo, hi, lo, n, bits): all ``prints`` (hi, lo, n) within ``radius`` of a query (hi, lo), itself included.

    A pair found through several blocks is reported by the first whose bound it keeps.
    """
    bounds = block_bounds(radius)
    used = [i for i, t in enumerate(bounds) if t >= 0]
    table = prints.select("hi", "lo", "n", F.explode(F.array(*[_key(i, _block(i, "hi", "lo")) for i in used])).alias("key"))
    looks = F.concat(*[_looked_up(i, bounds[i]) for i in used])
    asked = queries.select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo")).distinct().select(
        "q_hi", "q_lo", F.explode(looks).alias("key"))
    far = distance(F.col("hi"), F.col("lo"), F.col("q_hi"), F.col("q_lo"))
    keeps = F.lit(None).cast("int")
    for i in reversed(used):
        apart = F.bit_count(_block(i, "hi", "lo").bitwiseXOR(_block(i, "q_hi", "q_lo")))
        keeps = F.when(apart <= bounds[i], F.lit(i)).otherwise(keeps)
    # The estimate of an exploded side does not count what it becomes, so neither side may be broadcast on it.
    return asked.hint("merge").join(table.hint("merge"), "key").where((far <= radius) & (F.shiftrightunsigned("key", 32) == keeps)).select(
        "q_hi", "q_lo", "hi", "lo", "n", far.alias("bits"))


def near_counts(rows: DataFrame, radius: int = RADIUS, every: int = EVERY) -> DataFrame:
    """``rows`` with ``n_near``: how many other documents lie within the radius; null where a row is no query."""
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    counts = stored(rows.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max(asks).alias("asks")), "simhash-counts")
    near = search(counts.where("asks"), counts, radius).groupBy(F.col("q_hi").alias("hi"), F.col("q_lo").alias("lo")).agg(
        (F.sum("n") - 1).alias("n_near"))
    asked = rows.where(asks).join(near, ["hi", "lo"], "left")
    return asked.unionByName(rows.where(~asks).withColumn("n_near", F.lit(None).cast("long")))
