"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.session import ensure_checkpoint_dir

#: A word of the contracts: anything between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Entries of a worker's word cache before it is emptied (about 100 MB).
CACHE_ENTRIES = 400_000
U64 = np.uint64


def doc_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so other columns never clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``, but columnar and compressed; a lost
    executor costs a reread, never a recomputation.
    """
    spark: SparkSession = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession, value):
    """Broadcast an object of this package by value; tasks need no install. Returns its getter."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of span structs, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix constants, fixed values)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """Word bytes -> 64-bit hash, computed once per task and word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s+n]`` over all (s, n) without a Python loop."""
    total = int(lens.sum())
    if not total:
        return flat[:0]
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return flat[shift + np.arange(total)]


def slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut a large Arrow batch so that a step's scratch arrays stay small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Groups of a stream of batches whose rows arrive sorted by ``keys``; one group in memory."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current and rows:
                yield current, rows
                rows = []
            current = key
            rows.append(row)
    if rows:
        yield current, rows
