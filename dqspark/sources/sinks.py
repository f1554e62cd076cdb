"""Sinks and file facts.

* S7: the clean table as CSV with a header (a folder of part files, one per task;
  no ``coalesce(1)``, which would funnel the table through one task) or Parquet;
* S8: JSON reports; the match and repair reports only when non-empty;
* S9: SHA-256 of each file's bytes, first 12 hex characters, one row per file. The hash is a chain over the
  bytes, so a file is one task's work; files above ``WHOLE_BYTES`` pass through it line by line and may have any
  size (one without a plain suffix is held whole in one row, as small ones are, and must stay under 2 GB);
* S10: the input metadata row of a run.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.functions.scalar import sanitize

CHECKSUM_CHARS = 12
WHOLE_BYTES = 32 << 20    # files up to this size are hashed from one row; a row is copied a few times in a task
SUFFIX = r"[^/]\.[A-Za-z0-9_-]+$"
MARK = b"\xef\xbb\xbf"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, no index; NaN/inf written as empty."""
    sanitize(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, only_if_rows: bool = False) -> bool:
    """A JSON report (one object per line). Returns whether it was written."""
    if only_if_rows and df.isEmpty():
        return False
    sanitize(df).write.mode("overwrite").json(path)
    return True


def checksums(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, length, checksum)`` per file under ``path``. Lists the files when called."""
    def load(kind: str, **options) -> DataFrame:
        reader = spark.read.format(kind).options(**options)
        return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)

    def short(digest):
        return F.substring(digest, 1, CHECKSUM_CHARS).alias("checksum")

    files = load("binaryFile")
    # filters on the file's metadata choose from the listing: no byte of a file left out is read
    streamed = (F.col("_metadata.file_size") > WHOLE_BYTES) & F.col("_metadata.file_name").rlike(SUFFIX)
    large = files.where(streamed).select(F.regexp_extract("path", SUFFIX, 0).alias("name_end"))
    out = files.where(~streamed).select("path", "length", short(F.sha2(F.col("content"), 256)))
    for suffix in sorted({r["name_end"][1:] for r in large.distinct().collect()}):
        # the pass-through codec hands over the bytes as they are and, as any stream codec, keeps a file in one split
        lines = load("text", lineSep="\n", **{"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"},
                     **{f"{shaded}io.compress.passthrough.extension": suffix for shaded in ("", "org.apache.hadoop.shaded.")})
        digests = lines.where(streamed & F.endswith("_metadata.file_name", F.lit(suffix))).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"),
            F.col("_metadata.file_block_length").alias("split"), F.concat("value", F.lit("\n")).cast("binary").alias("line"),
        ).mapInArrow(_digests, "path string, length long, digest string")
        out = out.unionByName(digests.select("path", "length", short("digest")))
    return out


class _FileHash:
    """SHA-256 of a file that arrives as lines, each with a line feed after it. The reader drops a byte-order mark and
    does not tell whether the last line had a line feed: the bytes that are missing in the end do."""

    def __init__(self, length: int):
        self.length, self.seen, self.held = length, 0, b""
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(MARK)

    def feed(self, data) -> None:
        self.plain.update(data)
        self.marked.update(data)
        self.seen += len(data)

    def lines(self, data) -> None:
        self.feed(self.held)
        self.feed(data[:-1])
        self.held = b"\n"

    def digest(self) -> str:
        if self.length - self.seen in (1, 1 + len(MARK)):
            self.feed(self.held)
        missing = self.length - self.seen
        if missing not in (0, len(MARK)):
            raise ValueError(f"{missing} bytes of {self.length} were not read: did the file change?")
        return (self.marked if missing else self.plain).hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(path, length, digest)`` of the files whose lines a task reads, each file from its first line to its last."""
    def done(file: str, h: _FileHash) -> pa.RecordBatch:
        path = re.sub(r"^(\w+):///", r"\1:/", unquote(file))        # as the file listing writes it
        return pa.RecordBatch.from_pydict({"path": [path], "length": [h.length], "digest": [h.digest()]})

    current, h = None, None
    for batch in batches:
        names, lines = batch.column(0), batch.column(3)
        wide = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
        _, offsets, data = lines.buffers()
        ends = np.frombuffer(offsets, wide)[lines.offset:lines.offset + len(lines) + 1]
        which = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist()] if len(lines) else []
        for start, end in zip(starts, [*starts[1:], len(lines)]):
            file, length = names[start].as_py(), batch.column(1)[start].as_py()
            if batch.column(2)[start].as_py() != length:
                raise ValueError(f"{file} was split")
            if file != current:
                if h is not None:
                    yield done(current, h)
                current, h = file, _FileHash(length)
            h.lines(memoryview(data)[int(ends[start]):int(ends[end])])
    if h is not None:
        yield done(current, h)


def file_facts(spark: SparkSession, path: str, glob: str | None = None) -> dict:
    """Checksum and total size of a file or folder (one row per file, summed)."""
    rows = checksums(spark, path, glob).collect()
    if len(rows) == 1:
        return {"checksum": rows[0]["checksum"], "size": rows[0]["length"]}
    # several part files: checksum of the ordered per-file checksums
    h = hashlib.sha256("".join(r["checksum"] for r in sorted(rows, key=lambda r: r["path"])).encode())
    return {"checksum": h.hexdigest()[:CHECKSUM_CHARS], "size": sum(r["length"] for r in rows)}


def input_metadata(spark: SparkSession, job_id: str, filename: str, df: DataFrame, path: str,
                   uploaded_at=None) -> DataFrame:
    """``job_id, filename, rows, columns, uploaded_at, input_checksum, status, file_size_bytes``."""
    facts = file_facts(spark, path)
    ts = F.lit(uploaded_at) if uploaded_at is not None else F.current_timestamp()
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(job_id).alias("job_id"), F.lit(filename).alias("filename"), "rows",
        F.array(*[F.lit(c) for c in df.columns]).cast("array<string>").alias("columns"),
        ts.cast("timestamp").alias("uploaded_at"), F.lit(facts["checksum"]).alias("input_checksum"),
        F.lit("uploaded").alias("status"), F.lit(facts["size"]).cast("long").alias("file_size_bytes"))
