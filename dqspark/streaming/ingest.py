"""Landing-folder ingest with Structured Streaming.

A ``binaryFile`` stream over the landing folder lists new ``*.csv`` files (only
the ``path`` column is selected, so file bodies are not read by the stream);
each micro-batch holds at most ``files_per_batch`` files and ``foreachBatch`` runs
the cleaning job once per file. The checkpoint location records which batches
were committed, so a restart resumes after them. ``foreachBatch`` is
at-least-once: a batch cut short by a failure runs again. The job id is derived
from the file's path and modification time, and a ledger of the run store holds
(batch, job, file, outcome) once a file's job has ended: a replay passes over the jobs in it,
so it adds nothing, and a job cut short overwrites its own output. A file that cannot be read
gets an ``error`` row with the reason and its ledger row; the stream goes on with the next one.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dqspark.plans.jobs import register_upload, run_job
from dqspark.plans.runs import RunStore


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def landed_job_id(path: str, modified) -> str:
    """Stable id of one landed file version: the same file replayed gets the same id."""
    return hashlib.sha256(f"{path}|{modified}".encode()).hexdigest()[:32]


def _local_path(p: str) -> str:
    return p[len("file:"):] if p.startswith("file:") else p


def ingest_landing(spark: SparkSession, landing: str, store_root: str, checkpoint: str,
                   match_col: str = "name", threshold: float = 85, files_per_batch: int = 1,
                   available_now: bool = True, csv_options: dict | None = None, **options):
    """Start the stream; returns the ``StreamingQuery`` (``availableNow`` by default).

    ``csv_options`` (``encoding``, ``multiline``, ``schema``) and ``options`` go to the job.
    """
    csv_options = csv_options or {}
    store = RunStore(spark, store_root)
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
             .option("pathGlobFilter", "*.csv")
             .option("maxFilesPerTrigger", files_per_batch).load(landing)
             .select("path", "modificationTime"))

    def process(batch: DataFrame, epoch_id: int) -> None:
        # bounded: at most files_per_batch paths per micro-batch
        landed = {landed_job_id(r["path"], r["modificationTime"]): _local_path(r["path"])
                  for r in batch.select("path", "modificationTime").orderBy("path").collect()}
        ended = {r["job_id"] for r in store.ledger().where(F.col("job_id").isin(list(landed))).select("job_id").collect()}
        for job_id, path in landed.items():
            if job_id in ended:
                continue
            try:
                register_upload(spark, store, path, job_id, **csv_options)
                outcome = run_job(spark, store, path, job_id, match_col, threshold, **csv_options, **options)["status"]
            except Exception as e:  # noqa: BLE001 - a file that cannot be read must not stop the stream
                outcome = "error"
                store.record(job_id, outcome, filename=os.path.basename(path), error=str(e))
            store.end_of_file(epoch_id, job_id, path, outcome)

    writer = files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
