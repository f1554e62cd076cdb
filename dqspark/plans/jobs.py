"""A job over one landed CSV file: metadata row, run, clean output, status rows.

The reference keeps job state in a server's memory; here every state change is a
row appended to the run store (``runs.py``), so the history survives restarts and
any number of jobs can write at once.
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession

from dqspark.plans.cleaning import UPLOAD_PREVIEW_ROWS, clean_table, first_rows
from dqspark.plans.runs import RunStore, now
from dqspark.sources import csv as csv_source
from dqspark.sources import sinks


def new_job_id() -> str:
    return uuid.uuid4().hex


def register_upload(spark: SparkSession, store: RunStore, path: str, job_id: str | None = None, **csv_options) -> dict:
    """S5 + S10 + T5: read the file, record ``uploaded`` with its facts, return a preview."""
    job_id = job_id or new_job_id()
    df = csv_source.read_csv(spark, path, **csv_options)
    meta = sinks.input_metadata(spark, job_id, os.path.basename(path.rstrip("/")), df, path).first().asDict()
    store.record(job_id, "uploaded", **{k: v for k, v in meta.items() if k not in ("job_id", "status")})
    preview = [r.asDict() for r in first_rows(df, UPLOAD_PREVIEW_ROWS).collect()]
    return {**meta, "preview": preview}


def run_job(spark: SparkSession, store: RunStore, path: str, job_id: str, match_col: str = "name",
            threshold: float = 85, **options) -> dict:
    """Run the cleaning job on an uploaded file and record the outcome; ``options`` go to ``clean_table``."""
    store.record(job_id, "running", fuzzy_col=match_col, threshold=float(threshold))
    t0 = time.time()
    try:
        res = clean_table(spark, path, match_col, threshold, **options)
        out = store.output_path(job_id)
        sinks.write_csv(res.table, out)
        facts = sinks.file_facts(spark, out, "*.csv")
        elapsed = round(time.time() - t0, 2)
        store.record(job_id, "complete", fuzzy_col=match_col, threshold=float(threshold), elapsed=elapsed,
                     clean_records=res.clean_count, cqi_score=float(res.cqi["cqi_score"]),
                     output_checksum=facts["checksum"], completed_at=now())
        return {"status": "complete", "elapsed": elapsed, "result": res}
    except Exception as e:  # noqa: BLE001 - any failure marks the job as error
        store.record(job_id, "error", fuzzy_col=match_col, threshold=float(threshold),
                     elapsed=round(time.time() - t0, 2), error=str(e))
        return {"status": "error", "error": str(e)}
