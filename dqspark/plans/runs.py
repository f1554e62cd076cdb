"""Run records (S11, U2, J3, P10, A17, A18, K10) as append-only Parquet tables.

Under a runs folder:

* ``runs/``     one row per status change of a job (``uploaded`` -> ``running`` ->
  ``complete``/``error``) with the facts known at that time; the current state of
  a job is its latest row (``max_by`` on ``updated_at``);
* ``params/``   ``(run_id, key, value, ts)`` run parameters (text);
* ``metrics/``  ``(run_id, key, value, ts)`` run metrics (double);
* ``outputs/``  clean tables, one folder ``<job_id>_clean.csv`` per job.

Appends never rewrite earlier files, so concurrent jobs and retried tasks only add
rows; readers take the latest row per job. Rows lie under ``log/<table>/period=<day>``, the
day on which they were written. ``compact`` merges the many one-row files of days that
are over into few files under ``compact/<table>/run=<id>/period=<day>`` and then appends one
file to ``manifest/<table>`` that names the days and the run. Appending that file is the only
step readers can see: before it they read a day's own files, after it the merged
ones, never both, because both sides are pruned by partition with the same manifest. Tables
written flat under ``<table>/`` by earlier versions are read as well.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqspark.functions.scalar import job_id_of, threshold_band

RUN_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType(), False),
    T.StructField("filename", T.StringType(), True),
    T.StructField("rows", T.LongType(), True),
    T.StructField("columns", T.ArrayType(T.StringType()), True),
    T.StructField("uploaded_at", T.TimestampType(), True),
    T.StructField("input_checksum", T.StringType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("file_size_bytes", T.LongType(), True),
    T.StructField("fuzzy_col", T.StringType(), True),
    T.StructField("threshold", T.DoubleType(), True),
    T.StructField("elapsed", T.DoubleType(), True),
    T.StructField("clean_records", T.LongType(), True),
    T.StructField("cqi_score", T.DoubleType(), True),
    T.StructField("output_checksum", T.StringType(), True),
    T.StructField("completed_at", T.TimestampType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("updated_at", T.TimestampType(), False)])

PARAM_SCHEMA = "run_id string, key string, value string, ts timestamp"
LEDGER_SCHEMA = "batch long, job_id string, path string, outcome string, ended_at timestamp"
MANIFEST_SCHEMA = "period string, run string, rows long, merged_at timestamp"
METRIC_SCHEMA = "run_id string, key string, value double, ts timestamp"
OUTPUT_FOLDER = r"([^/]+_clean\.csv)/[^/]*$"
FINISHED = ("complete", "error")


def now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _schema(text_or_type) -> T.StructType:
    return T._parse_datatype_string(text_or_type) if isinstance(text_or_type, str) else text_or_type


SCHEMAS = {"runs": RUN_SCHEMA, "params": PARAM_SCHEMA, "metrics": METRIC_SCHEMA, "ledger": LEDGER_SCHEMA}
GRACE = timedelta(days=2)      # a day is over for writers this long after its end


class RunStore:
    """``period`` is the date pattern of the folders: days, or coarser for a store of few rows."""

    def __init__(self, spark: SparkSession, root: str, period: str = "yyyy-MM-dd"):
        self.spark, self.root, self.period = spark, root.rstrip("/"), period

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # ------------------------------------------------------------------ writes
    def record(self, job_id: str, status: str, **facts) -> None:
        row = {f.name: None for f in RUN_SCHEMA.fields}
        row.update(facts)
        row.update(job_id=job_id, status=status, updated_at=now())
        self.append("runs", self.spark.createDataFrame([tuple(row[f.name] for f in RUN_SCHEMA.fields)], RUN_SCHEMA))

    def log_params(self, run_id: str, params: dict) -> None:
        """S11 parameters."""
        ts = now()
        rows = [(run_id, k, None if v is None else str(v), ts) for k, v in params.items()]
        self.append("params", self.spark.createDataFrame(rows, PARAM_SCHEMA))

    def log_metrics(self, run_id: str, metrics: dict) -> None:
        """S11 metrics."""
        ts = now()
        rows = [(run_id, k, None if v is None else float(v), ts) for k, v in metrics.items()]
        self.append("metrics", self.spark.createDataFrame(rows, METRIC_SCHEMA))

    def end_of_file(self, batch: int, job_id: str, path: str, outcome: str) -> None:
        """The job of a landed file has ended, whatever its outcome."""
        self.append("ledger", self.spark.createDataFrame([(batch, job_id, path, outcome, now())], LEDGER_SCHEMA))

    def append(self, name: str, rows: DataFrame, at=None) -> None:
        """Append ``rows`` to a table; ``at`` (a column) is their time when they come from elsewhere."""
        period = F.date_format(at if at is not None else F.lit(now()), self.period)
        rows.withColumn("period", period).write.mode("append").partitionBy("period").parquet(self.path(f"log/{name}"))

    def compact(self, name: str = "runs", before: str | None = None) -> int:
        """Merge the files of the periods up to ``before`` (text of a period, exclusive; default: those
        over for ``GRACE``). Returns the number of periods merged. A period that got
        rows after its merge is merged again; periods (one a day) are all the driver sees."""
        at = F.date_format(F.lit(now() - GRACE), self.period)
        live = self._live(name).where(F.col("period") < (F.lit(before) if before is not None else at))
        known = self._manifest(name).select("period", F.col("rows").alias("__merged"))
        todo = [r["period"] for r in live.groupBy("period").agg(F.count(F.lit(1)).alias("__rows"))
                .join(known, "period", "left").where(~F.col("__merged").eqNullSafe(F.col("__rows"))).collect()]
        if not todo:
            return 0
        run = uuid.uuid4().hex
        folder = self.path(f"compact/{name}/run={run}")
        # rebalance: a period holding most rows is split, small ones share a task
        live.where(F.col("period").isin(todo)).hint("rebalance", "period").write.partitionBy("period").parquet(folder)
        merged = self.spark.read.schema(live.schema).parquet(folder)
        (merged.groupBy("period").agg(F.count(F.lit(1)).alias("rows"))
         .select("period", F.lit(run).alias("run"), "rows", F.lit(now()).alias("merged_at"))
         .coalesce(1).write.mode("append").parquet(self.path(f"manifest/{name}")))      # one file: seen whole or not at all
        return len(todo)

    def output_path(self, job_id: str) -> str:
        return self.path(f"outputs/{job_id}_clean.csv")

    # ------------------------------------------------------------------ reads
    def _stored(self, path: str, schema: T.StructType) -> DataFrame:
        # any filesystem the cluster names (no local-disk checks): a table not
        # written yet reads as empty
        try:
            return self.spark.read.schema(schema).parquet(self.path(path))
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _live(self, name: str) -> DataFrame:
        return self._stored(f"log/{name}", T.StructType(_schema(SCHEMAS[name]).fields + [T.StructField("period", T.StringType())]))

    def _manifest(self, name: str) -> DataFrame:
        """The last merge of each period."""
        m = self._stored(f"manifest/{name}", _schema(MANIFEST_SCHEMA))
        last = F.struct("merged_at", "run", "rows")
        return m.groupBy("period").agg(F.max(last).alias("m")).select("period", "m.run", "m.rows")

    def _read(self, name: str) -> DataFrame:
        schema = _schema(SCHEMAS[name])
        merged = [(r["run"], r["period"]) for r in self._manifest(name).collect()]      # one row a day
        out = self._stored(name, schema).unionByName(
            self._live(name).where(~F.col("period").isin([p for _, p in merged])).select(*schema.names))
        if merged:
            keys = [T.StructField("run", T.StringType()), T.StructField("period", T.StringType())]
            out = out.unionByName(self._stored(f"compact/{name}", T.StructType(schema.fields + keys))
                                  .where(F.concat_ws("/", "run", "period").isin([f"{r}/{p}" for r, p in merged]))
                                  .select(*schema.names))
        return out

    def runs(self) -> DataFrame:
        return self._read("runs")

    def params(self) -> DataFrame:
        return self._read("params")

    def metrics(self) -> DataFrame:
        return self._read("metrics")

    def ledger(self) -> DataFrame:
        return self._read("ledger")

    def latest(self) -> DataFrame:
        return latest_runs(self.runs())

    def outputs(self) -> DataFrame:
        """``(job_id, clean_records, file)`` per stored output, one scan of all outputs."""
        p = self.path("outputs")
        try:
            stored = (self.spark.read.option("header", True).option("multiLine", True)
                      .option("escape", '"').csv(f"{p}/*_clean.csv"))
        except AnalysisException:          # no output stored yet
            return self.spark.createDataFrame([], "job_id string, clean_records long, file string")
        # every stored file is listed (bodies pruned), so outputs without rows count 0
        files = (self.spark.read.format("binaryFile").load(f"{p}/*_clean.csv")
                 .select(F.regexp_extract("path", OUTPUT_FOLDER, 1).alias("file")).distinct())
        return with_empty_outputs(files, output_counts(stored))

    def history(self) -> DataFrame:
        return run_history(self.latest(), self.outputs(), self.runs())

    def counters(self) -> DataFrame:
        return run_counters(self.latest())


def latest_runs(runs: DataFrame) -> DataFrame:
    """Current state per job: latest status, and each fact from the latest row that has it."""
    cols = [c for c in runs.columns if c not in ("job_id", "status", "updated_at")]
    ts = F.col("updated_at")
    return runs.groupBy("job_id").agg(
        F.max_by("status", ts).alias("status"), F.max(ts).alias("updated_at"),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ts)).alias(c) for c in cols]) \
        .select(*runs.columns)


def with_empty_outputs(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Every listed output ``file`` with its rows, 0 where it holds none."""
    return (files.join(counts.select("file", "clean_records"), "file", "left")
            .select(job_id_of(F.col("file")).alias("job_id"),
                    F.coalesce("clean_records", F.lit(0).cast("long")).alias("clean_records"), "file"))


def output_counts(outputs: DataFrame) -> DataFrame:
    """A18 + C8: rows per stored output file folder."""
    f = F.url_decode(F.regexp_replace(F.regexp_extract(F.input_file_name(), OUTPUT_FOLDER, 1), r"\+", "%2B"))
    return (outputs.select(f.alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("clean_records"))
            .select(job_id_of(F.col("file")).alias("job_id"), "clean_records", "file"))


def run_history(latest: DataFrame, outputs: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """U2 + J3 + P10: finished runs, plus stored outputs that have no run record.

    ``runs`` (the raw run rows), when given, serves the anti join directly: a job
    has a latest row exactly when it has any run row, so the latest-state
    aggregate is not computed a second time just for its ids.
    """
    finished = latest.where(F.col("status").isin(*FINISHED))
    known = (runs if runs is not None else latest).select("job_id")
    orphans = (outputs.join(known, "job_id", "left_anti")
               .withColumn("status", F.lit("complete")))
    return finished.unionByName(orphans, allowMissingColumns=True)


def run_counters(latest: DataFrame) -> DataFrame:
    """Jobs running now and all jobs."""
    return latest.agg(F.count_if(F.col("status") == "running").alias("active_jobs"),
                      F.count(F.lit(1)).alias("total_jobs"))


def with_band(runs: DataFrame) -> DataFrame:
    """C14 on the stored threshold."""
    return runs.withColumn("band", threshold_band(F.col("threshold")))
