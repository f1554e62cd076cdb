"""Spark session helpers.

Cluster jobs get their session (and their ``spark.checkpoint.dir``) from the
platform; these helpers only fill in settings that are missing, which is what
tests and the local bench need.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings this library relies on. AQE re-plans joins at run time, coalesces
# small shuffle partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "dqspark", extra: dict | None = None) -> SparkSession:
    """A local session for tests and the bench (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               # small local inputs: smaller AQE targets keep every core busy
               .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
               .config("spark.driver.memory", "8g"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that one is
    always used. Only when nothing is set (local tests) a scratch folder is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="dqspark-ckpt-", dir=os.environ.get("DQSPARK_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder and read it back.

    Cuts the lineage as ``checkpoint()`` does, but columnar and compressed, so that later
    passes read only the columns they use.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``staged`` and the number of rows, counted as they are written (no job of its own)."""
    seen = Observation()
    table = staged(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return table, int(seen.get["rows"])


#: A table estimated below this size per core is spread before a CPU-heavy Python stage.
SPREAD_BYTES = 16 << 20


def spread_for_cpu(df: DataFrame) -> DataFrame:
    """Before a CPU-heavy Python stage: make sure every core gets a task.

    A small file scans as one partition; a UDF over it would then run on one core. Whether a
    table is small is read from the optimizer's size estimate, which runs no job; a large
    one already has many partitions and passes without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df
