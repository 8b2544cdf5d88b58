"""SparkSession helpers.

Only settings a job needs for correct, scalable plans are set here; cluster sizing
(executors, memory, shuffle partitions) belongs to the submitter.  The checkpoint folder
is read from the session and only made up on a local master, never overwritten.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "quire",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library relies on.  ``shuffle_partitions`` is only
    set when given or on a local master; elsewhere the submitter's value (or AQE) stands."""
    builder = SparkSession.builder.appName(app)
    local = bool(master and master.startswith("local"))
    if master:
        builder = builder.master(master)
    if local:
        # local mode runs every task inside the driver JVM
        builder = builder.config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
    parts = shuffle_partitions or os.environ.get("QUIRE_SHUFFLE_PARTITIONS") or (8 if local else None)
    if parts:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # only replace the book partitions a run writes
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if local:
        ensure_checkpoint_dir(spark)
    return spark


#: Pages of an Arrow batch: a page can hold very many tags, so a worker must not get the 10,000
#: rows that Spark sends by default.
BATCH_PAGES = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a worker's memory (only ever lowers the setting)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_PAGES:
        spark.conf.set(key, str(BATCH_PAGES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share.

    Taken from an earlier ``setCheckpointDir`` or from ``spark.checkpoint.dir``.  Where
    neither is set, a scratch folder is made on a local master only; on a cluster a
    machine-local folder would lose data, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="quire-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table under the shared checkpoint folder: lineage is cut, lost executors lose
    nothing of it, and its size is known to the planner.  ``zstd``: markup and URLs repeat much."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
