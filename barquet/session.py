"""Session settings the engine relies on, and the one way it cuts lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", partitions: int = 8, app: str = "barquet") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BARQUET_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def use_utc(spark: SparkSession) -> SparkSession:
    """All timestamps of the engine are UTC; naive strings mean UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    A temporary folder serves only where driver and executors are one process (``local[n]``); on a
    cluster without the setting it would be another folder on every machine, so that is an error.
    What is written below the folder goes when the session ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = context.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
        if not configured:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="barquet-ckpt-")
        context.setCheckpointDir(configured)
        path = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return context.getCheckpointDir()


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate result that several branches of one plan read, and read it back.

    The table lies below the shared checkpoint folder: a lost executor costs a re-read and not a
    recomputation of everything upstream, each branch reads only its columns, and the planner knows
    the table's size when it chooses a join.
    """
    spark = df.sparkSession
    folder = run_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables a query writes and reads back."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
