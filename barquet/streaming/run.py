"""Running a stream to the end of its input and reading what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barquet.session import run_folder, use_utc

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State of ``transformWithState`` lives in RocksDB; the setting is per session."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_table(spark: SparkSession, path: str, schema=None, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files, or one file in a folder, as a stream."""
    use_utc(spark)
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rpartition("/")
    if name.endswith(".parquet"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drain_to_table(stream: DataFrame, name: str, folder: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process all available input into a Parquet table (exactly once) and return the table.

    With the same ``folder`` and ``checkpoint`` a later call goes on where the last one stopped.
    """
    spark = stream.sparkSession
    folder = folder or run_folder(spark, name)
    checkpoint = checkpoint or run_folder(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder)


def drain_batches(stream: DataFrame, name: str, fn, mode: str = "append", checkpoint: str | None = None) -> None:
    """Process all available input with ``fn(batch, batch_id)``; fn must be safe to repeat per batch id."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint or run_folder(spark, f"{name}-state"))
        .outputMode(mode).trigger(availableNow=True).start()
    )
    query.awaitTermination()
