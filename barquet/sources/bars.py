"""Bars at rest: the ten-column Parquet layout with an ISO timestamp string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet import schemas


def parse_bars(raw: DataFrame) -> DataFrame:
    """ISO strings to UTC timestamps (no zone means UTC) and the date ``d``."""
    zoned = F.when(F.col("ts").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.col("ts")).otherwise(F.concat("ts", F.lit("Z")))
    return raw.withColumn("ts", F.to_timestamp(zoned)).withColumn("d", F.to_date("ts"))


#: What lies on disk: the stored columns and the partition by year.
STORED = T.StructType([*schemas.BARS_AT_REST.fields, T.StructField("year", T.IntegerType())])


def stored_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def load_bars(
    spark: SparkSession, path: str, market: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Read a bars folder. ``market`` and the half-open window [start, end) prune its partitions."""
    raw = stored_bars(spark, path)
    if market is not None and market != "ALL":
        raw = raw.filter(F.col("market") == market)
    if start is not None:
        # an ISO time of the day or later is not smaller than the day's text, in any zone but by one day
        raw = raw.filter((F.col("year") >= int(start[:4]) - 1) & (F.col("ts") >= F.date_sub(F.lit(start).cast("date"), 1).cast("string")))
    if end is not None:
        raw = raw.filter((F.col("year") <= int(end[:4])) & (F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("string")))
    bars = parse_bars(raw.drop("year"))
    if start is not None:
        bars = bars.filter(F.col("d") >= F.lit(start).cast("date"))
    if end is not None:
        bars = bars.filter(F.col("d") < F.lit(end).cast("date"))
    return bars


def to_rest(bars: DataFrame) -> DataFrame:
    """The ten stored columns, in order; the closed flag and derived columns are not stored."""
    ts = F.col("ts") if "ts" in bars.columns else F.col("d").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    named = bars.withColumn("ts", iso)
    if "timeframe" not in named.columns:
        named = named.withColumn("timeframe", F.lit("1d"))
    return named.select(*[F.col(f.name).cast(f.dataType) for f in schemas.BARS_AT_REST.fields])


def dated(bars: DataFrame) -> DataFrame:
    """The stored columns and the year they are partitioned by."""
    return to_rest(bars).withColumn("year", F.substring("ts", 1, 4).cast("int"))


def save_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write bars partitioned by market and year, so a panel or a window is read without the rest.

    The rows are rebalanced by partition first: few files per folder, and a large folder is split.
    """
    dated(bars).hint("rebalance", "market", "year").write.mode(mode).partitionBy("market", "year").parquet(path)
