"""Named queries over the driver tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its DuckDB twin if one can be written."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(col: str | Column, digits: int = 8) -> Column:
    """Round a float for comparison; float sums depend on their order."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def rounded(df: DataFrame, digits: int = 8, **special: int) -> DataFrame:
    """Round every double column of a result, keep NaN out, and give timestamps without a zone."""

    def column(c: str, t: str) -> Column:
        if t in ("double", "float"):
            return r(F.nanvl(F.col(c), F.lit(None)), special.get(c, digits)).alias(c)
        if t == "timestamp":
            return F.col(c).cast("timestamp_ntz").alias(c)
        if t == "int":
            return F.col(c).cast("long").alias(c)
        return F.col(c)

    return df.select(*[column(c, t) for c, t in df.dtypes])
