"""Views that shape the driver tables like market data (see FIXTURES.md, part C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.session import use_utc

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nation_ticker(key: str) -> Column:
    return F.concat(F.lit("N"), F.lpad(F.col(key).cast("string"), 2, "0"))


def nation_market(key: str) -> Column:
    return F.when(F.col(key) % 2 == 0, "NASDAQ").otherwise("KOSPI")


def market_currency(market: str = "market") -> Column:
    return F.when(F.col(market) == "NASDAQ", "USD").otherwise("KRW")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as trades of their supplier's nation: market, ticker, d, px, qty, k (unique order)."""
    items = table(spark, sf, "lineitem")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return items.join(suppliers, items.l_suppkey == suppliers.s_suppkey).select(
        nation_market("s_nationkey").alias("market"),
        nation_ticker("s_nationkey").alias("ticker"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("supplier"),
        F.col("s_nationkey").alias("nation"),
        F.to_date("l_shipdate").alias("d"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
        F.col("l_quantity").alias("qty"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_returnflag",
        "l_linestatus",
        F.struct(*LINE_KEY).alias("k"),
    )


def _to_bars(trades: DataFrame, *keys: str) -> DataFrame:
    """OHLCV per key and day. Integer keys: the aggregation sorts, and names follow from them."""
    return trades.groupBy(*keys, "d").agg(
        F.min_by("px", "k").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "k").alias("close"),
        F.sum("qty").cast("long").alias("volume"),
    )


BAR_COLUMNS = ("d", "open", "high", "low", "close", "volume")


def bars_day(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per nation."""
    bars = _to_bars(lines(spark, sf), "nation")
    return bars.select(
        nation_market("nation").alias("market"), nation_ticker("nation").alias("ticker"), *BAR_COLUMNS
    ).withColumn("currency", market_currency())


def bars_day_s(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per supplier: a wider cross-section."""
    bars = _to_bars(lines(spark, sf), "l_suppkey", "nation")
    return bars.select(
        nation_market("nation").alias("market"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"),
        *BAR_COLUMNS,
    ).withColumn("currency", market_currency())


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ticks of their type."""
    return table(spark, sf, "events").select(
        F.when(F.length("event_type") % 2 == 0, "NASDAQ").otherwise("KOSPI").alias("market"),
        F.col("event_type").alias("ticker"),
        "ts",
        "event_id",
        "user_id",
        F.col("value").alias("px"),
    )


def bars_hour(spark: SparkSession, sf: str, unit: str = "hour") -> DataFrame:
    """Bars of one hour (or another ``unit``) per event type."""
    key = F.struct("ts", "event_id")
    return (
        ticks(spark, sf)
        .groupBy("market", "ticker", F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("h"))
        .agg(
            F.min_by("px", key).alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", key).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .withColumn("currency", market_currency())
        .withColumnRenamed("h", "ts")
    )


def corrupted_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars with fixed edits by day number, so that every cleaning and quality rule has work."""
    n = F.unix_date("d")
    base = bars_day(spark, sf).withColumn("n", n)
    edited = (
        base.withColumn("close", F.when(F.col("n") % 97 == 3, None).otherwise(F.col("close")))
        .withColumn("open", F.when(F.col("n") % 101 == 5, None).otherwise(F.col("open")))
        .withColumn("high", F.when(F.col("n") % 53 == 7, F.col("low") * 0.5).otherwise(F.col("high")))
        .withColumn("high", F.when(F.col("n") % 31 == 2, F.col("high") * (1 - 1e-8)).otherwise(F.col("high")))
        .withColumn("low", F.when(F.col("n") % 89 == 4, -F.col("low")).otherwise(F.col("low")))
        .withColumn(
            "volume",
            F.when(F.col("n") % 43 == 1, 0).when(F.col("n") % 47 == 1, None).otherwise(F.col("volume")),
        )
    )
    again = edited.filter("n % 61 = 0")
    return (
        edited.withColumn("copy", F.lit(0))
        .unionByName(again.withColumn("copy", F.lit(1)))
        .withColumn("ingest_seq", F.when((F.col("copy") == 1) & (F.col("n") % 122 == 0), F.col("n") * 2 - 7)
                    .otherwise(F.col("n") * 2 + F.col("copy")))
        .drop("n", "copy")
    )


def macro(spark: SparkSession, sf: str) -> DataFrame:
    """Daily mean of events.value as a macro series."""
    return (
        table(spark, sf, "events")
        .groupBy(F.to_date("ts").alias("d"))
        .agg(F.round(F.avg("value"), 6).alias("val"))
        .withColumn("series_id", F.lit("EVENT_MEAN"))
    )


def macro_long(spark: SparkSession, sf: str) -> DataFrame:
    """The macro series stretched over the years of the daily bars: one observation every 80 days."""
    series = macro(spark, sf)
    first = series.agg(F.min("d")).scalar()
    moved = F.date_add(F.lit("1995-01-02").cast("date"), F.datediff("d", first) * 80)
    return series.select(moved.alias("d"), "val")


CALM = 0.03


def calm(bars: DataFrame) -> DataFrame:
    """Bars whose price moves are damped to the size of real ones: 100 * p ** 0.03."""
    prices = {c: F.round(F.pow(F.col(c), F.lit(CALM)) * 100.0, 6) for c in ("open", "high", "low", "close")}
    return bars.withColumns(prices)


def duration_points(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals as filed fundamentals: quarterly, half-yearly and yearly points with filing lags."""
    orders = table(spark, sf, "orders")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    base = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        nation_ticker("c_nationkey").alias("ticker"),
        nation_market("c_nationkey").alias("market"),
        F.to_date("o_orderdate").alias("od"),
        (F.col("o_custkey") % 4).alias("lot"),
        "o_totalprice",
    )
    quarter = F.trunc("od", "quarter")
    year = F.trunc("od", "year")

    def cut(start: Column, stop: Column, form: str) -> Column:
        return F.struct(start.alias("start"), stop.alias("stop"), F.lit(form).alias("form"))

    cuts = F.array(
        cut(quarter, F.add_months(quarter, 3), "10-Q"),
        cut(year, F.add_months(year, 6), "10-H"),
        cut(year, F.add_months(year, 12), "10-K"),
    )
    # one pass: each order counts in up to three periods; the last quarter is only reported through the year
    rows = base.select("*", F.explode(cuts).alias("c")).filter(
        (F.col("od") < F.col("c.stop")) & ((F.col("c.form") != "10-Q") | (F.month("od") <= 9))
    )
    return rows.groupBy(
        "ticker",
        "market",
        F.col("c.start").alias("start"),
        F.date_sub("c.stop", 1).alias("period_end"),
        F.date_add("c.stop", F.lit(20) + F.col("lot").cast("int") * 13).alias("filed"),
        F.col("c.form").alias("form"),
        F.year("c.start").alias("fy"),
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("val"))


def news(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as news items of the event types."""
    docs = table(spark, sf, "documents")
    total = docs.agg(F.count(F.lit(1))).scalar()
    kinds = table(spark, sf, "events").select("event_type").distinct().agg(
        F.array_sort(F.collect_list("event_type"))
    ).scalar()
    return (
        docs.withColumn("n", total).withColumn("kinds", kinds)
        .select(
            F.col("doc_id").cast("string").alias("id"),
            F.get("kinds", F.pmod(F.length("source") + F.ascii(F.reverse("source")), F.size("kinds"))).alias("ticker"),
            F.col("text").alias("title"),
            F.timestamp_seconds(
                F.lit(1704067200) + F.floor(F.col("doc_id") * F.lit(30 * 86400) / F.col("n"))
            ).alias("published_at"),
            F.col("source").alias("provider"),
        )
        .withColumn("market", F.when(F.length("ticker") % 2 == 0, "NASDAQ").otherwise("KOSPI"))
    )


def funding(spark: SparkSession, sf: str) -> DataFrame:
    """Funding ticks of five coins from events: epoch milliseconds and a signed rate."""
    events = table(spark, sf, "events")
    mean = events.agg(F.round(F.avg("value"), 6)).scalar()
    return events.withColumn("m", mean).select(
        F.col("event_type").alias("coin"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"),
        ((F.col("value") - F.col("m")) / 1000.0).alias("rate"),
    )
