"""Scalar column expressions: clamps, lenient casts, costs, prices, decay, text classes, hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def lenient_double(col: str | Column, default: float = 0.0) -> Column:
    """NULL, "" and "-" and anything that is no number give the default."""
    text = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(default))


def lenient_long(col: str | Column, default: int = 0) -> Column:
    """Integer by truncating the number; the default where there is none."""
    text = F.col(col) if isinstance(col, str) else col
    number = F.trim(text).try_cast("double")
    return F.coalesce(number.try_cast("long"), F.lit(default).cast("long"))


# Broker, tax and fee rates per market.
COSTS = {
    "KOSPI": dict(commission_bps=1.40527, buy_tax_bps=0.0, sell_tax_bps=20.0, sec_sell_bps=0.0,
                  taf_per_share=0.0, taf_cap=None, fx_bps=0.0),
    "NASDAQ": dict(commission_bps=25.0, buy_tax_bps=0.0, sell_tax_bps=0.0, sec_sell_bps=0.206,
                   taf_per_share=0.000195, taf_cap=9.79, fx_bps=10.0),
}
SLIPPAGE_BPS = {"KOSPI": 8.0, "NASDAQ": 3.0}
OPEN_CLOSE_EXTRA_BPS = 5.0

COST_SCHEMA = (
    "market string, commission_bps double, buy_tax_bps double, sell_tax_bps double, sec_sell_bps double, "
    "taf_per_share double, taf_cap double, fx_bps double"
)


def cost_table(spark: SparkSession, costs: Mapping[str, Mapping] = COSTS) -> DataFrame:
    """One row per market; small by construction."""
    names = [part.split()[0] for part in COST_SCHEMA.split(", ")][1:]
    rows = [(market, *[rates[n] for n in names]) for market, rates in costs.items()]
    return spark.createDataFrame(rows, COST_SCHEMA)


def with_costs(df: DataFrame, costs: Mapping[str, Mapping] = COSTS) -> DataFrame:
    """Attach the market's rates; a market without rates fails the job."""
    joined = df.join(F.broadcast(cost_table(df.sparkSession, costs)), "market", "left")
    checked = F.when(
        F.col("commission_bps").isNull(),
        F.raise_error(F.concat(F.lit("no cost rates for market "), F.coalesce("market", F.lit("NULL")))).cast("double"),
    ).otherwise(F.col("commission_bps"))
    return joined.withColumn("commission_bps", checked)


def market_commission(price: Column, quantity: Column, side: Column) -> Column:
    """Commission, taxes, currency spread and the capped per-share sell fee; rates from ``with_costs``."""
    selling = side == "SELL"
    notional = price * quantity
    bps = F.col("commission_bps") + F.when(selling, F.col("sell_tax_bps") + F.col("sec_sell_bps")).otherwise(
        F.col("buy_tax_bps")
    )
    per_share = F.col("taf_per_share") * quantity
    capped = F.when(F.col("taf_cap").isNull(), per_share).otherwise(F.least(per_share, F.col("taf_cap")))
    fee = F.when(selling & (F.col("taf_per_share") > 0), capped).otherwise(0.0)
    return notional * bps / 10_000.0 + notional * F.col("fx_bps") / 10_000.0 + fee


def flat_commission(price: Column, quantity: Column, bps: float) -> Column:
    return price * quantity * (bps / 10_000.0)


@dataclass(frozen=True)
class Slippage:
    """Adverse-fill cost in basis points; nothing unless enabled."""

    enabled: bool = False
    extra_bps: float = OPEN_CLOSE_EXTRA_BPS

    def cost(self, price: Column, quantity: Column, market: Column, at_open_or_close: bool = True) -> Column:
        if not self.enabled:
            return F.lit(0.0)
        spread = F.coalesce(*[F.when(market == m, F.lit(b)) for m, b in SLIPPAGE_BPS.items()], F.lit(0.0))
        return price * quantity * (spread + F.lit(self.extra_bps if at_open_or_close else 0.0)) / 10_000.0


def to_krw(df: DataFrame, amounts: Sequence[str], rates: Mapping[str, float], currency: str = "currency") -> DataFrame:
    """Convert amount columns (``x`` -> ``x_krw``) by currency; an unknown currency fails the job."""
    table = df.sparkSession.createDataFrame(list(rates.items()), f"{currency} string, _fx double")
    joined = df.join(F.broadcast(table), currency, "left")
    rate = F.when(
        F.col("_fx").isNull(),
        F.raise_error(F.concat(F.lit("no rate for currency "), F.coalesce(currency, F.lit("NULL")))).cast("double"),
    ).otherwise(F.col("_fx"))
    return joined.select(*df.columns, *[(F.col(a) * rate).alias(f"{a}_krw") for a in amounts])


def protective_limit(side: Column, close: Column, band: float = 0.01) -> Column:
    return F.bround(F.when(side == "BUY", close * (1.0 + band)).otherwise(close * (1.0 - band)), 2)


def half_life_weight(age_days: Column, half_life: float = 3.0) -> Column:
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / half_life)


# Title keywords of the rule-based sentiment.
BULLISH = ("beats", "surge", "jumps", "record", "upgrade")
BEARISH = ("miss", "plunge", "falls", "downgrade", "probe", "lawsuit")


def keyword_sentiment(title: Column, bullish: Sequence[str] = BULLISH, bearish: Sequence[str] = BEARISH) -> Column:
    """STRUCT<score, confidence>; bullish words win over bearish ones."""
    text = F.lower(title)

    def any_of(words: Sequence[str]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(text, F.lit(word))
        return hit

    def pair(score: float, confidence: float) -> Column:
        return F.struct(F.lit(score).alias("score"), F.lit(confidence).alias("confidence"))

    return F.when(any_of(bullish), pair(0.7, 0.7)).when(any_of(bearish), pair(-0.7, 0.7)).otherwise(pair(0.0, 0.2))


# Markers in broker error messages.
TRANSIENT = ("초당 거래건수", "EGW00201", "일시", "timeout", "잠시 후")
TERMINAL = ("해당업무 미제공", "장시작전", "장종료", "수량", "잔고", "매수가능", "거부")


def error_class(message: Column, transient: Sequence[str] = TRANSIENT, terminal: Sequence[str] = TERMINAL) -> Column:
    def any_of(marks: Sequence[str]) -> Column:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(message, F.lit(mark))
        return hit

    return F.when(any_of(transient), "TRANSIENT").when(any_of(terminal), "TERMINAL").otherwise("UNKNOWN")


def canonical_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the JSON of the columns in name order; maps are sorted by key first."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def sorted_map(col: str | Column) -> Column:
    """The map with its entries in key order, so that its JSON is canonical."""
    return F.map_from_entries(F.array_sort(F.map_entries(col)))
