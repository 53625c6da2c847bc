"""Extension points: signal sources, cost models. (Signals, indicators and scorers register in
``functions.signals``, ``functions.indicators`` and ``operators.news``.)"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.functions.columns import flat_commission, market_commission, with_costs


@dataclass(frozen=True)
class SignalSource:
    """Bars in, long signal rows out: source, market, ticker, time, score, confidence, horizon."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    supports_backtest: bool = True


SOURCES: dict[str, SignalSource] = {}


def register_source(source: SignalSource) -> None:
    SOURCES[source.name] = source


def run_sources(bars: DataFrame, names: list[str], backtest: bool = False) -> DataFrame:
    """Union of the named sources; asking a live-only source for a backtest fails when the plan is built."""
    live_only = [n for n in names if backtest and not SOURCES[n].supports_backtest]
    if live_only:
        raise ValueError(f"sources without backtest support: {live_only}")
    columns = ("source", "market", "ticker", "ts", "score", "confidence", "horizon")
    out = None
    for n in names:
        rows = SOURCES[n].run(bars).select(*columns)
        out = rows if out is None else out.unionByName(rows)
    return out


CostModel = Callable[[DataFrame], DataFrame]


def market_costs(fills: DataFrame) -> DataFrame:
    """Fills with ``cost`` by their market's rates."""
    priced = with_costs(fills)
    return priced.select(*fills.columns, market_commission(F.col("price"), F.col("quantity"), F.col("side")).alias("cost"))


def flat_costs(bps: float) -> CostModel:
    return lambda fills: fills.withColumn("cost", flat_commission(F.col("price"), F.col("quantity"), bps))


def custom_costs(rule: Callable[[Column, Column, Column, Column], Column]) -> CostModel:
    """A cost model from any column function of price, quantity, market and side."""
    return lambda fills: fills.withColumn("cost", rule(F.col("price"), F.col("quantity"), F.col("market"), F.col("side")))
