"""Fill ledger: cash, positions, equity, weights, holding periods, cost comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barquet.functions.columns import Slippage, market_commission, to_krw, with_costs
from barquet.operators.scan import PART, SYMBOL, framed, in_order, running, with_position
from barquet.session import staged

FX = {"KRW": 1.0, "USD": 1300.0}


def signed(side: Column, quantity: Column) -> Column:
    return F.when(side == "BUY", quantity).otherwise(-quantity)


def cash_flow(fills: DataFrame, rates: Mapping[str, float] = FX) -> DataFrame:
    """Cash effect of each fill in KRW and its signed quantity."""
    flow = fills.withColumn("_flow", -signed(F.col("side"), F.col("price") * F.col("quantity")) - F.col("commission"))
    return (
        to_krw(flow, ["_flow"], rates)
        .withColumnRenamed("_flow_krw", "flow_krw")
        .withColumn("delta_qty", signed(F.col("side"), F.col("quantity")))
        .drop("_flow")
    )


def apply_fills(
    fills: DataFrame, order: Sequence[str] = ("d", "k"), initial_cash: float = 0.0, rates: Mapping[str, float] = FX,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Cash and position after each fill, by running sums in fill order.

    An account is the largest key there is; its fills are cut into range parts of the whole order, so
    neither an account nor one time of it has to fit in a task. Both sums start from one small table, the totals
    of the parts before, and share one shuffle: a part of an account holds the part of each of its symbols.
    ``keep`` names the columns that go along beside keys and order (all, if not given).
    """
    account, keys = ["account"], ["account", *SYMBOL]
    flows = cash_flow(fills, rates)
    kept = list(dict.fromkeys([*keys, *order, *(fills.columns if keep is None else keep)]))
    flows = in_order(flows.select(*kept, "flow_krw", "delta_qty"), account, order)
    totals = staged(flows.groupBy(*keys, PART).agg(F.sum("flow_krw").alias("_flow"), F.sum("delta_qty").alias("_qty")), "totals")

    def earlier(rows: DataFrame, by: list[str], total: str, out: str) -> DataFrame:
        before = W.partitionBy(*by).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
        return rows.withColumn(out, F.sum(total).over(before)).drop("_flow", "_qty")

    cash = earlier(totals.groupBy(*account, PART).agg(F.sum("_flow").alias("_flow")), account, "_flow", "_cash")
    start = staged(earlier(totals, keys, "_qty", "_held").join(cash, [*account, PART]), "starts")

    def total(by: list[str], column: str, before: str) -> Column:
        here = F.sum(column).over(W.partitionBy(*by, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        known = here.isNotNull() | F.col(before).isNotNull()
        return F.when(known, F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)))

    return flows.join(start, [*keys, PART]).select(
        *kept, total(keys, "delta_qty", "_held").alias("position"), (F.lit(initial_cash) + total(account, "flow_krw", "_cash")).alias("cash_krw")
    )


def symbol_values(
    fills: DataFrame, bars: DataFrame, rates: Mapping[str, float] = FX, order: str = "d", within: Sequence[str] = ("k",)
) -> DataFrame:
    """Per account, symbol and event date: position, mark and value in KRW at the end of the date.

    The mark is the last close; until a bar arrives it is the price of the first fill. Events are the
    dates with fills, and the bars while a position is held; bars without a close make no row.

    A holding is an interval of bar positions: from the bar of a fill's date to the one before the next
    fill's. Its bars are found by position, so a closed position joins, shuffles and makes no rows.
    """
    keys = ["account", *SYMBOL]
    by_day = cash_flow(fills, rates).groupBy(*keys, "currency", order).agg(
        F.sum("delta_qty").alias("dq"),
        F.sum("flow_krw").alias("flow_krw"),
        F.min_by("price", F.struct(*within)).alias("first_price"),
    )
    by_day = staged(by_day, "fill-days")
    # the first fill's price stands in until a close is known
    opening = by_day.groupBy(*keys, "currency").agg(F.min_by("first_price", order).alias("_open_px"), F.min(order).alias("_since"))
    priced = bars.filter("close IS NOT NULL").select(*SYMBOL, order, "close")
    closes = staged(with_position(priced, SYMBOL, (order,), out="_at"), "closes")
    # how many closes a symbol has up to each date with fills
    dates = by_day.select(*SYMBOL, order).distinct().join(closes.select(*SYMBOL, order, "close"), [*SYMBOL, order], "full_outer")
    counted = running(dates, {"_upto": ("count", "close")}, SYMBOL, (order,)).select(
        *SYMBOL, order, "_upto", (F.col("_upto") - F.col("close").isNotNull().cast("long")).alias("_below")
    )
    size = closes.groupBy(*SYMBOL).agg(F.count(F.lit(1)).alias("_size"))
    held = running(by_day, {"position": ("sum", "dq")}, keys, (order,))
    spans = framed(
        held.join(counted, [*SYMBOL, order]),
        lambda df, f: df.withColumn("_until", f.lead("_below")),
        keys=keys,
        order=(order,),
        ahead=1,
    ).drop("pos").join(size, list(SYMBOL), "left").join(opening, [*keys, "currency"])
    first = F.col("_upto") - 1
    last = F.when(F.col("position") != 0, F.coalesce("_until", "_size", F.lit(0)) - 1).otherwise(first)
    spread = spans.withColumn("_at", F.explode(F.sequence(first, F.greatest(first, last)))).withColumn("_fill", F.col("_at") == first)
    marks = closes.withColumnRenamed(order, "_bar")
    found = spread.join(marks, [*SYMBOL, "_at"], "left")
    known = F.when(F.col("_bar") >= F.col("_since"), F.col("close"))
    found = found.withColumn("mark", F.coalesce(known, "_open_px")).withColumn("value", F.col("position") * F.col("mark"))
    return to_krw(found, ["value"], rates).select(
        *keys, "currency", F.when(F.col("_fill"), F.col(order)).otherwise(F.col("_bar")).alias(order), "position", "mark", "value_krw",
        F.when(F.col("_fill"), F.col("flow_krw")).otherwise(0.0).alias("flow_krw"),
    )


def equity_curve(values: DataFrame, initial_cash: float = 0.0, order: str = "d") -> DataFrame:
    """Account equity at each event date: a running sum of cash flows and changes in value.

    Only changes are added up, so no account x date grid is built.
    """
    changes = framed(
        values,
        lambda df, f: df.withColumn("_dv", F.col("value_krw") - F.coalesce(f.lag("value_krw"), F.lit(0.0))),
        keys=("account", *SYMBOL),
        order=(order,),
        back=1,
    )
    daily = changes.groupBy("account", order).agg(F.sum("flow_krw").alias("_f"), F.sum("_dv").alias("_v"))
    run = running(daily, {"_c": ("sum", "_f"), "market_value_krw": ("sum", "_v")}, ["account"], (order,), bounded=True)
    return run.select(
        "account",
        order,
        (F.lit(initial_cash) + F.col("_c")).alias("cash_krw"),
        "market_value_krw",
        (F.lit(initial_cash) + F.col("_c") + F.col("market_value_krw")).alias("equity_krw"),
    )


def latest_positions(values: DataFrame, order: str = "d") -> DataFrame:
    return values.groupBy("account", *SYMBOL).agg(
        F.max_by("position", order).alias("position"), F.max_by("value_krw", order).alias("value_krw")
    )


def weights(positions: DataFrame, equity: DataFrame) -> DataFrame:
    """Position and market weights and open positions; weights are 0 when equity is not positive."""
    total = positions.groupBy("account", "market").agg(F.sum("value_krw").alias("market_value"))
    held = positions.groupBy("account").agg(F.count_if(F.col("position") != 0).alias("open_positions"))
    ratio = lambda c: F.when(F.col("equity_krw") > 0, F.col(c) / F.col("equity_krw")).otherwise(0.0)
    return (
        positions.join(equity, "account").join(total, ["account", "market"]).join(held, "account")
        .select(
            "account", *SYMBOL, "position", "value_krw", ratio("value_krw").alias("position_weight"),
            ratio("market_value").alias("market_weight"), "open_positions",
        )
    )


def account_equity(cash: DataFrame, positions: DataFrame, usd_fx: float) -> DataFrame:
    """Domestic net asset less overseas cost plus overseas positions at their marks."""
    overseas = (
        positions.filter("market = 'NASDAQ'").groupBy("account")
        .agg(F.sum(F.col("qty") * F.col("mark") * usd_fx).alias("_o"))
    )
    return cash.join(overseas, "account", "left").select(
        "account", (F.col("nass_krw") - F.col("ovr_purchase_krw") + F.coalesce("_o", F.lit(0.0))).alias("equity_krw")
    )


def fill_costs(fills: DataFrame, slippage: Slippage = Slippage(enabled=True)) -> DataFrame:
    """Commission of each fill and its slippage."""
    priced = with_costs(fills)
    p, q = F.col("price"), F.col("quantity")
    return priced.select(
        *fills.columns,
        market_commission(p, q, F.col("side")).alias("cost"),
        slippage.cost(p, q, F.col("market")).alias("slippage"),
    )


def cost_comparison(fills: DataFrame, slippage: Slippage = Slippage(enabled=True), by: Sequence[str] = ("market",)) -> DataFrame:
    """Total cost without and with slippage, and the difference."""
    costs = fill_costs(fills, slippage)
    return costs.groupBy(*by).agg(
        F.sum("cost").alias("baseline_cost"),
        F.sum(F.col("cost") + F.col("slippage")).alias("pessimistic_cost"),
        F.sum("slippage").alias("delta_cost"),
    )


def open_flags(weights_: DataFrame, keys: Sequence[str] = SYMBOL, order: str = "ts", weight: str = "weight") -> DataFrame:
    """Whether the symbol is held after a bar, and the change of that flag (+1, 0, -1)."""
    flagged = weights_.withColumn("held", F.when(F.coalesce(F.col(weight), F.lit(0.0)) != 0, 1).otherwise(0))
    return framed(
        flagged,
        lambda df, f: df.withColumn("turn", F.col("held") - F.coalesce(f.lag("held"), F.lit(0))),
        keys=keys,
        order=(order,),
        back=1,
    ).drop("pos")


def exposure(flags: DataFrame, run: Sequence[str], order: Sequence[str] = ("ts", "ticker", "market")) -> DataFrame:
    """Share of bar events after which any symbol of the run is held. Bars may have any width."""
    counted = running(in_order(flags, run, order), {"_open": ("sum", "turn")}, list(run), order, part=PART)
    return counted.groupBy(*run).agg(F.avg(F.when(F.col("_open") > 0, 1.0).otherwise(0.0)).alias("exposure"))


def holding_periods(
    flags: DataFrame, run: Sequence[str], order: Sequence[str] = ("ts", "ticker", "market"), keys: Sequence[str] = SYMBOL
) -> DataFrame:
    """Mean holding length in bar events of the run; a position open at the end counts to the end."""
    run = list(run)
    placed = with_position(in_order(flags, run, order), run, order, out="bar_index", part=PART)
    size = placed.groupBy(*run).agg(F.count(F.lit(1)).alias("_n"))
    turns = placed.filter("turn <> 0")
    paired = framed(
        turns,
        lambda df, f: df.withColumn("_next", f.lead("bar_index")),
        keys=[*run, *keys],
        order=("bar_index",),
        ahead=1,
    )
    spans = paired.filter("turn = 1").join(size, run)
    length = F.coalesce("_next", "_n") - F.col("bar_index")
    held = spans.groupBy(*run).agg(F.count(F.lit(1)).alias("holdings"), F.avg(length).alias("avg_holding"))
    return size.select(*run).join(held, run, "left").select(
        *run, F.coalesce("holdings", F.lit(0).cast("long")).alias("holdings"), F.coalesce("avg_holding", F.lit(0.0)).alias("avg_holding")
    )
