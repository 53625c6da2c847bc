"""Portfolio construction: rebalance dates, momentum top-k, weights, costs, threshold grids, funding basket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barquet.functions.columns import market_commission, with_costs
from barquet.operators import fusion, ledger
from barquet.operators.indexing import vol_scalar
from barquet.operators.returns import (
    calendar, compounded, drawdowns, equal_period_return, log_metrics, max_drawdown, period_metrics, period_return, total_return,
)
from barquet.operators.scan import SYMBOL, framed, in_order, running
from barquet.session import staged
from barquet.sources.ingest import first_n

INIT = 10_000_000.0


def rebalance_dates(cal: DataFrame) -> DataFrame:
    """First calendar date of each month, its signal date (the date before) and the next signal date.

    One row per month and panel: (market, k, signal_d, exec_d, next_signal_d).
    """
    by_date = W.partitionBy("market").orderBy("d")
    marked = cal.withColumn("signal_d", F.lag("d").over(by_date)).filter(F.month("signal_d") != F.month("d"))
    return marked.select(
        "market",
        (F.row_number().over(by_date) - 1).cast("long").alias("k"),
        "signal_d",
        F.col("d").alias("exec_d"),
        F.lead("signal_d").over(by_date).alias("next_signal_d"),
    )


def momentum_at_signals(bars: DataFrame, cal: DataFrame, rebalances: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """lag(skip)/lag(lookback) - 1 on the symbol's own bars up to each signal date.

    The lags are taken once for all bars; a bar answers for the signal dates from its own date to
    the day before the symbol's next bar, found by counting signal dates, not by a range join.
    """
    by_date = W.partitionBy("market").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    signals = rebalances.select("market", F.col("signal_d").alias("d"), F.lit(1).alias("_s"))
    counted = cal.join(signals, ["market", "d"], "left").select(
        "market", "d", F.coalesce(F.count("_s").over(by_date), F.lit(0)).alias("s")
    )
    total = rebalances.groupBy("market").agg(F.count(F.lit(1)).alias("_all"))

    def build(df: DataFrame, f) -> DataFrame:
        score = F.try_divide(f.lag("close", skip) if skip else F.col("close"), f.lag("close", lookback)) - 1.0
        return df.withColumn("score", score).withColumn("next_d", f.lead("d"))

    scored = framed(bars.select(*SYMBOL, "d", "close"), build, back=lookback, ahead=1)
    placed = (
        scored.join(counted.withColumnRenamed("s", "_from"), ["market", "d"])
        .join(counted.select("market", F.col("d").alias("next_d"), F.col("s").alias("_to")), ["market", "next_d"], "left")
        .join(total, "market")
        .withColumn("_to", F.coalesce("_to", "_all") - 1)
        .filter("_from <= _to AND score IS NOT NULL")
    )
    return placed.select(*SYMBOL, "score", F.explode(F.sequence("_from", "_to")).alias("k"))


def top_k(scores: DataFrame, pct: float, min_k: int, max_k: int, group: Sequence[str] = ("market", "k")) -> DataFrame:
    """The best k = max(min_k, min(max_k, ceil(n * pct))) names; none when n < min_k. Ties go by ticker.

    k never exceeds max(min_k, max_k), so each task forwards at most that many rows per group.
    """
    group = list(group)
    size = scores.groupBy(*group).agg(F.count(F.lit(1)).alias("eligible")).filter(F.col("eligible") >= min_k)
    k = F.greatest(F.lit(min_k), F.least(F.lit(max_k), F.ceil(F.col("eligible") * F.lit(pct))))
    best = first_n(scores, max(min_k, max_k), group, [F.col("score").desc(), "ticker"])
    return best.join(size, group).withColumn("held_k", F.least(k, F.col("eligible"))).filter("rank <= held_k")


def selections(
    bars: DataFrame, lookback: int, skip: int, pct: float, min_k: int, max_k: int
) -> tuple[DataFrame, DataFrame]:
    """(rebalances, picks) of the monthly momentum strategy, staged: several steps read them."""
    cal = staged(calendar(bars))
    rebalances = staged(rebalance_dates(cal))
    picks = staged(top_k(momentum_at_signals(bars, cal, rebalances, lookback, skip), pct, min_k, max_k))
    return rebalances, picks


def _spans(rebalances: DataFrame, names: DataFrame) -> DataFrame:
    held = rebalances.filter("next_signal_d IS NOT NULL").select(
        "market", "k", F.col("signal_d").alias("d0"), F.col("next_signal_d").alias("d1")
    )
    return names.join(held, ["market", "k"])


def equal_weight_backtest(
    bars: DataFrame, lookback: int = 252, skip: int = 21, pct: float = 0.10, min_k: int = 5, max_k: int = 20,
) -> DataFrame:
    """Monthly returns of the top-k strategy and of the whole basket: (market, k, d, strategy, r)."""
    rebalances, picks = selections(bars, lookback, skip, pct, min_k, max_k)
    strategy = equal_period_return(_spans(rebalances, picks.select(*SYMBOL, "k")), bars, ["market", "k"])
    priced = bars.filter("close > 0").select(*SYMBOL, F.col("d").alias("signal_d"))
    basket = priced.join(rebalances.select("market", "k", "signal_d"), ["market", "signal_d"]).select(*SYMBOL, "k")
    benchmark = equal_period_return(_spans(rebalances, basket), bars, ["market", "k"])
    months = rebalances.filter("next_signal_d IS NOT NULL").select("market", "k", F.col("next_signal_d").alias("d"))

    def line(name: str, returns: DataFrame) -> DataFrame:
        return months.join(returns, ["market", "k"], "left").select(
            F.lit(name).alias("strategy"), "market", "k", "d", F.coalesce("r", F.lit(0.0)).alias("r")
        )

    return line("strategy", strategy).unionByName(line("benchmark", benchmark))


def backtest_metrics(monthly: DataFrame, init: float = INIT) -> DataFrame:
    """Compounded curve and its period metrics per strategy and market."""
    keys = ["strategy", "market"]
    curve = compounded(monthly, "r", keys, ("d",), start=init)
    return period_metrics(curve, monthly, keys, "d", init=init)


def weight_changes(picks: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Old and new weight of every name in either of two consecutive rebalances."""
    new = picks.select(*SYMBOL, "k", (F.lit(1.0) / F.col("held_k")).alias("w_new"))
    last = rebalances.groupBy("market").agg(F.max("k").alias("_last"))
    old = (
        new.select(*SYMBOL, (F.col("k") + 1).alias("k"), F.col("w_new").alias("w_old"))
        .join(last, "market").filter("k <= _last").drop("_last")
    )
    return new.join(old, [*SYMBOL, "k"], "full_outer").select(
        *SYMBOL, "k", F.coalesce("w_old", F.lit(0.0)).alias("w_old"), F.coalesce("w_new", F.lit(0.0)).alias("w_new")
    )


def turnover(changes: DataFrame, group: Sequence[str] = ("market", "k")) -> DataFrame:
    return changes.groupBy(*group).agg((F.sum(F.abs(F.col("w_new") - F.col("w_old"))) / 2.0).alias("turnover"))


def cost_fractions(changes: DataFrame, group: Sequence[str] = ("market", "k")) -> DataFrame:
    """Cost of the weight changes as a share of the portfolio; the weight change is the notional."""
    delta = F.col("w_new") - F.col("w_old")
    traded = with_costs(changes.withColumn("_d", delta).filter(F.abs("_d") >= 1e-10))
    cost = market_commission(F.abs("_d"), F.lit(1), F.when(F.col("_d") > 0, "BUY").otherwise("SELL"))
    return traded.groupBy(*group).agg(F.sum(cost).alias("cost"))


def momentum_backtest(
    bars: DataFrame, lookback: int = 252, skip: int = 21, pct: float = 0.3, min_k: int = 3, max_k: int = 6, init: float = INIT
) -> tuple[DataFrame, DataFrame]:
    """(rebalance log, steps) of the weighted strategy with turnover and costs, per market.

    A step is a point of the equity curve: at a rebalance the return of the past period, then the
    cost of the change; after the last rebalance the return to the last date.
    """
    rebalances, picks = selections(bars, lookback, skip, pct, min_k, max_k)
    changes = staged(weight_changes(picks, rebalances))
    last = bars.groupBy("market").agg(F.max("d").alias("last_d"))
    spans = rebalances.join(last, "market").select(
        "market", "k", F.col("signal_d").alias("d0"),
        F.coalesce("next_signal_d", F.when(F.col("last_d") > F.col("exec_d"), F.col("last_d"))).alias("d1"),
    ).filter("d1 IS NOT NULL")
    held = picks.select(*SYMBOL, "k", (F.lit(1.0) / F.col("held_k")).alias("w")).join(spans, ["market", "k"])
    earned = spans.join(period_return(held, bars, ["market", "k"]), ["market", "k"], "left").select(
        "market", "k", "d1", F.coalesce("r", F.lit(0.0)).alias("r")
    )
    sizes = picks.groupBy("market", "k").agg(F.max("held_k").cast("long").alias("held"), F.max("eligible").alias("eligible"))
    zero = F.lit(0.0)
    log = (
        rebalances.join(turnover(changes), ["market", "k"], "left")
        .join(cost_fractions(changes), ["market", "k"], "left")
        .join(sizes, ["market", "k"], "left")
        .join(earned.select("market", (F.col("k") + 1).alias("k"), F.col("r").alias("period_r")), ["market", "k"], "left")
        .select(
            "market", "k", "signal_d", "exec_d", F.coalesce("held", F.lit(0).cast("long")).alias("held"),
            F.coalesce("turnover", zero).alias("turnover"), F.coalesce("cost", zero).alias("cost"), "period_r",
        )
    )
    points = log.select(
        "market", F.col("exec_d").alias("d"), "period_r",
        ((1.0 + F.coalesce("period_r", zero)) * (1.0 - F.col("cost")) - 1.0).alias("step"),
    )
    final_k = rebalances.groupBy("market").agg(F.max("k").alias("k"))
    tail = earned.join(final_k, ["market", "k"]).join(last, "market").filter("d1 = last_d").select(
        "market", F.col("d1").alias("d"), F.col("r").alias("period_r"), F.col("r").alias("step")
    )
    return log, compounded(points.unionByName(tail), "step", ["market"], ("d",), start=init)


def momentum_metrics(log: DataFrame, curve: DataFrame, init: float = INIT) -> DataFrame:
    """Period metrics of the curve with turnover and holdings statistics."""
    base = period_metrics(curve.select("market", "d", "equity"), curve.select("market", "d", F.col("period_r").alias("r")), init=init)
    extra = log.groupBy("market").agg(
        F.avg("turnover").alias("avg_monthly_turnover"),
        F.sum("turnover").alias("total_turnover"),
        F.avg("held").alias("avg_holdings"),
        F.min("held").alias("min_holdings"),
        F.max("held").alias("max_holdings"),
    )
    return base.join(extra, "market")


def metric_differences(strategy: DataFrame, benchmark: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    names = ("cagr", "ann_vol", "sharpe", "max_dd", "calmar", "monthly_hit_rate")
    other = benchmark.select(*keys, *[F.col(n).alias(f"_{n}") for n in names])
    return strategy.join(other, list(keys)).select(*keys, *[(F.col(n) - F.col(f"_{n}")).alias(f"diff_{n}") for n in names])


# ---- sizing --------------------------------------------------------------------------------------


def risk_sized(
    target: Column, killed: Column, atr: Column, close: Column, market_weight: Column, position_weight: Column,
    position: Column, open_positions: Column, cap: Column, max_symbol_weight: float = 0.2, target_atr_pct: float = 0.02,
    max_positions: int | None = None,
) -> Column:
    """Target weight after kill switch, symbol cap, volatility scaling, market room and position limit."""
    atr_pct = F.when(close > 0, atr / close)
    w = F.least(target, F.lit(max_symbol_weight))
    w = w * F.when(atr_pct > 0, F.least(F.lit(1.0), F.lit(target_atr_pct) / atr_pct)).otherwise(1.0)
    room = F.greatest(F.lit(0.0), cap - (market_weight - position_weight))
    w = F.when(cap.isNotNull(), F.least(w, room)).otherwise(w)
    if max_positions is not None:
        w = F.when((position == 0) & (open_positions >= max_positions), 0.0).otherwise(w)
    return F.when((target <= 0) | killed, 0.0).otherwise(F.greatest(F.lit(0.0), w))


def share_deltas(targets: DataFrame) -> DataFrame:
    """Whole shares to trade: floor(weight * equity / price) less the position; no row for no trade.

    Reads target_weight, equity_krw, price_krw and position.
    """
    aim = F.floor(F.col("target_weight") * F.col("equity_krw") / F.col("price_krw"))
    delta = F.when(F.col("price_krw") > 0, aim - F.col("position"))
    return (
        targets.withColumn("_delta", delta).filter("_delta <> 0")
        .withColumn("side", F.when(F.col("_delta") > 0, "BUY").otherwise("SELL"))
        .withColumn("quantity", F.abs("_delta"))
        .drop("_delta")
    )


def rebalance_decisions(accounts: DataFrame, min_trade: int = 1, band: float = 0.05) -> DataFrame:
    """HOLD / BUY / SELL toward exposure x equity with a weight band, buys capped by cash.

    Reads exposure, price, cash, shares, equity_krw (NULL: cash plus own position).
    """
    price, cash, shares = F.col("price"), F.col("cash"), F.col("shares")
    equity = F.coalesce("equity_krw", cash + shares * price)
    aim = F.floor(F.greatest(F.lit(0.0), F.col("exposure")) * equity / F.nullif(price, F.lit(0.0)))
    affordable = shares + F.floor(cash / F.nullif(price, F.lit(0.0)))
    capped = F.when(aim > shares, F.least(aim, affordable)).otherwise(aim)
    good = price > 0
    df = accounts.withColumn("target_shares", F.when(good, capped).otherwise(shares).cast("long"))
    df = df.withColumn("_delta", F.col("target_shares") - shares)
    weight = lambda n: F.when(equity > 0, n * price / equity).otherwise(0.0)
    df = df.withColumn("cur_weight", F.when(good, weight(shares))).withColumn("tgt_weight", F.when(good, weight(F.col("target_shares"))))
    within = (F.abs("_delta") < min_trade) | (F.abs(F.col("tgt_weight") - F.col("cur_weight")) < band)
    reason = F.when(~good, "bad price").when(within, "within band").otherwise("rebalance")
    side = F.when(~good | within, "HOLD").when(F.col("_delta") > 0, "BUY").otherwise("SELL")
    return df.withColumn("side", side).withColumn("reason", reason).withColumn(
        "qty", F.when(F.col("side") == "HOLD", F.lit(0)).otherwise(F.abs("_delta")).cast("long")
    ).drop("_delta")


# ---- threshold grid ----------------------------------------------------------------------------------


def grid_weights(scores: DataFrame, thresholds: Sequence[float], leave: float = 0.0, order: str = "ts") -> DataFrame:
    """Held weight per strategy and threshold: scores(strategy, market, ticker, order, combined)."""
    spread = scores.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    s = F.col("combined")
    marked = spread.withColumn("_w", F.when(s >= F.col("threshold"), s).when(s <= leave, 0.0))
    held = running(marked, {"_held": ("last", "_w")}, ["strategy", "threshold", *SYMBOL], (order,))
    return held.withColumn("weight", F.coalesce("_held", F.lit(0.0))).drop("_w", "_held")


def grid_returns(
    weights: DataFrame, bars: DataFrame, strategies: Sequence[str], thresholds: Sequence[float], order: str = "ts"
) -> DataFrame:
    """Per bar and symbol: the weight decided at the last close is held from this open to the next open
    (to the close on the symbol's last bar), net of the cost of changing it.

    Adds ``active`` (weight held), ``traded`` and ``r``.
    """
    run = ["strategy", "threshold"]
    prices = framed(
        bars.select(*SYMBOL, order, "open", "close"),
        lambda df, f: df.withColumn("next_open", F.coalesce(f.lead("open"), F.col("close"))),
        order=(order,),
        ahead=1,
    ).drop("pos", "close")
    every = prices.withColumn("strategy", F.explode(F.array(*[F.lit(n) for n in strategies]))).withColumn(
        "threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    )
    placed = every.join(weights.select(*run, *SYMBOL, order, "weight"), [*run, *SYMBOL, order], "left")

    def build(df: DataFrame, f) -> DataFrame:
        decided = F.coalesce(f.lag("weight", 1), F.lit(0.0))
        before = F.coalesce(f.lag("weight", 2), F.lit(0.0))
        return df.withColumn("active", decided).withColumn("_change", decided - before)

    moved = with_costs(framed(placed, build, keys=[*run, *SYMBOL], order=(order,), back=2).drop("pos"))
    cost = market_commission(F.abs("_change"), F.lit(1), F.when(F.col("_change") > 0, "BUY").otherwise("SELL"))
    traded = F.abs("_change") > 1e-12
    return moved.select(
        *run, *SYMBOL, order, "active",
        F.when(traded, 1).otherwise(0).alias("traded"),
        (F.col("active") * (F.col("next_open") / F.col("open") - 1.0) - F.when(traded, cost).otherwise(0.0)).alias("r"),
    )


def grid_equity(returns: DataFrame, symbols: int | Column, init: float = INIT, order: str = "ts") -> DataFrame:
    """Equity per strategy and threshold: capital split equally over the symbols."""
    run = ["strategy", "threshold"]
    per_bar = returns.groupBy(*run, order).agg(F.sum("r").alias("_s"))
    size = symbols if isinstance(symbols, Column) else F.lit(float(symbols))
    return compounded(per_bar.withColumn("r", F.col("_s") / size).drop("_s"), "r", run, (order,), start=init)


def grid_report(returns: DataFrame, equity: DataFrame, order: str = "ts") -> DataFrame:
    """Trades, return, drawdown, exposure, mean holding and final equity per strategy and threshold."""
    run = ["strategy", "threshold"]
    # one order over all symbols of a run, cut once for both measures
    flags = in_order(ledger.open_flags(returns, [*run, *SYMBOL], order, "active"), run, (order, "ticker", "market"))
    trades = returns.groupBy(*run).agg(F.sum("traded").alias("trades"))
    final = equity.groupBy(*run).agg(F.max_by("equity", order).alias("final_equity"))
    parts = [
        total_return(equity, keys=run, order=order),
        max_drawdown(equity, keys=run, order=(order,)),
        ledger.exposure(flags, run, (order, "ticker", "market")),
        ledger.holding_periods(flags, run, (order, "ticker", "market"), SYMBOL),
        final,
    ]
    out = trades
    for part in parts:
        out = out.join(part, run)
    return out


def sleeve_equity(curves: Mapping[str, DataFrame], shares: Mapping[str, float], order: str = "ts") -> DataFrame:
    """Capital split over sleeves: each curve scaled by its share, summed per time."""
    parts = [c.select(order, (F.col("equity") * shares[name]).alias("equity")) for name, c in curves.items()]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy(order).agg(F.sum("equity").alias("equity"))


def vol_target_comparison(returns: DataFrame, target: float, keys: Sequence[str] = ("market",), order: str = "d", init: float = INIT) -> DataFrame:
    """Log metrics of a return series with the volatility scalar off and on, and the differences."""
    keys = list(keys)
    scaled = vol_scalar(returns.select(*keys, order, "r"), target, keys=keys, order=order)
    off = log_metrics(compounded(returns.select(*keys, order, "r"), "r", keys, (order,), start=init), keys=keys, order=order)
    on_r = scaled.select(*keys, order, (F.col("r") * F.col("scalar")).alias("r"))
    on = log_metrics(compounded(on_r, "r", keys, (order,), start=init), keys=keys, order=order)
    names = ("cagr", "max_drawdown", "sharpe", "vol", "calmar")
    both = off.select(*keys, *[F.col(n).alias(f"{n}_off") for n in names]).join(
        on.select(*keys, *[F.col(n).alias(f"{n}_on") for n in names]), keys
    )
    return both.select("*", *[(F.col(f"{n}_on") - F.col(f"{n}_off")).alias(f"{n}_delta") for n in names])


# ---- funding basket ------------------------------------------------------------------------------------


def trailing_funding(daily: DataFrame, days: int = 7, min_obs: int = 3) -> DataFrame:
    """Mean of the last ``days`` calendar days' rates; NULL with too few of them.

    Days are cut into blocks of a year with ``days`` of overlap, so no coin's history is one task.
    """
    size = 365
    n = F.unix_date("d")
    own = F.floor(n / F.lit(size))
    cut = daily.withColumn("_n", n).withColumn("_own", own).withColumn(
        "_blk", F.explode(F.array_distinct(F.array(own, F.floor((n + days - 1) / F.lit(size)))))
    )
    w = W.partitionBy("coin", "_blk").orderBy("_n").rangeBetween(-(days - 1), 0)
    need = max(min_obs, days // 2)
    trail = F.when(F.count("rate").over(w) >= need, F.avg("rate").over(w))
    return cut.withColumn("trail", trail).filter("_own = _blk").drop("_n", "_own", "_blk")


def funding_basket(daily: DataFrame, periods: DataFrame, rebalance: int = 7, taker: float = 0.001) -> DataFrame:
    """Daily return per period of holding the coins whose trailing funding is positive.

    periods(period, start, end). On every ``rebalance``-th date the holdings are chosen anew; the cost
    is 2 x taker x (changed names / names before or after).
    """
    trail = trailing_funding(daily)
    dates = (
        daily.select("d").distinct().join(periods, (F.col("d") >= F.col("start")) & (F.col("d") <= F.col("end")))
        .select("period", "d")
    )
    by_date = W.partitionBy("period").orderBy("d")
    placed = dates.withColumn("i", F.row_number().over(by_date) - 1).withColumn("cycle", F.floor(F.col("i") / F.lit(rebalance)))
    starts = placed.filter(F.col("i") % rebalance == 0).select("period", "cycle", "d")
    chosen = trail.filter("trail > 0").join(starts, "d").select("period", "cycle", "coin")
    # names before or after each rebalance, and how many changed
    before = chosen.withColumn("cycle", F.col("cycle") + 1).withColumn("was", F.lit(1))
    union = chosen.withColumn("now", F.lit(1)).join(before, ["period", "cycle", "coin"], "full_outer")
    changed = F.count_if(F.col("now").isNull() | F.col("was").isNull())
    costs = union.groupBy("period", "cycle").agg((2.0 * taker * changed / F.count(F.lit(1))).alias("cost"))
    earned = (
        placed.join(chosen, ["period", "cycle"]).join(daily.select("coin", "d", "rate"), ["coin", "d"])
        .groupBy("period", "d").agg(F.avg("rate").alias("_f"))
    )
    paid = starts.join(costs, ["period", "cycle"], "left").select("period", "d", "cost")
    zero = F.lit(0.0)
    return placed.join(earned, ["period", "d"], "left").join(paid, ["period", "d"], "left").select(
        "period", "d", (F.coalesce("_f", zero) - F.coalesce("cost", zero)).alias("r")
    )


def funding_metrics(daily_returns: DataFrame, min_days: int = 5) -> DataFrame:
    """CAGR and Sharpe on 365 days with the population deviation; drawdown of the compounded curve."""
    curve = drawdowns(compounded(daily_returns, "r", ["period"], ("d",)), "equity", ["period"], ("d",))
    n, sd = F.count(F.lit(1)), F.stddev_pop("r")
    return curve.groupBy("period").agg(
        n.alias("n_days"),
        (F.pow(F.max_by("equity", "d"), F.lit(365.0) / n) - 1.0).alias("cagr"),
        F.when(sd > 0, F.avg("r") / sd * F.sqrt(F.lit(365.0))).otherwise(0.0).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.max_by("equity", "d").alias("final_equity"),
    ).filter(F.col("n_days") >= min_days)


def symmetric_share(old: Column, new: Column) -> Column:
    """Changed names over all names of two holdings arrays; 0 when both are empty."""
    changed = F.size(F.array_except(old, new)) + F.size(F.array_except(new, old))
    return changed / F.greatest(F.lit(1), F.size(F.array_union(old, new)))


def combined_grid_scores(signals: DataFrame, strategies: Mapping[str, Sequence[str]], weights=None, order: str = "ts") -> DataFrame:
    """Fused scores per strategy, a strategy being a set of sources."""
    pairs = [(name, source) for name, sources in strategies.items() for source in sources]
    table = signals.sparkSession.createDataFrame(pairs, "strategy string, source string")
    return fusion.combined(signals.join(F.broadcast(table), "source"), weights, order, by=("strategy",))
