"""Portfolio, sizing, threshold-grid and funding-basket queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barquet.functions import indicators as ind
from barquet.operators import ledger
from barquet.operators import portfolio as pf
from barquet.operators import returns as rt
from barquet.operators.scan import PART, in_order, with_position
from barquet.plans.q_index import _ew
from barquet.plans.q_ledger import COMMISSION
from barquet.plans.q_signals import WEIGHTS
from barquet.plans.registry import query, rounded
from barquet.plans.views import define, with_views as sql
from barquet.session import staged
from barquet.sources import text
from barquet.sources.bridge import bars_day, bars_hour, calm, funding, nation_ticker, table

LOOK, SKIP, PCT, MIN_K, MAX_K = 252, 21, 0.3, 3, 6


def _bars(spark, sf):
    return staged(calm(bars_day(spark, sf)))


define(
    "rebal",
    """SELECT market, row_number() OVER (PARTITION BY market ORDER BY d) - 1 AS k, p AS signal_d, d AS exec_d, lead(p) OVER (PARTITION BY market ORDER BY d) AS next_signal_d
FROM (SELECT market, d, lag(d) OVER (PARTITION BY market ORDER BY d) AS p FROM cal) WHERE month(p) <> month(d)""",
    ("cal",),
)
define(
    "mom",
    f"""SELECT r.market, r.k, s.ticker, s.score FROM rebal r JOIN (SELECT DISTINCT market, ticker FROM calm) t ON t.market = r.market
ASOF JOIN (SELECT market, ticker, d, lag(close, {SKIP}) OVER w / lag(close, {LOOK}) OVER w - 1 AS score FROM calm WINDOW w AS (PARTITION BY market, ticker ORDER BY d)) s
 ON s.market = r.market AND s.ticker = t.ticker AND r.signal_d >= s.d WHERE s.score IS NOT NULL""",
    ("rebal", "calm"),
)


def picks_sql(pct: float, min_k: int, max_k: int) -> str:
    return f"""SELECT market, k, ticker, score, rn AS rank, n AS eligible, kk AS held_k FROM (SELECT *, least(n, greatest({min_k}, least({max_k}, CAST(ceil(n * {pct}) AS BIGINT)))) AS kk FROM (
SELECT *, count(*) OVER (PARTITION BY market, k) AS n, row_number() OVER (PARTITION BY market, k ORDER BY score DESC, ticker) AS rn FROM mom)) WHERE n >= {min_k} AND rn <= kk"""


define("picks", picks_sql(PCT, MIN_K, MAX_K), ("mom",))
define("picks8", picks_sql(0.1, 3, 20), ("mom",))
define("spans_k", "SELECT market, k, signal_d AS d0, next_signal_d AS d1 FROM rebal WHERE next_signal_d IS NOT NULL", ("rebal",))
MOVE = "CASE WHEN a.close > 0 AND b.close IS NOT NULL THEN b.close / a.close - 1 END"
JOIN_PX = """LEFT JOIN calm a ON a.market = h.market AND a.ticker = h.ticker AND a.d = s.d0 LEFT JOIN calm b ON b.market = h.market AND b.ticker = h.ticker AND b.d = s.d1"""
define(
    "ew8",
    f"""SELECT x.strategy, s.market, s.k, s.d1 AS d, coalesce(x.r, 0.0) AS r FROM spans_k s CROSS JOIN (SELECT unnest(['strategy', 'benchmark']) AS strategy) n LEFT JOIN (
SELECT 'strategy' AS strategy, s.market, s.k, coalesce(avg({MOVE}), 0) AS r FROM picks8 h JOIN spans_k s USING (market, k) {JOIN_PX} GROUP BY s.market, s.k
UNION ALL SELECT 'benchmark', s.market, s.k, coalesce(avg({MOVE}), 0) FROM spans_k s JOIN calm h ON h.market = s.market AND h.d = s.d0 {JOIN_PX} GROUP BY s.market, s.k) x
 ON x.strategy = n.strategy AND x.market = s.market AND x.k = s.k WHERE x.strategy IS NOT NULL
UNION ALL SELECT 'strategy', s.market, s.k, s.d1, 0.0 FROM spans_k s WHERE NOT EXISTS (SELECT 1 FROM picks8 p WHERE p.market = s.market AND p.k = s.k)""",
    ("spans_k", "picks8", "calm"),
)


def period_metrics_sql(curve: str, moves: str, keys: str) -> str:
    """curve(keys, d, equity), moves(keys, r)"""
    on = ", ".join(keys.split())
    return f"""SELECT {on}, start_date, end_date, round(end_value, 2) AS end_value, round(max_dd, 8) AS max_dd, n_months, round(ann_vol, 8) AS ann_vol, round(monthly_hit_rate, 8) AS monthly_hit_rate,
round(cagr, 8) + 0.0 AS cagr, round(cagr, 8) + 0.0 AS gross_cagr, round(cagr / ann_vol, 8) + 0.0 AS sharpe, round(cagr / max_dd, 8) + 0.0 AS calmar FROM (
SELECT *, power(end_value / 1e7, 1 / ((end_date - start_date) / 365.25)) - 1 AS cagr FROM (SELECT {on}, min(d) AS start_date, max(d) AS end_date, arg_max(equity, d) AS end_value, max((pk - equity) / pk) AS max_dd
 FROM (SELECT *, greatest(1e7, max(equity) OVER (PARTITION BY {on} ORDER BY d)) AS pk FROM {curve}) GROUP BY {on})
JOIN (SELECT {on}, count(r) AS n_months, sqrt(12 * var_samp(r)) AS ann_vol, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS monthly_hit_rate FROM {moves} GROUP BY {on}) USING ({on}))"""


define("ew8_curve", "SELECT strategy, market, d, r, 1e7 * product(1 + r) OVER (PARTITION BY strategy, market ORDER BY d) AS equity FROM ew8", ("ew8",))
define("ew8_metrics", period_metrics_sql("ew8_curve", "ew8", "strategy market"), ("ew8_curve", "ew8"))


@query("pf5_rebalance_dates", sql("rebal", "SELECT market, k, signal_d, exec_d, next_signal_d FROM rebal"))
def pf5(spark, sf):
    return pf.rebalance_dates(rt.calendar(_bars(spark, sf)))


@query("pf6_momentum_score", sql("mom", "SELECT market, k, ticker, round(score, 8) + 0.0 AS score FROM mom"))
def pf6(spark, sf):
    bars = _bars(spark, sf)
    cal = rt.calendar(bars)
    return rounded(pf.momentum_at_signals(bars, cal, pf.rebalance_dates(cal), LOOK, SKIP))


@query("pf7_top_k", sql("picks", "SELECT market, k, ticker, round(score, 8) + 0.0 AS score, rank, eligible, held_k FROM picks"))
def pf7(spark, sf):
    _, picks = pf.selections(_bars(spark, sf), LOOK, SKIP, PCT, MIN_K, MAX_K)
    return rounded(picks)


@query("ag16_equal_period_return", sql("ew8", "SELECT strategy, market, k, d, round(r, 8) + 0.0 AS r FROM ew8"))
def ag16(spark, sf):
    return rounded(pf.equal_weight_backtest(_bars(spark, sf), LOOK, SKIP, 0.1, 3, 20))


@query("pf8_equal_weight_backtest", sql("ew8_metrics", "SELECT * FROM ew8_metrics"))
def pf8(spark, sf):
    monthly = staged(pf.equal_weight_backtest(_bars(spark, sf), LOOK, SKIP, 0.1, 3, 20))
    return rounded(pf.backtest_metrics(monthly), end_value=2)


define(
    "changes",
    """SELECT market, k, ticker, coalesce(o.w, 0.0) AS w_old, coalesce(n.w, 0.0) AS w_new FROM (SELECT market, k, ticker, 1.0 / held_k AS w FROM picks) n
FULL JOIN (SELECT market, k + 1 AS k, ticker, 1.0 / held_k AS w FROM picks WHERE (market, k + 1) IN (SELECT (market, k) FROM rebal)) o USING (market, k, ticker)""",
    ("picks", "rebal"),
)
define("turn", "SELECT market, k, sum(abs(w_new - w_old)) / 2 AS turnover FROM changes GROUP BY market, k", ("changes",))
define(
    "cfrac",
    f"""SELECT market, k, sum({COMMISSION}) AS cost FROM (SELECT market, k, abs(w_new - w_old) AS price, 1 AS quantity, CASE WHEN w_new > w_old THEN 'BUY' ELSE 'SELL' END AS side
FROM changes WHERE abs(w_new - w_old) >= 1e-10) GROUP BY market, k""",
    ("changes",),
)
define(
    "periods",
    """SELECT r.market, k, signal_d AS d0, coalesce(next_signal_d, CASE WHEN l > exec_d THEN l END) AS d1, next_signal_d IS NULL AS tail FROM rebal r
JOIN (SELECT market, max(d) AS l FROM bars GROUP BY market) z USING (market)""",
    ("rebal", "bars"),
)
define(
    "earned",
    f"""SELECT s.market, s.k, s.d1, any_value(s.tail) AS tail, coalesce(sum(w * coalesce({MOVE}, 0)), 0) AS r FROM periods s LEFT JOIN (SELECT market, k, ticker, 1.0 / held_k AS w FROM picks) h ON h.market = s.market AND h.k = s.k
{JOIN_PX} WHERE s.d1 IS NOT NULL GROUP BY s.market, s.k, s.d1""",
    ("periods", "picks", "calm"),
)
define(
    "mlog",
    """SELECT r.market, r.k, signal_d, exec_d, coalesce(h.held, 0) AS held, coalesce(turnover, 0) AS turnover, coalesce(cost, 0) AS cost, e.r AS period_r FROM rebal r LEFT JOIN turn t ON t.market = r.market AND t.k = r.k
LEFT JOIN cfrac c ON c.market = r.market AND c.k = r.k LEFT JOIN (SELECT market, k, max(held_k) AS held FROM picks GROUP BY ALL) h ON h.market = r.market AND h.k = r.k
LEFT JOIN earned e ON e.market = r.market AND e.k + 1 = r.k""",
    ("rebal", "turn", "cfrac", "picks", "earned"),
)
define(
    "mcurve",
    """SELECT market, d, period_r, 1e7 * product(1 + step) OVER (PARTITION BY market ORDER BY d) AS equity FROM (
SELECT market, exec_d AS d, period_r, (1 + coalesce(period_r, 0)) * (1 - cost) - 1 AS step FROM mlog UNION ALL SELECT market, d1, r, r FROM earned WHERE tail)""",
    ("mlog", "earned"),
)
define("mmoves", "SELECT market, period_r AS r FROM mcurve", ("mcurve",))
define("mbase", period_metrics_sql("mcurve", "mmoves", "market"), ("mcurve", "mmoves"))


def _momentum(spark, sf):
    log, curve = pf.momentum_backtest(_bars(spark, sf), LOOK, SKIP, PCT, MIN_K, MAX_K)
    return log, curve


@query("ag17_period_return", sql("earned", "SELECT market, k, d1, round(r, 8) + 0.0 AS r FROM earned"))
def ag17(spark, sf):
    bars = _bars(spark, sf)
    rebalances, picks = pf.selections(bars, LOOK, SKIP, PCT, MIN_K, MAX_K)
    last = bars.groupBy("market").agg(F.max("d").alias("l"))
    spans = rebalances.join(last, "market").select(
        "market", "k", F.col("signal_d").alias("d0"),
        F.coalesce("next_signal_d", F.when(F.col("l") > F.col("exec_d"), F.col("l"))).alias("d1"),
    ).filter("d1 IS NOT NULL")
    held = picks.select("market", "ticker", "k", (F.lit(1.0) / F.col("held_k")).alias("w")).join(spans, ["market", "k"])
    out = spans.join(rt.period_return(held, bars, ["market", "k"]), ["market", "k"], "left")
    return rounded(out.select("market", "k", "d1", F.coalesce("r", F.lit(0.0)).alias("r")))


@query("ag18_turnover", sql("turn", "SELECT market, k, round(turnover, 8) AS turnover FROM turn"))
def ag18(spark, sf):
    rebalances, picks = pf.selections(_bars(spark, sf), LOOK, SKIP, PCT, MIN_K, MAX_K)
    return rounded(pf.turnover(pf.weight_changes(picks, rebalances)))


@query("ag19_rebalance_cost", sql("cfrac", "SELECT market, k, round(cost, 10) AS cost FROM cfrac"))
def ag19(spark, sf):
    rebalances, picks = pf.selections(_bars(spark, sf), LOOK, SKIP, PCT, MIN_K, MAX_K)
    return rounded(pf.cost_fractions(pf.weight_changes(picks, rebalances)), 10)


@query(
    "pf9_momentum_log",
    sql("mlog", "SELECT market, k, signal_d, exec_d, held, round(turnover, 8) AS turnover, round(cost, 10) AS cost, round(period_r, 8) + 0.0 AS period_r FROM mlog"),
)
def pf9_log(spark, sf):
    return rounded(_momentum(spark, sf)[0], cost=10)


@query("pf9_momentum_curve", sql("mcurve", "SELECT market, d, round(equity, 2) AS equity FROM mcurve"))
def pf9_curve(spark, sf):
    return rounded(_momentum(spark, sf)[1].select("market", "d", "equity"), 2)


@query(
    "ag6_period_metrics",
    sql("mbase mlog", """SELECT m.*, round(t.a, 8) AS avg_monthly_turnover, round(t.s, 8) AS total_turnover, round(t.h, 8) AS avg_holdings, t.lo AS min_holdings, t.hi AS max_holdings
FROM mbase m JOIN (SELECT market, avg(turnover) AS a, sum(turnover) AS s, avg(held) AS h, min(held) AS lo, max(held) AS hi FROM mlog GROUP BY market) t USING (market)"""),
)
def ag6(spark, sf):
    log, curve = _momentum(spark, sf)
    return rounded(pf.momentum_metrics(log, curve), end_value=2)


@query(
    "pf9_strategy_vs_benchmark",
    sql("mbase ew8_metrics", """SELECT market, round(m.cagr - b.cagr, 6) + 0.0 AS diff_cagr, round(m.ann_vol - b.ann_vol, 6) + 0.0 AS diff_ann_vol, round(m.sharpe - b.sharpe, 6) + 0.0 AS diff_sharpe,
round(m.max_dd - b.max_dd, 6) + 0.0 AS diff_max_dd, round(m.calmar - b.calmar, 6) + 0.0 AS diff_calmar, round(m.monthly_hit_rate - b.monthly_hit_rate, 6) + 0.0 AS diff_monthly_hit_rate
FROM mbase m JOIN (SELECT * FROM ew8_metrics WHERE strategy = 'benchmark') b USING (market)"""),
)
def pf9_diff(spark, sf):
    bars = _bars(spark, sf)
    log, curve = pf.momentum_backtest(bars, LOOK, SKIP, PCT, MIN_K, MAX_K)
    monthly = staged(pf.equal_weight_backtest(bars, LOOK, SKIP, 0.1, 3, 20).filter("strategy = 'benchmark'"))
    return rounded(pf.metric_differences(pf.momentum_metrics(log, curve), pf.backtest_metrics(monthly)), 6)


# ---- sizing ----------------------------------------------------------------------------------------

SNAP = """WITH c AS (SELECT c_custkey AS id, 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS ticker, CASE WHEN c_nationkey % 2 = 0 THEN 'NASDAQ' ELSE 'KOSPI' END AS market, c_acctbal AS b FROM customer)
"""


def _snap(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), nation_ticker("c_nationkey").alias("ticker"),
        F.when(F.col("c_nationkey") % 2 == 0, "NASDAQ").otherwise("KOSPI").alias("market"), F.col("c_acctbal").alias("b"),
    )


@query(
    "pf2_risk_sizing",
    SNAP + """, x AS (SELECT id, b / 10000 AS t, id % 17 = 0 AS killed, (id % 9) * 1.0 AS atr, (id % 50) * 1.0 AS close, (id % 7) / 10.0 AS mw, (id % 4) / 20.0 AS pw, id % 3 AS pos, id % 12 AS n,
 CASE market WHEN 'NASDAQ' THEN 0.5 END AS cap FROM c),
y AS (SELECT *, least(t, 0.2) * CASE WHEN close > 0 AND atr / close > 0 THEN least(1, 0.02 / (atr / close)) ELSE 1 END AS w FROM x)
SELECT id, round(CASE WHEN t <= 0 OR killed THEN 0.0 WHEN pos = 0 AND n >= 10 THEN 0.0 ELSE greatest(0, CASE WHEN cap IS NOT NULL THEN least(w, greatest(0, cap - (mw - pw))) ELSE w END) END, 12) AS weight FROM y""",
)
def pf2(spark, sf):
    i = F.col("id")
    weight = pf.risk_sized(
        F.col("b") / 10000, i % 17 == 0, (i % 9) * 1.0, (i % 50) * 1.0, (i % 7) / 10.0, (i % 4) / 20.0, i % 3, i % 12,
        F.when(F.col("market") == "NASDAQ", F.lit(0.5)), max_positions=10,
    )
    return rounded(_snap(spark, sf).select("id", weight.alias("weight")), 12)


@query(
    "pf3_share_deltas",
    SNAP + """, x AS (SELECT id, CAST(floor((id % 10) / 10.0 * 1e6 / (1 + abs(b))) AS BIGINT) - id % 40 AS delta FROM c)
SELECT id, CASE WHEN delta > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(delta) AS quantity FROM x WHERE delta <> 0""",
)
def pf3(spark, sf):
    targets = _snap(spark, sf).select(
        "id", ((F.col("id") % 10) / 10.0).alias("target_weight"), F.lit(1e6).alias("equity_krw"),
        (1 + F.abs("b")).alias("price_krw"), (F.col("id") % 40).alias("position"),
    )
    return pf.share_deltas(targets).select("id", "side", "quantity")


@query(
    "pf4_rebalance_decision",
    SNAP + """, x AS (SELECT id, b / 10 AS price, 20000.0 + id % 1000 AS cash, id % 60 AS shares, (id % 11) / 10.0 AS e, CASE WHEN id % 2 = 0 THEN 60000.0 END AS eq0 FROM c),
y AS (SELECT *, coalesce(eq0, cash + shares * price) AS eq FROM x),
z AS (SELECT *, CASE WHEN price <= 0 THEN shares WHEN floor(e * eq / price) > shares THEN CAST(least(floor(e * eq / price), shares + floor(cash / price)) AS BIGINT) ELSE CAST(floor(e * eq / price) AS BIGINT) END AS tgt FROM y),
w AS (SELECT *, CASE WHEN price <= 0 THEN 'bad price' WHEN abs(tgt - shares) < 1 OR abs(tgt * price / eq - shares * price / eq) < 0.05 THEN 'within band' ELSE 'rebalance' END AS reason FROM z)
SELECT id, tgt AS target_shares, CASE WHEN reason <> 'rebalance' THEN 'HOLD' WHEN tgt > shares THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN reason = 'rebalance' THEN abs(tgt - shares) ELSE 0 END AS qty, reason,
CASE WHEN price > 0 THEN round(shares * price / eq, 8) END AS cur_weight, CASE WHEN price > 0 THEN round(tgt * price / eq, 8) END AS tgt_weight FROM w""",
)
def pf4(spark, sf):
    i = F.col("id")
    accounts = _snap(spark, sf).select(
        "id", (F.col("b") / 10).alias("price"), (F.lit(20000.0) + i % 1000).alias("cash"), (i % 60).alias("shares"),
        ((i % 11) / 10.0).alias("exposure"), F.when(i % 2 == 0, F.lit(60000.0)).alias("equity_krw"),
    )
    out = pf.rebalance_decisions(accounts)
    return rounded(out.select("id", "target_shares", "side", "qty", "reason", "cur_weight", "tgt_weight"))


@query("pf14_canonical_order", sql("bars", "SELECT market, ticker, d, row_number() OVER (ORDER BY d, ticker) - 1 AS bar_index FROM bars"))
def pf14(spark, sf):
    order = ["d", "ticker", "market"]
    bars = in_order(bars_day(spark, sf).select("market", "ticker", "d").withColumn("run", F.lit("all")), ["run"], order)
    return rounded(with_position(bars, ["run"], order, out="bar_index", part=PART).drop("run", PART))


# ---- threshold grid ------------------------------------------------------------------------------------

STRATEGIES = {
    "fused": ["ma_cross", "rsi_reversion", "macd_trend", "bollinger_reversion"],
    "reversion": ["rsi_reversion", "bollinger_reversion"],
    "trend": ["ma_cross", "macd_trend"],
}
THRESHOLDS = (0.1, 0.2, 0.35)
define(
    "strat_scores",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS strategy, market, ticker, ts, coalesce(sum(score * confidence * w) / nullif(sum(confidence * w), 0), 0) AS combined
FROM (SELECT *, CASE source WHEN 'macd_trend' THEN 1.5 WHEN 'bollinger_reversion' THEN 0.5 ELSE 1.0 END AS w FROM isig WHERE source IN ({', '.join(repr(s) for s in sources)})) GROUP BY market, ticker, ts"""
        for name, sources in STRATEGIES.items()
    ),
    ("isig",),
)
RUN = "strategy, threshold"
define(
    "gw",
    f"""SELECT {RUN}, market, ticker, ts, coalesce(last_value(CASE WHEN combined >= threshold THEN combined WHEN combined <= 0 THEN 0.0 END IGNORE NULLS)
 OVER (PARTITION BY {RUN}, market, ticker ORDER BY ts ROWS UNBOUNDED PRECEDING), 0.0) AS weight FROM strat_scores CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.35::DOUBLE]) AS threshold)""",
    ("strat_scores",),
)
define(
    "gr",
    f"""SELECT {RUN}, market, ticker, ts, active, CASE WHEN abs(change) > 1e-12 THEN 1 ELSE 0 END AS traded,
 active * (nopen / open - 1) - CASE WHEN abs(change) > 1e-12 THEN {COMMISSION} ELSE 0 END AS r FROM (SELECT *, abs(change) AS price, 1 AS quantity, CASE WHEN change > 0 THEN 'BUY' ELSE 'SELL' END AS side FROM (
SELECT *, active - coalesce(lag(weight, 2) OVER w, 0.0) AS change FROM (SELECT g.{RUN.replace(', ', ', g.')}, h.market, h.ticker, h.ts, h.open, h.nopen, x.weight, coalesce(lag(x.weight) OVER (PARTITION BY g.strategy, g.threshold, h.market, h.ticker ORDER BY h.ts), 0.0) AS active
 FROM (SELECT *, coalesce(lead(open) OVER (PARTITION BY market, ticker ORDER BY ts), close) AS nopen FROM calmh) h CROSS JOIN (SELECT DISTINCT {RUN} FROM gw) g
 LEFT JOIN gw x ON x.strategy = g.strategy AND x.threshold = g.threshold AND x.market = h.market AND x.ticker = h.ticker AND x.ts = h.ts)
 WINDOW w AS (PARTITION BY {RUN}, market, ticker ORDER BY ts)))""",
    ("gw", "calmh"),
)
define(
    "ge",
    f"""SELECT {RUN}, ts, r, 1e7 * product(1 + r) OVER (PARTITION BY {RUN} ORDER BY ts) AS equity FROM (SELECT {RUN}, ts, sum(r) / (SELECT count(DISTINCT ticker) FROM calmh) AS r FROM gr GROUP BY {RUN}, ts)""",
    ("gr", "calmh"),
)
define(
    "gflags",
    f"""SELECT *, h - coalesce(lag(h) OVER (PARTITION BY {RUN}, market, ticker ORDER BY ts), 0) AS turn, row_number() OVER (PARTITION BY {RUN} ORDER BY ts, ticker, market) - 1 AS bi, count(*) OVER (PARTITION BY {RUN}) AS n
FROM (SELECT {RUN}, market, ticker, ts, CASE WHEN active <> 0 THEN 1 ELSE 0 END AS h FROM gr)""",
    ("gr",),
)
define(
    "gexp",
    f"""SELECT {RUN}, avg(CASE WHEN o > 0 THEN 1.0 ELSE 0.0 END) AS exposure FROM (SELECT {RUN}, sum(turn) OVER (PARTITION BY {RUN} ORDER BY bi) AS o FROM gflags) GROUP BY {RUN}""",
    ("gflags",),
)
define(
    "ghold",
    f"""SELECT {RUN}, count(*) AS holdings, avg(coalesce(nx, n) - bi) AS avg_holding FROM (SELECT *, lead(bi) OVER (PARTITION BY {RUN}, market, ticker ORDER BY bi) AS nx FROM gflags WHERE turn <> 0) WHERE turn = 1 GROUP BY {RUN}""",
    ("gflags",),
)


def _grid(spark, sf, strategies=tuple(STRATEGIES), thresholds=THRESHOLDS):
    hours = staged(bars_hour(spark, sf))
    bars = calm(hours)
    scores = staged(pf.combined_grid_scores(ind.indicator_signals(hours), {n: STRATEGIES[n] for n in strategies}, WEIGHTS))
    weights = staged(pf.grid_weights(scores, thresholds))
    returns = staged(pf.grid_returns(weights, bars, list(strategies), thresholds))
    names = returns.select("ticker").distinct().agg(F.count(F.lit(1)).cast("double")).scalar()
    return returns, staged(pf.grid_equity(returns, names))


@query(
    "pf10_threshold_grid",
    sql("ge gr gexp ghold", f"""SELECT {RUN}, t.trades, round(e.tr, 6) + 0.0 AS total_return, round(e.mdd, 6) + 0.0 AS max_drawdown, round(x.exposure, 8) AS exposure, h.holdings, round(h.avg_holding, 8) AS avg_holding, round(e.fe, 2) AS final_equity
FROM (SELECT {RUN}, sum(traded) AS trades FROM gr GROUP BY {RUN}) t JOIN (SELECT {RUN}, arg_max(equity, ts) / arg_min(equity, ts) - 1 AS tr, arg_max(equity, ts) AS fe, min((equity - pk) / pk) AS mdd
 FROM (SELECT *, max(equity) OVER (PARTITION BY {RUN} ORDER BY ts) AS pk FROM ge) GROUP BY {RUN}) e USING ({RUN}) JOIN gexp x USING ({RUN}) JOIN ghold h USING ({RUN})"""),
)
def pf10(spark, sf):
    returns, equity = _grid(spark, sf)
    return rounded(pf.grid_report(returns, equity), total_return=6, max_drawdown=6, final_equity=2)


@query("ag28_exposure", sql("gexp", f"SELECT {RUN}, round(exposure, 8) AS exposure FROM gexp"))
def ag28(spark, sf):
    returns, _ = _grid(spark, sf)
    flags = ledger.open_flags(returns, ["strategy", "threshold", "market", "ticker"], "ts", "active")
    return rounded(ledger.exposure(flags, ["strategy", "threshold"]))


@query("ag29_holding_periods", sql("ghold", f"SELECT {RUN}, holdings, round(avg_holding, 8) AS avg_holding FROM ghold"))
def ag29(spark, sf):
    returns, _ = _grid(spark, sf)
    flags = ledger.open_flags(returns, ["strategy", "threshold", "market", "ticker"], "ts", "active")
    return rounded(ledger.holding_periods(flags, ["strategy", "threshold"]))


define(
    "mflags",
    """SELECT *, h - coalesce(lag(h) OVER (PARTITION BY market, ticker ORDER BY ts), 0) AS turn, row_number() OVER (PARTITION BY market ORDER BY ts, ticker) - 1 AS bi, count(*) OVER (PARTITION BY market) AS n
FROM (SELECT market, ticker, date_trunc('minute', ts) AS ts, CASE WHEN arg_max(px, row(ts, event_id)) > arg_min(px, row(ts, event_id)) OR max(px) > 50 THEN 1 ELSE 0 END AS h FROM ticks GROUP BY ALL)""",
    ("ticks",),
)


def _minute_flags(spark, sf):
    """Minute bars held after a rise or above a level; the run is the market."""
    bars = bars_hour(spark, sf, "minute")
    weight = F.when((F.col("close") > F.col("open")) | (F.col("high") > 50), 1.0).otherwise(0.0)
    flags = ledger.open_flags(bars.select("market", "ticker", "ts", weight.alias("weight")))
    return in_order(flags, ["market"], ["ts", "ticker"])


@query(
    "ag28_exposure_minutes",
    sql("mflags", """SELECT market, round(avg(CASE WHEN o > 0 THEN 1.0 ELSE 0.0 END), 8) AS exposure
FROM (SELECT market, sum(turn) OVER (PARTITION BY market ORDER BY bi) AS o FROM mflags) GROUP BY market"""),
)
def ag28_minutes(spark, sf):
    return rounded(ledger.exposure(_minute_flags(spark, sf), ["market"], ["ts", "ticker"]))


@query(
    "ag29_holding_minutes",
    sql("mflags", """SELECT market, count(*) AS holdings, round(avg(coalesce(nx, n) - bi), 8) AS avg_holding
FROM (SELECT *, lead(bi) OVER (PARTITION BY market, ticker ORDER BY bi) AS nx FROM mflags WHERE turn <> 0) WHERE turn = 1 GROUP BY market"""),
)
def ag29_minutes(spark, sf):
    return rounded(ledger.holding_periods(_minute_flags(spark, sf), ["market"], ["ts", "ticker"], ["ticker"]))


@query(
    "pf11_sleeves",
    sql("ge", "SELECT ts, round(sum(equity) * 0.5, 2) AS equity FROM ge WHERE strategy IN ('trend', 'reversion') AND threshold = 0.2 GROUP BY ts"),
)
def pf11(spark, sf):
    _, equity = _grid(spark, sf, ("trend", "reversion"), (0.2,))
    curve = lambda name: equity.filter(F.col("strategy") == name)
    return rounded(pf.sleeve_equity({n: curve(n) for n in ("trend", "reversion")}, {"trend": 0.5, "reversion": 0.5}), 2)


def _log_sql(r: str) -> str:
    return f"""SELECT market, power(arg_max(q, d) / arg_min(q, d), 252.0 / count(*)) - 1 AS cagr, min((q - pk) / pk) AS max_drawdown, avg(lr) / stddev_samp(lr) * sqrt(252) AS sharpe, stddev_samp(lr) * sqrt(252) AS vol
FROM (SELECT *, max(q) OVER (PARTITION BY market ORDER BY d) AS pk, ln(q / lag(q) OVER (PARTITION BY market ORDER BY d)) AS lr FROM (SELECT market, d, product(1 + {r}) OVER (PARTITION BY market ORDER BY d) AS q FROM va)) GROUP BY market"""


@query(
    "pf12_vol_target_comparison",
    sql("ewma", f""", va AS (SELECT market, d, r, r * coalesce(lag(scalar_incl) OVER (PARTITION BY market ORDER BY t), 1.0) AS rs FROM ewma),
a AS ({_log_sql('r')}), b AS ({_log_sql('rs')})
SELECT market, round(a.cagr, 6) AS cagr_off, round(a.max_drawdown, 6) AS max_drawdown_off, round(a.sharpe, 6) AS sharpe_off, round(a.vol, 6) AS vol_off, round(a.cagr / abs(a.max_drawdown), 6) AS calmar_off,
round(b.cagr, 6) AS cagr_on, round(b.max_drawdown, 6) AS max_drawdown_on, round(b.sharpe, 6) AS sharpe_on, round(b.vol, 6) AS vol_on, round(b.cagr / abs(b.max_drawdown), 6) AS calmar_on,
round(b.cagr - a.cagr, 6) AS cagr_delta, round(b.max_drawdown - a.max_drawdown, 6) AS max_drawdown_delta, round(b.sharpe - a.sharpe, 6) AS sharpe_delta, round(b.vol - a.vol, 6) AS vol_delta,
round(b.cagr / abs(b.max_drawdown) - a.cagr / abs(a.max_drawdown), 6) AS calmar_delta FROM a JOIN b USING (market)"""),
)
def pf12(spark, sf):
    return rounded(pf.vol_target_comparison(_ew(spark, sf), 0.12), 6)


# ---- funding basket --------------------------------------------------------------------------------------

define("fdaily", "SELECT coin, CAST(make_timestamp(epoch_ms * 1000) AS DATE) AS d, sum(rate) AS rate FROM funding GROUP BY ALL", ("funding",))
define(
    "trail",
    """SELECT coin, d, rate, CASE WHEN count(*) OVER w >= 3 THEN avg(rate) OVER w END AS trail FROM fdaily
WINDOW w AS (PARTITION BY coin ORDER BY d RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""",
    ("fdaily",),
)
define("fperiods", """SELECT 'first' AS period, DATE '2024-01-01' AS s, DATE '2024-01-16' AS e UNION ALL SELECT 'second', DATE '2024-01-17', DATE '2024-12-31' UNION ALL SELECT 'all', DATE '2024-01-01', DATE '2024-12-31'""")
define(
    "fdates",
    """SELECT period, d, row_number() OVER (PARTITION BY period ORDER BY d) - 1 AS i FROM (SELECT DISTINCT d FROM fdaily) JOIN fperiods ON d BETWEEN s AND e""",
    ("fdaily", "fperiods"),
)
define(
    "fheld",
    """SELECT p.period, p.i // 7 AS c, list_sort(list(t.coin) FILTER (WHERE t.coin IS NOT NULL)) AS h FROM fdates p LEFT JOIN trail t ON t.d = p.d AND t.trail > 0 WHERE p.i % 7 = 0 GROUP BY ALL""",
    ("fdates", "trail"),
)
define(
    "fcost",
    """SELECT period, c, 0.002 * (len(list_filter(n, lambda x: NOT list_contains(o, x))) + len(list_filter(o, lambda x: NOT list_contains(n, x)))) / greatest(1, len(list_distinct(list_concat(n, o)))) AS cost
FROM (SELECT period, c, coalesce(h, []) AS n, coalesce(lag(h) OVER (PARTITION BY period ORDER BY c), []) AS o FROM fheld)""",
    ("fheld",),
)
define(
    "fret",
    """SELECT p.period, p.d, coalesce(avg(f.rate), 0) - CASE WHEN any_value(p.i) % 7 = 0 THEN any_value(k.cost) ELSE 0 END AS r FROM fdates p JOIN fheld h ON h.period = p.period AND h.c = p.i // 7
JOIN fcost k ON k.period = p.period AND k.c = p.i // 7 LEFT JOIN fdaily f ON f.d = p.d AND list_contains(coalesce(h.h, []), f.coin) GROUP BY p.period, p.d""",
    ("fdates", "fheld", "fcost", "fdaily"),
)


def _daily_funding(spark, sf):
    return staged(text.daily_funding(funding(spark, sf)))


def _periods(spark):
    return spark.createDataFrame(
        [("first", "2024-01-01", "2024-01-16"), ("second", "2024-01-17", "2024-12-31"), ("all", "2024-01-01", "2024-12-31")],
        "period string, start string, end string",
    ).select("period", F.to_date("start").alias("start"), F.to_date("end").alias("end"))


@query("rn5_trailing_funding", sql("trail", "SELECT coin, d, round(trail, 8) + 0.0 AS trail FROM trail"))
def rn5(spark, sf):
    return rounded(pf.trailing_funding(_daily_funding(spark, sf)).select("coin", "d", "trail"))


@query("pf13_funding_basket", sql("fret", "SELECT period, d, round(r, 8) + 0.0 AS r FROM fret"))
def pf13(spark, sf):
    return rounded(pf.funding_basket(_daily_funding(spark, sf), _periods(spark)))


@query(
    "ag8_funding_metrics",
    sql("fret", """SELECT period, count(*) AS n_days, round(power(arg_max(q, d), 365.0 / count(*)) - 1, 6) AS cagr, round(avg(r) / stddev_pop(r) * sqrt(365), 6) AS sharpe, round(min((q - pk) / pk), 6) AS max_drawdown, round(arg_max(q, d), 6) AS final_equity
FROM (SELECT *, max(q) OVER (PARTITION BY period ORDER BY d) AS pk FROM (SELECT period, d, r, product(1 + r) OVER (PARTITION BY period ORDER BY d) AS q FROM fret)) GROUP BY period"""),
)
def ag8(spark, sf):
    returns = staged(pf.funding_basket(_daily_funding(spark, sf), _periods(spark)))
    return rounded(pf.funding_metrics(returns), 6)


@query(
    "st3_holdings_difference",
    sql("trail", """, h AS (SELECT d, list_sort(list(coin) FILTER (WHERE trail > 0)) AS h FROM trail GROUP BY d),
p AS (SELECT d, coalesce(h, []) AS n, coalesce(lag(h) OVER (ORDER BY d), []) AS o FROM h)
SELECT d, round((len(list_filter(n, lambda x: NOT list_contains(o, x))) + len(list_filter(o, lambda x: NOT list_contains(n, x)))) / greatest(1, len(list_distinct(list_concat(n, o)))), 8) AS changed FROM p"""),
)
def st3(spark, sf):
    from pyspark.sql import Window as W

    trail = pf.trailing_funding(_daily_funding(spark, sf))
    held = trail.groupBy("d").agg(F.array_sort(F.collect_list(F.when(F.col("trail") > 0, F.col("coin")))).alias("now"))
    by_date = W.orderBy("d")  # one row per date
    before = F.coalesce(F.lag("now").over(by_date), F.array().cast("array<string>"))
    return rounded(held.withColumn("was", before).select("d", pf.symmetric_share(F.col("was"), F.col("now")).alias("changed")))
