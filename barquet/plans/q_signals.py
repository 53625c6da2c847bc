"""Signal, indicator, fusion and information-coefficient queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barquet.functions import indicators as ind
from barquet.functions import signals as sg
from barquet.operators import fusion, ic
from barquet.operators.pit import as_of_series
from barquet.operators.returns import calendar
from barquet.plans.registry import query, rounded
from barquet.plans.views import define, with_views as sql
from barquet.session import staged
from barquet.sources.bridge import bars_day, bars_hour, macro_long

BY = "PARTITION BY market, ticker ORDER BY d"


def rows(n: int) -> str:
    return f"({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


define(
    "hist",
    f"""SELECT *, close / lag(close) OVER ({BY}) - 1 AS ret, row_number() OVER ({BY}) AS pos FROM bars""",
    ("bars",),
)


def lagged(n: int) -> str:
    return f"lag(close, {n}) OVER ({BY})" if n else "close"


def ratio(a: int, b: int) -> str:
    return f"{lagged(a)} / {lagged(b)} - 1"


SKEW = f"""(avg(power(ret, 3)) OVER {rows(60)} - 3 * avg(ret) OVER {rows(60)} * avg(power(ret, 2)) OVER {rows(60)}
 + 2 * power(avg(ret) OVER {rows(60)}, 3)) / power(stddev_pop(ret) OVER {rows(60)}, 3)"""
SIGNAL_SQL = {
    "momentum_12_1": (253, ratio(21, 252)),
    "momentum_12_2": (253, ratio(42, 252)),
    "momentum_6_1": (127, ratio(21, 126)),
    "momentum_3_1": (64, ratio(21, 63)),
    "reversal_5": (6, f"-({ratio(0, 5)})"),
    "reversal_21": (22, f"-({ratio(0, 21)})"),
    "long_term_reversal": (757, f"-({ratio(252, 756)})"),
    "low_volatility_60": (61, f"-stddev_samp(ret) OVER {rows(60)}"),
    "max_lottery_21": (22, f"-max(ret) OVER {rows(21)}"),
    "pct_52w_high": (252, f"close / max(high) OVER {rows(252)}"),
    "amihud_21": (22, f"avg(CASE WHEN close * volume > 0 THEN abs(ret) / (close * volume) END) OVER {rows(21)}"),
    "volume_trend": (64, f"avg(volume) OVER {rows(21)} / avg(volume) OVER {rows(63)} - 1"),
    "return_skewness_60": (61, f"-{SKEW}"),
}
DIGITS = {"amihud_21": 10, "return_skewness_60": 5}
define(
    "sig",
    "SELECT market, ticker, d, open, close, pos, "
    + ", ".join(f"CASE WHEN pos >= {n} THEN {e} END AS {name}" for name, (n, e) in SIGNAL_SQL.items())
    + " FROM hist",
    ("hist",),
)
IDS = {
    "momentum_12_1": "sg1_momentum_12_1",
    "momentum_12_2": "sg2_momentum_12_2",
    "momentum_6_1": "sg3_momentum_6_1",
    "momentum_3_1": "sg4_momentum_3_1",
    "reversal_5": "sg5_reversal_5",
    "reversal_21": "sg5_reversal_21",
    "long_term_reversal": "sg6_long_term_reversal",
    "low_volatility_60": "sg7_low_volatility_60",
    "max_lottery_21": "sg8_max_lottery_21",
    "pct_52w_high": "sg9_pct_52w_high",
    "amihud_21": "sg10_amihud_21",
    "volume_trend": "sg11_volume_trend",
    "return_skewness_60": "sg12_return_skewness_60",
}


def _one_signal(name: str):
    def run(spark, sf):
        wide = sg.signals_wide(bars_day(spark, sf), [name])
        return rounded(wide.select("market", "ticker", "d", F.col(name).alias("score")), DIGITS.get(name, 8))

    return run


for _name, _id in IDS.items():
    query(
        _id,
        sql("hist", f"""SELECT market, ticker, d, round(CASE WHEN pos >= {SIGNAL_SQL[_name][0]}
THEN {SIGNAL_SQL[_name][1]} END, {DIGITS.get(_name, 8)}) + 0.0 AS score FROM hist"""),
    )(_one_signal(_name))


@query("sg13_daily_returns", sql("hist", "SELECT market, ticker, d, round(ret, 8) + 0.0 AS ret FROM hist"))
def sg13(spark, sf):
    from barquet.operators.scan import framed

    wide = framed(bars_day(spark, sf), sg.with_return, back=1)
    return rounded(wide.select("market", "ticker", "d", F.col("_r").alias("ret")))


# ---- indicators on hourly bars -------------------------------------------------------------

BYH = "PARTITION BY market, ticker ORDER BY ts"


def hrows(n: int) -> str:
    return f"({BYH} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def clip(x: str, lo: float = -1.0, hi: float = 1.0) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


define(
    "hh",
    f"""SELECT *, close - lag(close) OVER ({BYH}) AS diff, lag(close) OVER ({BYH}) AS pc,
row_number() OVER ({BYH}) AS pos, list(close) OVER {hrows(34)} AS tail34, list(close) OVER {hrows(60)} AS tail60 FROM hours""",
    ("hours",),
)
def ema_sql(values: str, span: int) -> str:
    k = 2.0 / (span + 1)
    return f"list_reduce({values}, lambda a, x: x * {k!r} + a * (1 - {k!r}))"


IND_SQL = {
    "ma_cross": f"""SELECT market, ticker, ts, close, {clip('20 * spread')} AS score,
 {clip('0.1 + 0.8 * (abs(spread) * 20 / (1 + abs(spread) * 20))', 0.1, 0.9)} AS confidence
FROM (SELECT *, (f - s) / s AS spread FROM (SELECT market, ticker, ts, close, pos, avg(close) OVER {hrows(10)} AS f, avg(close) OVER {hrows(30)} AS s FROM hh))
WHERE pos >= 30 AND s <> 0""",
    "rsi_reversion": f"""SELECT market, ticker, ts, close, {clip('(50 - rsi) / 50')} AS score, {clip('0.1 + 0.8 * abs(rsi - 50) / 50', 0.1, 0.9)} AS confidence
FROM (SELECT *, CASE WHEN dn = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END AS rsi FROM (SELECT market, ticker, ts, close, pos,
 sum(greatest(diff, 0)) OVER {hrows(14)} AS up, sum(greatest(-diff, 0)) OVER {hrows(14)} AS dn FROM hh)) WHERE pos >= 15""",
    "macd_trend": f"""SELECT market, ticker, ts, close, {clip('hist / close * 100')} AS score,
 CASE WHEN hist * line > 0 THEN {clip('0.5 + 0.4 * x', 0.1, 0.9)} ELSE {clip('0.1 + 0.3 * x', 0.1, 0.9)} END AS confidence
FROM (SELECT *, abs(hist) / (close * 0.01 + abs(hist)) AS x FROM (SELECT *, lines[9] AS line, lines[9] - {ema_sql('lines', 9)} AS hist FROM (
SELECT market, ticker, ts, close, pos, [{', '.join(f"{ema_sql(f'tail34[1:{26 + i}]', 12)} - {ema_sql(f'tail34[1:{26 + i}]', 26)}" for i in range(9))}] AS lines
FROM hh WHERE pos >= 35)))""",
    "bollinger_reversion": f"""SELECT market, ticker, ts, close, CASE WHEN sd = 0 OR m = 0 THEN 0.0 ELSE {clip('-z')} END AS score,
 CASE WHEN sd = 0 OR m = 0 THEN 0.1 ELSE {clip(f"CASE WHEN abs(z) >= 1 THEN {clip('0.1 + 0.5 * (abs(z) - 1)', 0.1, 0.9)} ELSE {clip('0.1 + 0.3 * abs(z)', 0.1, 0.4)} END * {clip('4 * sd / m / 0.01', 0.2, 1.0)}", 0.1, 0.9)} END AS confidence
FROM (SELECT *, (close - m) / (2 * sd) AS z FROM (SELECT market, ticker, ts, close, pos, avg(close) OVER {hrows(20)} AS m, stddev_pop(close) OVER {hrows(20)} AS sd FROM hh)) WHERE pos >= 20""",
}
for _name, _body in IND_SQL.items():
    define(f"i_{_name}", _body, ("hh",))
define(
    "isig",
    " UNION ALL ".join(f"SELECT '{n}' AS source, * FROM i_{n}" for n in IND_SQL),
    tuple(f"i_{n}" for n in IND_SQL),
)


@query(
    "in1_moving_stats",
    sql("hh", f"""SELECT market, ticker, ts, CASE WHEN pos >= 20 THEN round(avg(close) OVER {hrows(20)}, 6) END AS sma_20,
CASE WHEN pos >= 20 THEN round(stddev_pop(close) OVER {hrows(20)}, 6) END AS sd_20, {clip('close', 10.0, 100.0)} AS clamped FROM hh"""),
)
def in1(spark, sf):
    from barquet.operators.scan import framed

    def build(df, f):
        return df.select(
            "*",
            F.when(f.full(20), ind.sma(f, 20)).alias("sma_20"),
            F.when(f.full(20), ind.sd_pop(f, 20)).alias("sd_20"),
            ind.clamp(F.col("close"), 10.0, 100.0).alias("clamped"),
        )

    out = framed(bars_hour(spark, sf), build, order=("ts",), back=20)
    return rounded(out.select("market", "ticker", "ts", "sma_20", "sd_20", "clamped"), 6)


def _indicator(name: str):
    def run(spark, sf):
        out = ind.indicator_signals(bars_hour(spark, sf), [name])
        return rounded(out.select("market", "ticker", "ts", "score", "confidence"), 6)

    return run


for _id, _name in (
    ("in2_moving_average_cross", "ma_cross"),
    ("in3_rsi_reversion", "rsi_reversion"),
    ("in4_macd_trend", "macd_trend"),
    ("in5_bollinger_reversion", "bollinger_reversion"),
):
    query(
        _id,
        sql(f"i_{_name}", f"SELECT market, ticker, ts, round(score, 6) + 0.0 AS score, round(confidence, 6) AS confidence FROM i_{_name}"),
    )(_indicator(_name))


@query(
    "in6_combined_technical",
    sql("hh", f""", p AS (SELECT market, ticker, ts, close, pos, avg(close) OVER {hrows(20)} AS mf, avg(close) OVER {hrows(50)} AS ms,
 sum(greatest(diff, 0)) OVER {hrows(14)} AS up, sum(greatest(-diff, 0)) OVER {hrows(14)} AS dn, stddev_pop(close) OVER {hrows(20)} AS sd,
 {ema_sql('tail60', 12)} - {ema_sql('tail60', 26)} AS macd FROM hh),
q AS (SELECT *, CASE WHEN dn = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END AS rsi, CASE WHEN sd = 0 THEN 0.0 ELSE (close - mf) / (2 * sd) END AS bb FROM p WHERE pos >= 50)
SELECT market, ticker, ts, round({clip(f"({clip('(mf - ms) / ms * 10')} + {clip('(rsi - 50) / 50')} + {clip('macd / ms * 10')} + {clip('bb')}) / 4")}, 6) + 0.0 AS score,
 0.6 AS confidence, '1d' AS horizon, round(mf, 6) AS ma_fast, round(ms, 6) AS ma_slow, round(rsi, 6) AS rsi, round(macd, 6) + 0.0 AS macd_hist, round(bb, 6) + 0.0 AS bb_pos FROM q"""),
)
def in6(spark, sf):
    out = ind.combined_technical(bars_hour(spark, sf))
    features = ["ma_fast", "ma_slow", "rsi", "macd_hist", "bb_pos"]
    return rounded(
        out.select("market", "ticker", "ts", "score", "confidence", "horizon", *[F.col("features")[n].alias(n) for n in features]), 6
    )


@query(
    "in7_indicator_signals",
    sql("isig", "SELECT source, market, ticker, ts, round(score, 6) + 0.0 AS score, round(confidence, 6) AS confidence, '5d' AS horizon FROM isig"),
)
def in7(spark, sf):
    return rounded(ind.indicator_signals(bars_hour(spark, sf)).drop("close"), 6)


@query(
    "in8_average_true_range",
    sql("hh", """, tr AS (SELECT market, ticker, ts, pos, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM hh),
w AS (SELECT *, avg(tr) OVER (PARTITION BY market, ticker ORDER BY pos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS a FROM tr)
SELECT tr.market, tr.ticker, tr.ts, round(tr.tr, 6) AS tr, round(v.atr, 6) AS atr FROM tr LEFT JOIN (
  WITH RECURSIVE g AS (SELECT market, ticker, pos, a AS atr FROM w WHERE pos = 14
  UNION ALL SELECT w.market, w.ticker, w.pos, (g.atr * 13 + w.tr) / 14 FROM g JOIN w ON w.market = g.market AND w.ticker = g.ticker AND w.pos = g.pos + 1)
  SELECT * FROM g) v ON v.market = tr.market AND v.ticker = tr.ticker AND v.pos = tr.pos"""),
)
def in8(spark, sf):
    out = ind.average_true_range(bars_hour(spark, sf))
    return rounded(out.select("market", "ticker", "ts", "tr", "atr"), 6)


@query(
    "in9_daily_loss_limit",
    sql("hours", """, e AS (SELECT market, ticker, ts, close AS equity, CAST(ts AS DATE) AS day,
first_value(close) OVER (PARTITION BY market, ticker, CAST(ts AS DATE) ORDER BY ts) AS day_start FROM hours)
SELECT market, ticker, ts, day, round(day_start, 6) AS day_start,
bool_or(1 - equity / day_start > 0.03) OVER (PARTITION BY market, ticker, day ORDER BY ts) AS breached FROM e"""),
)
def in9(spark, sf):
    equity = bars_hour(spark, sf).select("market", "ticker", "ts", F.col("close").alias("equity"))
    out = ind.daily_loss(equity, ["market", "ticker"])
    return rounded(out.select("market", "ticker", "ts", "day", "day_start", "breached"), 6)


# ---- fusion ----------------------------------------------------------------------------------

WEIGHTS = {"macd_trend": 1.5, "bollinger_reversion": 0.5}
define(
    "fused",
    """SELECT market, ticker, ts, any_value(close) AS close,
coalesce(sum(score * confidence * w) / nullif(sum(confidence * w), 0), 0) AS combined, count(*) AS n_sources
FROM (SELECT *, CASE source WHEN 'macd_trend' THEN 1.5 WHEN 'bollinger_reversion' THEN 0.5 ELSE 1.0 END AS w FROM isig)
GROUP BY market, ticker, ts""",
    ("isig",),
)


@query("pf1_fused_score", sql("fused", "SELECT market, ticker, ts, round(combined, 6) + 0.0 AS combined, n_sources FROM fused"))
def pf1(spark, sf):
    signals = ind.indicator_signals(bars_hour(spark, sf))
    return rounded(fusion.combined(signals, WEIGHTS).select("market", "ticker", "ts", "combined", "n_sources"), 6)


@query(
    "rn7_hysteresis",
    sql("fused", """SELECT market, ticker, ts, round(coalesce(last_value(CASE WHEN combined >= 0.2 THEN combined WHEN combined <= 0.0 THEN 0.0 END IGNORE NULLS)
OVER (PARTITION BY market, ticker ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), 6) AS weight FROM fused"""),
)
def rn7(spark, sf):
    fused = staged(fusion.combined(ind.indicator_signals(bars_hour(spark, sf)), WEIGHTS))
    out = fusion.hysteresis(fused, 0.2, 0.0)
    return rounded(out.select("market", "ticker", "ts", "weight"), 6)


# ---- information coefficient -------------------------------------------------------------------

H, XS = 21, 3
SCAN = list(SIGNAL_SQL)
LEAST = {"NASDAQ": 4, "KOSPI": 3}

define(
    "fwd",
    f"""SELECT c.market, e.ticker, c.i, c.d, x.close / e.open - 1 AS fwd FROM cal c
JOIN cal c1 ON c1.market = c.market AND c1.i = c.i + 1 JOIN cal c2 ON c2.market = c.market AND c2.i = c.i + {H}
JOIN bars e ON e.market = c.market AND e.d = c1.d JOIN bars x ON x.market = c.market AND x.d = c2.d AND x.ticker = e.ticker
WHERE e.open > 0""",
    ("bars", "cal"),
)
define(
    "splits",
    """SELECT market, unnest([{'split': 'train', 's': f, 'e': t1}, {'split': 'validation', 's': t1, 'e': t2}, {'split': 'holdout', 's': t2, 'e': l}], recursive := true)
FROM (SELECT *, f + a AS t1, f + a + b AS t2 FROM (SELECT market, f, l,
greatest(1, CAST(round_even((l - f) * 0.5, 0) AS INTEGER)) AS a, greatest(1, CAST(round_even((l - f) * 0.25, 0) AS INTEGER)) AS b
FROM (SELECT market, min(d) AS f, max(d) AS l FROM bars GROUP BY market)))""",
    ("bars",),
)
define("spans", "SELECT market, 'all' AS split, min(d) AS s, max(d) + 1 AS e FROM bars GROUP BY market", ("bars",))


def decisions_sql(windows: str, where: str = "true") -> str:
    return f"""SELECT c.market, w.split, c.d, c.i FROM cal c
JOIN (SELECT market, split, s, e, (SELECT min(i) FROM cal x WHERE x.market = {windows}.market AND x.d >= s) AS i0 FROM {windows}) w ON w.market = c.market
JOIN (SELECT market, count(*) AS n FROM cal GROUP BY market) z ON z.market = c.market
JOIN cal x ON x.market = c.market AND x.i = c.i + {H}
WHERE c.i >= i0 AND (c.i - i0) % {H} = 0 AND c.d < e AND c.i <= n - {H} - 1 AND x.d < e AND {where}"""


def icrows_sql(decisions: str, names) -> str:
    scores = " UNION ALL ".join(
        f"SELECT '{n}' AS signal, k.market, k.split, k.d, f.ticker, s.{n} AS score, f.fwd FROM {decisions} k "
        f"JOIN fwd f ON f.market = k.market AND f.i = k.i "
        f"ASOF JOIN sig s ON s.market = f.market AND s.ticker = f.ticker AND k.d >= s.d"
        for n in names
    )
    return f"SELECT * FROM ({scores}) WHERE score IS NOT NULL"


def ics_sql(rows_: str, p: float = 0.01, least: str = str(XS)) -> str:
    return f"""SELECT signal, market, split, d, count(*) AS n,
CASE WHEN stddev_pop(score) > 0 AND stddev_pop(fw) > 0 THEN corr(score, fw) END AS ic,
CASE WHEN stddev_pop(score) > 0 AND stddev_pop(fw) > 0 THEN corr(rs, rf) END AS rank_ic FROM (
SELECT *, rank() OVER (g ORDER BY score) + (count(*) OVER (PARTITION BY signal, market, split, d, score) - 1) / 2.0 AS rs,
 rank() OVER (g ORDER BY fw) + (count(*) OVER (PARTITION BY signal, market, split, d, fw) - 1) / 2.0 AS rf
FROM (SELECT r.*, greatest(lo, least(hi, fwd)) AS fw FROM {rows_} r JOIN (SELECT signal, market, split, d, quantile_cont(fwd, {p}) AS lo,
 quantile_cont(fwd, {1 - p}) AS hi FROM {rows_} GROUP BY ALL) q USING (signal, market, split, d))
WINDOW g AS (PARTITION BY signal, market, split, d)) GROUP BY signal, market, split, d HAVING count(*) >= {least}"""


def summary_sql(ics: str, decisions: str, names) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"""SELECT p.signal, p.market, p.split, count(ic) AS n_periods, any_value(planned) - count(i.n) AS n_skipped_small_xs,
count(i.n) - count(ic) AS n_skipped_degenerate, round(avg(ic), 8) AS mean_ic, round(stddev_samp(ic), 8) AS std_ic,
round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 8) AS ic_t_stat, round(avg(ic) / stddev_samp(ic), 8) AS ic_ir, round(avg(rank_ic), 8) AS mean_rank_ic
FROM (SELECT market, split, unnest([{listed}]) AS signal, planned FROM (SELECT market, split, count(*) AS planned FROM {decisions} GROUP BY ALL)) p
LEFT JOIN {ics} i ON i.signal = p.signal AND i.market = p.market AND i.split = p.split GROUP BY p.signal, p.market, p.split"""


define("dec_all", decisions_sql("spans"), ("cal", "spans"))
define("dec_split", f"SELECT * FROM ({decisions_sql('splits')}) WHERE split <> 'holdout'", ("cal", "splits"))
define("rows_all", icrows_sql("dec_all", ["momentum_3_1"]), ("dec_all", "fwd", "sig"))
define("ics_all", ics_sql("rows_all"), ("rows_all",))
define("rows_split", icrows_sql("dec_split", SCAN), ("dec_split", "fwd", "sig"))
define(
    "ics_split",
    ics_sql("rows_split", least=f"CASE market WHEN 'NASDAQ' THEN {LEAST['NASDAQ']} ELSE {LEAST['KOSPI']} END"),
    ("rows_split",),
)


@query(
    "flt3_chronological_split",
    sql("splits", 'SELECT market, split, s AS start, e AS "end" FROM splits'),
)
def flt3(spark, sf):
    return ic.chronological_split(bars_day(spark, sf))


@query("jn1_forward_return", sql("fwd", "SELECT market, ticker, d, round(fwd, 8) + 0.0 AS fwd FROM fwd"))
def jn1(spark, sf):
    bars = staged(bars_day(spark, sf))
    cal = calendar(bars)
    out = ic.forward_returns(bars, cal, H).join(cal, ["market", "i"])
    return rounded(out.select("market", "ticker", "d", "fwd"))


def _rows(spark, sf, names=("momentum_3_1",), windows=None, allowed=None):
    return ic.cross_sections(staged(bars_day(spark, sf)), list(names), windows, H, allowed=allowed)


@query("ag9_pearson_ic", sql("ics_all", "SELECT market, d, n, round(ic, 8) + 0.0 AS ic FROM ics_all"))
def ag9(spark, sf):
    ics = ic.information_coefficients(_rows(spark, sf)[0], min_cross_section=XS)
    return rounded(ics.select("market", "d", "n", "ic"))


@query("ag10_rank_ic", sql("ics_all", "SELECT market, d, n, round(rank_ic, 8) + 0.0 AS rank_ic FROM ics_all"))
def ag10(spark, sf):
    ics = ic.information_coefficients(_rows(spark, sf)[0], min_cross_section=XS)
    return rounded(ics.select("market", "d", "n", "rank_ic"))


@query(
    "ag11_winsorised_returns",
    sql("fwd", """, q AS (SELECT market, d, quantile_cont(fwd, 0.1) AS lo, quantile_cont(fwd, 0.9) AS hi FROM fwd GROUP BY ALL)
SELECT market, d, ticker, round(fwd, 8) + 0.0 AS fwd, round(greatest(lo, least(hi, fwd)), 8) + 0.0 AS fwd_w,
rank() OVER (PARTITION BY market, d ORDER BY greatest(lo, least(hi, fwd))) + (count(*) OVER (PARTITION BY market, d, greatest(lo, least(hi, fwd))) - 1) / 2.0 AS fwd_rank
FROM fwd JOIN q USING (market, d)"""),
)
def ag11(spark, sf):
    bars = staged(bars_day(spark, sf))
    cal = calendar(bars)
    rows_ = staged(ic.forward_returns(bars, cal, H).join(cal, ["market", "i"]).select("market", "d", "ticker", "fwd"))
    return rounded(ic.winsorised(rows_, ["market", "d"], "fwd", 0.1))


@query("ag12_ic_summary", sql("ics_all", summary_sql("ics_all", "dec_all", ["momentum_3_1"])))
def ag12(spark, sf):
    rows_, decisions = _rows(spark, sf)
    ics = ic.information_coefficients(rows_, min_cross_section=XS)
    return rounded(ic.ic_summary(ics, decisions, ["momentum_3_1"]))


@query("ag13_signal_scan", sql("ics_split", summary_sql("ics_split", "dec_split", SCAN)))
def ag13(spark, sf):
    bars = staged(bars_day(spark, sf))
    return rounded(ic.signal_scan(bars, SCAN, ic.chronological_split(bars), H, min_cross_section=LEAST))


define("rows_reg", icrows_sql("dec_reg", ["reversal_5"]), ("dec_reg", "fwd", "sig"))
define(
    "regime",
    """SELECT c.market, c.d FROM cal c ASOF JOIN macro_long m ON c.d >= m.d
WHERE m.val > (SELECT avg(val) FROM macro_long)""",
    ("cal", "macro_long"),
)
define("dec_reg", decisions_sql("spans", "EXISTS (SELECT 1 FROM regime g WHERE g.market = c.market AND g.d = c.d)"), ("cal", "spans", "regime"))
define("ics_reg", ics_sql("rows_reg"), ("rows_reg",))


@query("flt7_regime_filter", sql("ics_reg", summary_sql("ics_reg", "dec_reg", ["reversal_5"])))
def flt7(spark, sf):
    bars = staged(bars_day(spark, sf))
    series = macro_long(spark, sf)
    mean = series.agg(F.avg("val")).scalar()
    known = series.withColumn("m", mean).select("d", F.struct("val", "m").alias("v"))
    state = as_of_series(calendar(bars), known)
    allowed = state.filter("v.val > v.m").select("market", "d")
    return rounded(ic.signal_scan(bars, ["reversal_5"], ic.whole_span(bars), H, min_cross_section=XS, allowed=allowed))
