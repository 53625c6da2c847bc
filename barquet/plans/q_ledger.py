"""Filter, cost, ledger, reconciliation and journal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barquet.functions import columns as fn
from barquet.functions import indicators as ind
from barquet.operators import filters as fl
from barquet.operators import fusion, ledger, recon
from barquet.plans.q_signals import WEIGHTS
from barquet.plans.registry import query, rounded
from barquet.plans.views import define, with_views as sql
from barquet.session import staged
from barquet.sources import text
from barquet.sources.bridge import bars_day, bars_hour, lines, market_currency, nation_ticker, table

OHLC = "round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close"


# ---- filters ----------------------------------------------------------------------------------


@query("flt1_tradable", sql("bars", f"SELECT market, ticker, d, {OHLC}, volume FROM bars WHERE close >= 1500 AND volume >= 20"))
def flt1(spark, sf):
    return rounded(fl.tradable(bars_day(spark, sf), 1500.0, 20).drop("currency"))


@query("flt2_date_window", sql("bars", f"SELECT market, ticker, d, {OHLC}, volume FROM bars WHERE d >= DATE '1996-02-01' AND d < DATE '1997-03-15'"))
def flt2(spark, sf):
    return rounded(fl.in_window(bars_day(spark, sf), "1996-02-01", "1997-03-15").drop("currency"))


@query("flt4_market_filter", sql("bars", """SELECT 'KOSPI' AS asked, count(*) AS n, round(sum(close), 4) AS total FROM bars WHERE market = 'KOSPI'
UNION ALL SELECT 'ALL', count(*), round(sum(close), 4) FROM bars"""))
def flt4(spark, sf):
    bars = bars_day(spark, sf)

    def stats(name):
        picked = fl.of_market(bars, name)
        return picked.agg(F.lit(name).alias("asked"), F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("total"))

    return stats("KOSPI").unionByName(stats("ALL"))


@query(
    "flt5_weekday_calendar",
    sql("bars", """SELECT market, ticker, d FROM (SELECT market, ticker, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT market, ticker, min(d) AS a, max(d) AS b FROM bars GROUP BY market, ticker))
WHERE isodow(d) < 6"""),
)
def flt5(spark, sf):
    spans = bars_day(spark, sf).groupBy("market", "ticker").agg(F.min("d").alias("start"), F.max("d").alias("end"))
    return fl.weekdays(spans).select("market", "ticker", "d")


@query(
    "flt8_stale_guard",
    sql("bars", """SELECT market, ticker, last_date, (SELECT max(d) FROM bars) - last_date > 1 AS stale FROM (SELECT market, ticker, max(d) AS last_date FROM bars GROUP BY ALL)"""),
)
def flt8(spark, sf):
    return fl.stale_symbols(bars_day(spark, sf), 1)


@query(
    "flt9_record_validity",
    sql("", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT (l_discount * 30 - 1 BETWEEN -1 AND 1) THEN 'score'
WHEN NOT (l_tax * 15 BETWEEN 0 AND 1) THEN 'confidence' WHEN NOT (l_quantity - 3 > 0) THEN 'quantity' END AS rejected FROM lineitem"""),
)
def flt9(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_discount") * 30 - 1).alias("score"), (F.col("l_tax") * 15).alias("confidence"), (F.col("l_quantity") - 3).alias("quantity"),
    )
    return rounded(fl.checked(rows).drop("score", "confidence", "quantity"))


def _track(spark, sf):
    """Orders as a performance track of their customer's nation."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        nation_ticker("c_nationkey").alias("sleeve"),
        F.struct(F.to_date("o_orderdate").alias("d"), "o_orderkey").alias("as_of"),
        F.when(F.col("o_orderkey") % 2 == 0, "US").otherwise("KR").alias("market"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0).alias("equity"),
        F.when(F.col("o_orderkey") % 3 == 0, 1300.0 + F.col("o_orderkey") % 100).otherwise(1.0).alias("fx"),
    )


define(
    "track",
    """SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS sleeve, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k,
CASE WHEN o_orderkey % 2 = 0 THEN 'US' ELSE 'KR' END AS market, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0.0 END AS equity,
CASE WHEN o_orderkey % 3 = 0 THEN 1300.0 + o_orderkey % 100 ELSE 1.0 END AS fx FROM orders JOIN customer ON o_custkey = c_custkey""",
)


@query(
    "flt10_inception",
    sql("track", """, a AS (SELECT sleeve, d, equity FROM (SELECT *, row_number() OVER (PARTITION BY sleeve ORDER BY d, k) AS rn FROM track WHERE equity <> 0) WHERE rn = 1),
b AS (SELECT sleeve, fx FROM (SELECT *, row_number() OVER (PARTITION BY sleeve ORDER BY d, k) AS rn FROM track WHERE equity <> 0 AND market = 'US' AND fx > 1) WHERE rn = 1)
SELECT sleeve, d AS inception, round(equity, 4) AS equity, fx FROM a LEFT JOIN b USING (sleeve)"""),
)
def flt10(spark, sf):
    out = fl.inception(_track(spark, sf), ["sleeve"])
    return rounded(out.select("sleeve", F.col("inception.d").alias("inception"), "equity", "fx"), 4)


# ---- fills and costs ----------------------------------------------------------------------------

ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
IDS = ", ".join(ID)


def fills(spark, sf):
    """Each line item as a fill with whole-number prices, so that sums are exact in any order."""
    price = F.round("px", 0)
    return lines(spark, sf).select(
        F.lit("MAIN").alias("account"), "market", "ticker", market_currency().alias("currency"), "d", "k",
        F.when(F.col("l_returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
        F.col("qty").cast("long").alias("quantity"), price.alias("price"),
        F.round(price * F.col("qty") * 0.0025, 0).alias("commission"), *ID,
    )


define(
    "fills",
    f"""SELECT 'MAIN' AS account, market, ticker, CASE WHEN market = 'NASDAQ' THEN 'USD' ELSE 'KRW' END AS currency, d, k,
CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, CAST(qty AS BIGINT) AS quantity, round(px, 0) AS price, round(round(px, 0) * qty * 0.0025, 0) AS commission,
CASE WHEN market = 'NASDAQ' THEN 1300.0 ELSE 1.0 END AS fx, {IDS} FROM lines""",
    ("lines",),
)
COMMISSION = """CASE WHEN market = 'KOSPI' THEN price * quantity * (1.40527 + CASE WHEN side = 'SELL' THEN 20.0 ELSE 0 END) / 10000
ELSE price * quantity * (25.0 + CASE WHEN side = 'SELL' THEN 0.206 ELSE 0 END) / 10000 + price * quantity * 10.0 / 10000
 + CASE WHEN side = 'SELL' THEN least(0.000195 * quantity, 9.79) ELSE 0 END END"""
SLIP = "price * quantity * (CASE WHEN market = 'KOSPI' THEN 8.0 ELSE 3.0 END + 5.0) / 10000"


@query("sc1_market_commission", sql("fills", f"SELECT {IDS}, side, round({COMMISSION}, 10) AS cost FROM fills"))
def sc1(spark, sf):
    priced = fn.with_costs(fills(spark, sf))
    cost = fn.market_commission(F.col("price"), F.col("quantity"), F.col("side"))
    return rounded(priced.select(*ID, "side", cost.alias("cost")), 10)


@query("jn8_cost_config", sql("fills", """SELECT market, count(*) AS fills, CAST(CASE WHEN market = 'KOSPI' THEN 1.40527 ELSE 25.0 END AS DOUBLE) AS commission_bps,
CAST(CASE WHEN market = 'KOSPI' THEN 20.0 ELSE 0.0 END AS DOUBLE) AS sell_tax_bps FROM fills GROUP BY market"""))
def jn8(spark, sf):
    return fn.with_costs(fills(spark, sf)).groupBy("market").agg(
        F.count(F.lit(1)).alias("fills"), F.max("commission_bps").alias("commission_bps"), F.max("sell_tax_bps").alias("sell_tax_bps")
    )


@query("sc2_flat_commission", sql("fills", f"SELECT {IDS}, round(price * quantity * 0.0007, 6) AS cost FROM fills"))
def sc2(spark, sf):
    return rounded(fills(spark, sf).select(*ID, fn.flat_commission(F.col("price"), F.col("quantity"), 7.0).alias("cost")), 6)


@query("sc3_slippage", sql("fills", f"SELECT {IDS}, round({SLIP}, 6) AS slippage, 0.0 AS disabled FROM fills"))
def sc3(spark, sf):
    args = (F.col("price"), F.col("quantity"), F.col("market"))
    return rounded(
        fills(spark, sf).select(*ID, fn.Slippage(True).cost(*args).alias("slippage"), fn.Slippage().cost(*args).alias("disabled")), 6
    )


@query("sc4_clamp", sql("lines", f"SELECT {IDS}, round(greatest(900.0, least(1100.0, px)), 8) AS clamped FROM lines"))
def sc4(spark, sf):
    return rounded(lines(spark, sf).select(*ID, fn.clamp(F.col("px"), 900.0, 1100.0).alias("clamped")))


@query("sc5_protective_limit", sql("fills", f"SELECT {IDS}, side, round(CASE WHEN side = 'BUY' THEN price * 1.01 ELSE price * 0.99 END, 2) AS limit_price FROM fills"))
def sc5(spark, sf):
    return fills(spark, sf).select(*ID, "side", fn.protective_limit(F.col("side"), F.col("price")).alias("limit_price"))


@query("jn7_to_krw", sql("fills", f"SELECT {IDS}, price * quantity * fx AS amount_krw FROM fills"))
def jn7(spark, sf):
    amounts = fills(spark, sf).withColumn("amount", F.col("price") * F.col("quantity"))
    return fn.to_krw(amounts, ["amount"], ledger.FX).select(*ID, "amount_krw")


@query("ag30_slippage_comparison", sql("fills", f"""SELECT market, round(sum({COMMISSION}), 3) AS baseline_cost, round(sum({COMMISSION} + {SLIP}), 3) AS pessimistic_cost,
round(sum({SLIP}), 3) AS delta_cost FROM fills GROUP BY market"""))
def ag30(spark, sf):
    return rounded(ledger.cost_comparison(fills(spark, sf)), 3)


define(
    "flows",
    """SELECT *, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS dq,
(CASE WHEN side = 'BUY' THEN -price * quantity ELSE price * quantity END - commission) * fx AS flow FROM fills""",
    ("fills",),
)


@query(
    "ag20_portfolio_ledger",
    sql("flows", f"""SELECT {IDS}, 1e9 + sum(flow) OVER (PARTITION BY account ORDER BY d, k ROWS UNBOUNDED PRECEDING) AS cash_krw,
CAST(sum(dq) OVER (PARTITION BY account, market, ticker ORDER BY d, k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS position FROM flows"""),
)
def ag20(spark, sf):
    # the order's key holds the id
    done = ledger.apply_fills(fills(spark, sf), initial_cash=1e9, keep=())
    return done.select(*[F.col(f"k.{c}") for c in ID], "cash_krw", "position")


def _values(spark, sf):
    bars = bars_day(spark, sf).withColumn("close", F.round("close", 0))
    return staged(ledger.symbol_values(staged(fills(spark, sf)), staged(bars)))


define(
    "days",
    "SELECT DISTINCT d FROM bars",
    ("bars",),
)
define(
    "symdays",
    "SELECT days.d, s.market, s.ticker, s.fx FROM days CROSS JOIN (SELECT DISTINCT market, ticker, fx FROM fills) s",
    ("days", "fills"),
)
define(
    "posval",
    """SELECT s.d, s.market, s.ticker, p.position, round(b.close, 0) * p.position * s.fx AS value_krw FROM symdays s
ASOF JOIN (SELECT market, ticker, d, CAST(sum(sum(dq)) OVER (PARTITION BY market, ticker ORDER BY d) AS BIGINT) AS position FROM flows GROUP BY market, ticker, d) p
 ON p.market = s.market AND p.ticker = s.ticker AND s.d >= p.d
ASOF JOIN bars b ON b.market = s.market AND b.ticker = s.ticker AND s.d >= b.d""",
    ("symdays", "flows", "bars"),
)
define(
    "equity_days",
    """SELECT v.d, 1e9 + c.cash AS cash_krw, v.mv AS market_value_krw, 1e9 + c.cash + v.mv AS equity_krw FROM (SELECT d, sum(value_krw) AS mv FROM posval GROUP BY d) v
JOIN (SELECT d, sum(sum(flow)) OVER (ORDER BY d) AS cash FROM flows GROUP BY d) c USING (d)""",
    ("posval", "flows"),
)


@query("ag21_marked_equity", sql("equity_days", "SELECT d, cash_krw, market_value_krw, equity_krw FROM equity_days"))
def ag21(spark, sf):
    return ledger.equity_curve(_values(spark, sf), 1e9).drop("account")


@query(
    "ag22_position_weights",
    sql("equity_days", """, l AS (SELECT market, ticker, position, value_krw FROM posval WHERE d = (SELECT max(d) FROM posval)),
e AS (SELECT 5e11 + sum(value_krw) AS eq FROM l)
SELECT market, ticker, position, value_krw, round(value_krw / eq, 8) AS position_weight, round(sum(value_krw) OVER (PARTITION BY market) / eq, 8) AS market_weight,
count(*) FILTER (WHERE position <> 0) OVER () AS open_positions FROM l, e"""),
)
def ag22(spark, sf):
    positions = ledger.latest_positions(_values(spark, sf))
    equity = positions.groupBy("account").agg((F.lit(5e11) + F.sum("value_krw")).alias("equity_krw"))
    return rounded(ledger.weights(positions, equity).drop("account"))


def _accounts(spark, sf):
    """One account per customer with a domestic and an overseas balance body; its orders are the positions."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    s = F.col("o_orderkey").cast("string")
    qty = F.col("o_orderkey") % 7
    price = F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string")
    dom = F.struct(s.alias("pdno"), F.when(qty == 0, "-").otherwise(qty.cast("string")).alias("hldg_qty"), price.alias("prpr"))
    ovr = F.struct(F.concat(F.lit(" U"), s, F.lit(" ")).alias("ovrs_pdno"), (qty + 0.5).cast("string").alias("ovrs_cblc_qty"), price.alias("now_pric2"))
    held = orders.groupBy(F.col("o_custkey").alias("n")).agg(
        F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, dom)).alias("dom"), F.collect_list(F.when(F.col("o_orderkey") % 2 == 1, ovr)).alias("ovr")
    )
    cash = customers.select(F.col("c_custkey").alias("n"), F.round(F.abs("c_acctbal"), 2).alias("bal"))
    amount = F.col("bal").cast("decimal(20,2)").cast("string")
    summary = F.struct(
        F.when(F.col("n") % 3 == 0, amount).otherwise("").alias("prvs_rcdl_excc_amt"),
        F.when(F.col("n") % 3 == 1, amount).alias("nxdy_excc_amt"),
        F.concat(F.lit("1"), amount).alias("dnca_tot_amt"),
        amount.alias("nass_amt"),
    )
    bought = F.struct((F.col("n") % 25 * 100).cast("string").alias("frcr_pchs_amt1"))
    return cash.join(held, "n", "left").select(
        F.col("n").alias("account"),
        F.to_json(F.struct(F.coalesce("dom", F.array()).alias("output1"), F.array(summary).alias("output2"))).alias("domestic"),
        F.to_json(F.struct(F.coalesce("ovr", F.array()).alias("output1"), bought.alias("output2"))).alias("overseas"),
    )


define(
    "acash",
    """SELECT c_custkey AS account, greatest(0, CASE WHEN c_custkey % 3 = 2 THEN CAST('1' || CAST(CAST(bal AS DECIMAL(20,2)) AS VARCHAR) AS DOUBLE) ELSE bal END - c_custkey % 25 * 100) AS cash_krw,
bal AS nass_krw, c_custkey % 25 * 100.0 AS ovr_purchase_krw FROM (SELECT c_custkey, round(abs(c_acctbal), 2) AS bal FROM customer)""",
)
define(
    "apos",
    """SELECT o_custkey AS account, CASE WHEN o_orderkey % 2 = 0 THEN 'KOSPI' ELSE 'NASDAQ' END AS market,
CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'U' END || CAST(o_orderkey AS VARCHAR) AS ticker, o_orderkey % 7 AS qty, round(o_totalprice, 2) AS mark FROM orders WHERE o_orderkey % 7 <> 0""",
)


@query("ag24_account_snapshot", sql("acash apos", """SELECT a.account, round(cash_krw, 2) AS cash_krw, nass_krw, ovr_purchase_krw, market, ticker, qty, mark
FROM acash a LEFT JOIN apos p ON p.account = a.account"""))
def ag24(spark, sf):
    cash, positions = text.account_snapshots(_accounts(spark, sf))
    return rounded(cash.join(positions, "account", "left"), 2)


@query("ag23_account_equity", sql("acash apos", """SELECT a.account, round(nass_krw - ovr_purchase_krw + coalesce((SELECT sum(qty * mark * 1300) FROM apos p WHERE p.account = a.account AND market = 'NASDAQ'), 0), 2) AS equity_krw FROM acash a"""))
def ag23(spark, sf):
    cash, positions = text.account_snapshots(_accounts(spark, sf))
    return rounded(ledger.account_equity(cash, positions, 1300.0), 2)


@query(
    "ag25_fill_pages",
    sql("lines", """SELECT CAST(l_orderkey AS VARCHAR) AS order_id, ticker, market, CASE market WHEN 'NASDAQ' THEN 'USD' ELSE 'KRW' END AS currency,
CASE l_returnflag WHEN 'R' THEN 'SELL' WHEN 'A' THEN 'BUY' ELSE '99' END AS side, CAST(qty AS BIGINT) AS qty, round(px, 8) AS price FROM lines WHERE l_linestatus = 'F'"""),
)
def ag25(spark, sf):
    rows = lines(spark, sf)
    code = F.when(F.col("l_returnflag") == "R", "01").when(F.col("l_returnflag") == "A", "02").otherwise("99")
    quantity = F.when(F.col("l_linestatus") == "F", F.col("qty").cast("long").cast("string")).otherwise(F.when(F.col("l_linenumber") % 2 == 0, "0").otherwise("x"))
    key, px = F.col("l_orderkey").cast("string"), F.col("px").cast("string")
    us = F.struct(key.alias("odno"), F.col("ticker").alias("pdno"), code.alias("sll_buy_dvsn_cd"), quantity.alias("ft_ccld_qty"), px.alias("ft_ccld_unpr3"))
    even = F.col("l_linenumber") % 2 == 0
    kr = F.struct(
        key.alias("odno"), F.col("ticker").alias("pdno"), code.alias("sll_buy_dvsn_cd"), quantity.alias("tot_ccld_qty"),
        F.when(even, px).otherwise("0").alias("avg_prvs"), (F.col("px") * F.col("qty")).cast("string").alias("tot_ccld_amt"),
    )

    def pages(market, row, name):
        each = rows.filter(F.col("market") == market)
        return each.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(row).alias(name))).alias("body"))

    out = text.overseas_fills(pages("NASDAQ", us, "output")).unionByName(text.domestic_fills(pages("KOSPI", kr, "output1")))
    return rounded(out.drop("commission"))


@query(
    "st4_concatenate_fills",
    sql("lines", "SELECT market, count(*) AS n, CAST(sum(qty) AS BIGINT) AS quantity FROM lines WHERE l_linestatus = 'F' GROUP BY market"),
)
def st4(spark, sf):
    both = ag25(spark, sf)
    parts = [both.filter(F.col("market") == m) for m in ("NASDAQ", "KOSPI")]
    joined = parts[0].unionByName(parts[1])
    return joined.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("quantity"))


# ---- pre-trade ------------------------------------------------------------------------------------

define(
    "books",
    """SELECT ticker, cash * 300 AS cash_krw, cash * 300 + held * 900 AS equity_krw, held * 900 / (cash * 300 + held * 900) AS position_weight FROM
(SELECT 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS ticker, abs(round(sum(c_acctbal), 2)) AS cash FROM customer GROUP BY 1)
JOIN (SELECT 'N' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS ticker, abs(round(sum(s_acctbal), 2)) AS held FROM supplier GROUP BY 1) USING (ticker)""",
)
define(
    "pretrade",
    """SELECT *, CASE WHEN quantity <= 0 OR quantity > 45 THEN 'FAT_FINGER_QTY' WHEN last_close <= 0 OR abs(price / last_close - 1) > 0.3 THEN 'PRICE_SANITY'
WHEN price * quantity * fx > 5e7 THEN 'MAX_ORDER_NOTIONAL' WHEN side = 'BUY' AND price * quantity * fx * 1.01 > cash_krw THEN 'INSUFFICIENT_CASH'
WHEN side = 'BUY' AND equity_krw > 0 AND position_weight + price * quantity * fx / equity_krw > 0.3 THEN 'MAX_POSITION_WEIGHT' END AS code
FROM (SELECT f.*, b.close AS last_close, k.cash_krw, k.equity_krw, k.position_weight FROM fills f JOIN bars b USING (market, ticker, d) JOIN books k USING (ticker))""",
    ("fills", "bars", "books"),
)
LIMITS = {**fl.PRETRADE, "fat_finger_qty": 45, "max_order_notional_krw": 5e7}


def _pretrade(spark, sf):
    orders = fn.to_krw(fills(spark, sf).withColumn("notional", F.col("price") * F.col("quantity")), ["notional"], ledger.FX)
    closes = bars_day(spark, sf).select("market", "ticker", "d", F.col("close").alias("last_close"))
    cash = table(spark, sf, "customer").groupBy(nation_ticker("c_nationkey").alias("ticker")).agg(F.abs(F.round(F.sum("c_acctbal"), 2)).alias("cash"))
    held = table(spark, sf, "supplier").groupBy(nation_ticker("s_nationkey").alias("ticker")).agg(F.abs(F.round(F.sum("s_acctbal"), 2)).alias("held"))
    equity = F.col("cash") * 300 + F.col("held") * 900
    books = cash.join(held, "ticker").select(
        "ticker", (F.col("cash") * 300).alias("cash_krw"), equity.alias("equity_krw"), (F.col("held") * 900 / equity).alias("position_weight")
    )
    joined = orders.join(closes, ["market", "ticker", "d"]).join(books, "ticker").withColumn("decision_price", F.col("price"))
    return joined.withColumn("code", fl.pretrade_code(LIMITS))


@query("flt11_pretrade_rules", sql("pretrade", f"SELECT {IDS}, side, code FROM pretrade"))
def flt11(spark, sf):
    return _pretrade(spark, sf).select(*ID, "side", "code")


@query(
    "flt12_circuit_breaker",
    sql("pretrade", f"SELECT {IDS}, d, submission FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY k) AS submission FROM pretrade WHERE code IS NULL) WHERE submission <= 3"),
)
def flt12(spark, sf):
    approved = _pretrade(spark, sf).filter("code IS NULL")
    return rounded(fl.circuit_breaker(approved, ["d"], ["k"], 3).select(*ID, "d", "submission"))


# ---- reconciliation ---------------------------------------------------------------------------------


def _submitted(spark, sf):
    items = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"))
    qty = items.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sum("l_quantity").cast("long").alias("qty"))
    return orders.join(qty, "order_id")


def _broker_fills(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_linestatus = 'F'")
    copies = F.explode(F.when(F.col("l_returnflag") == "R", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return done.select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast("long").alias("qty"), copies)


define(
    "sub_orders",
    "SELECT o_orderkey AS order_id, CAST(sum(l_quantity) AS BIGINT) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
define(
    "bfills",
    "SELECT l_orderkey AS order_id, CAST(l_quantity AS BIGINT) AS qty FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT l_orderkey, CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R'",
)


@query(
    "jn9_reconcile_orders",
    sql("sub_orders bfills", """SELECT order_id, s.qty AS ordered, coalesce(f, 0) AS filled, CASE WHEN coalesce(f, 0) = s.qty THEN 'OK' WHEN coalesce(f, 0) = 0 THEN 'UNFILLED' WHEN f < s.qty THEN 'PARTIAL' ELSE 'OVERFILLED' END AS status,
CASE WHEN coalesce(f, 0) = s.qty THEN 'OK' WHEN coalesce(f, 0) < s.qty THEN 'WARN' ELSE 'CRITICAL' END AS severity
FROM sub_orders s LEFT JOIN (SELECT order_id, CAST(sum(qty) AS BIGINT) AS f FROM bfills GROUP BY 1) USING (order_id)"""),
)
def jn9(spark, sf):
    return recon.reconcile_orders(_submitted(spark, sf), _broker_fills(spark, sf))


@query(
    "jn10_reconcile_positions",
    sql("lines", """, x AS (SELECT ticker, p_brand AS brand, CASE WHEN l_returnflag = 'R' THEN -qty ELSE qty END AS q, l_linestatus FROM lines JOIN part ON p_partkey = l_partkey),
e AS (SELECT ticker, brand, sum(CASE WHEN brand = 'Brand#1' THEN q + 1 ELSE q END) AS q FROM x GROUP BY ALL), b AS (SELECT ticker, brand, sum(CASE WHEN l_linestatus = 'F' THEN q ELSE q - 1 END) AS q FROM x GROUP BY ALL)
SELECT ticker, brand, CAST(coalesce(e.q, 0) AS BIGINT) AS expected, CAST(coalesce(b.q, 0) AS BIGINT) AS reported, CAST(coalesce(b.q, 0) - coalesce(e.q, 0) AS BIGINT) AS drift
FROM e FULL JOIN b USING (ticker, brand) WHERE coalesce(e.q, 0) <> coalesce(b.q, 0)"""),
)
def jn10(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    rows = lines(spark, sf)
    rows = rows.join(parts, rows.l_partkey == parts.p_partkey).withColumn(
        "q", F.when(F.col("l_returnflag") == "R", -F.col("qty")).otherwise(F.col("qty"))
    )

    def total(df):
        return df.groupBy("ticker", "brand").agg(F.sum("q").cast("long").alias("qty"))

    # differences come from edited quantities; every line counts on both sides
    expected = rows.withColumn("q", F.when(F.col("brand") == "Brand#1", F.col("q") + 1).otherwise(F.col("q")))
    reported = rows.withColumn("q", F.when(F.col("l_linestatus") == "F", F.col("q")).otherwise(F.col("q") - 1))
    return recon.reconcile_positions(total(expected), total(reported), ["ticker", "brand"])


@query(
    "st2_union_of_symbols",
    sql("bars", """SELECT market, ticker, bool_or(d < DATE '1996-01-01') AS was, bool_or(d >= DATE '1996-01-01') AS is_now FROM bars
GROUP BY market, ticker"""),
)
def st2(spark, sf):
    bars = bars_day(spark, sf)
    was = bars.filter("d < DATE '1996-01-01'").select("market", "ticker").distinct().withColumn("was", F.lit(True))
    now = bars.filter("d >= DATE '1996-01-01'").select("market", "ticker").distinct().withColumn("is_now", F.lit(True))
    both = was.join(now, ["market", "ticker"], "full_outer")
    return both.select("market", "ticker", F.coalesce("was", F.lit(False)).alias("was"), F.coalesce("is_now", F.lit(False)).alias("is_now"))


@query("jn11_unconfirmed_orders", sql("sub_orders bfills", "SELECT order_id, qty FROM sub_orders s WHERE NOT EXISTS (SELECT 1 FROM bfills b WHERE b.order_id = s.order_id)"))
def jn11(spark, sf):
    return recon.unconfirmed(_submitted(spark, sf), _broker_fills(spark, sf))


@query(
    "jn15_route_fills",
    sql("bfills", "SELECT order_id, o_orderpriority AS sleeve, count(*) AS fills, CAST(sum(qty) AS BIGINT) AS qty FROM bfills JOIN orders ON o_orderkey = order_id WHERE o_orderstatus <> 'P' GROUP BY ALL"),
)
def jn15(spark, sf):
    sleeves = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("sleeve"))
    routed = recon.route_fills(_broker_fills(spark, sf), sleeves)
    return routed.groupBy("order_id", "sleeve").agg(F.count(F.lit(1)).alias("fills"), F.sum("qty").alias("qty"))


@query(
    "jn16_run_slots",
    sql("lines", """SELECT DISTINCT l_returnflag AS account, d, market, ticker FROM lines a WHERE NOT EXISTS
(SELECT 1 FROM lines b WHERE b.l_returnflag = a.l_returnflag AND b.d = a.d AND b.market = a.market AND b.ticker = a.ticker AND b.l_linestatus = 'F')"""),
)
def jn16(spark, sf):
    rows = lines(spark, sf).withColumn("account", F.col("l_returnflag"))
    return recon.free_slots(rows, rows.filter("l_linestatus = 'F'"))


@query(
    "jn17_heartbeat_staleness",
    sql("", """SELECT component, CASE WHEN reason = 'stale' THEN round(age, 1) END AS age_hours, max_age_hours, reason FROM (
SELECT component, age, max_age_hours, CASE WHEN last IS NULL THEN 'never recorded' WHEN bad THEN 'unparseable timestamp' WHEN age > max_age_hours THEN 'stale' END AS reason FROM (
SELECT component, max_age_hours, last, component % 11 = 0 AS bad, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last)) / 3.6e9 AS age FROM (
SELECT c_custkey AS component, 24.0 * (1 + c_custkey % 5) AS max_age_hours FROM customer) e LEFT JOIN (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) h ON h.user_id = e.component)) WHERE reason IS NOT NULL"""),
)
def jn17(spark, sf):
    expected = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("component"), (F.lit(24.0) * (1 + F.col("c_custkey") % 5)).alias("max_age_hours")
    )
    last = table(spark, sf, "events").groupBy(F.col("user_id").alias("component")).agg(F.max("ts").cast("string").alias("last"))
    last = last.withColumn("last", F.when(F.col("component") % 11 == 0, "garbage").otherwise(F.col("last")))
    return recon.stale_jobs(expected, last, F.lit("2024-01-31").cast("timestamp"))


@query(
    "jn18_already_submitted",
    sql("lines", """SELECT DISTINCT market, d FROM lines WHERE (market, d) IN (SELECT (market, d) FROM lines WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber % 3 <> 0)"""),
)
def jn18(spark, sf):
    rows = lines(spark, sf)
    track = rows.select(
        "market", "d", ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("live"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_orderkey").cast("string")).otherwise("").alias("submitted_odno"),
    )
    return recon.already_submitted(rows.select("market", "d").distinct(), track)


# ---- decisions ----------------------------------------------------------------------------------------


def _signals(spark, sf):
    return staged(ind.indicator_signals(bars_hour(spark, sf)))


def _fused(spark, sf):
    return fusion.combined(_signals(spark, sf), WEIGHTS)


OUT_SQL = """, o AS (SELECT market, ticker, ts, lead(close, 1) OVER w AS c1, lead(close, 5) OVER w AS c5, lead(close, 20) OVER w AS c20, max(ts) OVER (PARTITION BY market, ticker) AS max_bar
 FROM hours WINDOW w AS (PARTITION BY market, ticker ORDER BY ts)),
res AS (SELECT f.market, f.ticker, f.ts, combined, max_bar, c1 / close - 1 AS r1, c5 / close - 1 AS r5, c20 / close - 1 AS r20 FROM fused f JOIN o USING (market, ticker, ts))"""


def hit(n: int) -> str:
    return f"CASE WHEN combined <> 0 AND r{n} <> 0 THEN (combined > 0) = (r{n} > 0) END"


def _outcomes(spark, sf):
    bars = bars_hour(spark, sf)
    decisions = _fused(spark, sf).select("market", "ticker", "ts", F.col("close").alias("decision_price"), F.col("combined").alias("combined_score"))
    return recon.outcomes(decisions, bars, order="ts")


@query(
    "jn12_decision_outcomes",
    sql("fused hours", OUT_SQL + f"""SELECT market, ticker, ts, max_bar, round(r1, 6) + 0.0 AS fwd_return_1, round(r5, 6) + 0.0 AS fwd_return_5, round(r20, 6) + 0.0 AS fwd_return_20,
{hit(1)} AS hit_1, {hit(5)} AS hit_5, {hit(20)} AS hit_20 FROM res"""),
)
def jn12(spark, sf):
    return rounded(_outcomes(spark, sf).drop("decision_price", "combined_score"), 6)


@query(
    "ag26_source_hit_rates",
    sql("fused hours isig", OUT_SQL + f"""SELECT source, count(*) AS n, round(avg(CASE WHEN h THEN 1.0 ELSE 0.0 END), 8) AS hit_rate FROM (SELECT s.source, {hit(5)} AS h FROM res JOIN isig s USING (market, ticker, ts)) WHERE h IS NOT NULL GROUP BY source"""),
)
def ag26(spark, sf):
    maps = _signals(spark, sf).groupBy("market", "ticker", "ts").agg(
        F.map_from_entries(F.collect_list(F.struct("source", "score"))).alias("source_scores")
    )
    return rounded(recon.source_hit_rates(_outcomes(spark, sf).join(maps, ["market", "ticker", "ts"])))


@query(
    "jn14_next_open_fill",
    sql("hours", """SELECT market, ticker, ts, side, round(fill_price, 6) AS fill_price, fill_time FROM (SELECT market, ticker, ts, CASE WHEN close > open THEN 'BUY' ELSE 'SELL' END AS side,
lead(open) OVER (PARTITION BY market, ticker ORDER BY ts) AS fill_price, lead(ts) OVER (PARTITION BY market, ticker ORDER BY ts) AS fill_time FROM hours) WHERE fill_price IS NOT NULL"""),
)
def jn14(spark, sf):
    bars = bars_hour(spark, sf)
    orders = bars.select("market", "ticker", "ts", F.when(F.col("close") > F.col("open"), "BUY").otherwise("SELL").alias("side"))
    return rounded(recon.next_open_fills(orders, bars), 6)


def _records(spark, sf, run_id="r1"):
    signals = _signals(spark, sf)
    scores = staged(fusion.hysteresis(staged(fusion.combined(signals, WEIGHTS)), 0.2, 0.0))
    orders = scores.filter(F.abs("combined") >= 0.3).select(
        "market", "ticker", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"),
        F.when(F.col("combined") > 0, "BUY").otherwise("SELL").alias("side"), F.round(F.abs("combined") * 100, 0).cast("long").alias("q"),
    ).select("market", "ticker", "ts", "seq", "side", (F.col("q") * F.col("seq")).alias("quantity"))
    return staged(recon.decision_records(signals, scores, orders, "engine", run_id))


@query(
    "sc13_score_maps",
    sql("isig", "SELECT market, ticker, ts, source, round(score, 6) + 0.0 AS score FROM isig"),
)
def sc13(spark, sf):
    records = _records(spark, sf).select("market", "ticker", "ts", F.explode("source_scores").alias("source", "score"))
    return rounded(records, 6)


RECORDS = """, wt AS (SELECT *, coalesce(last_value(CASE WHEN combined >= 0.2 THEN combined WHEN combined <= 0.0 THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY market, ticker ORDER BY ts ROWS UNBOUNDED PRECEDING), 0.0) AS weight FROM fused),
rec AS (SELECT *, 'engine:' || market || ':' || ticker || ':' || strftime(ts, '%Y-%m-%d %H:%M') AS key,
CASE WHEN abs(combined) >= 0.3 THEN CASE WHEN combined > 0 THEN 'BUY' ELSE 'SELL' END ELSE 'HOLD' END AS action, CASE WHEN abs(combined) >= 0.3 THEN CAST(round(abs(combined) * 100, 0) AS BIGINT) ELSE 0 END AS qty FROM wt)"""


@query(
    "sc14_decision_records",
    sql("fused", RECORDS + "SELECT key, market, ticker, ts, round(close, 6) AS close, round(combined, 6) + 0.0 AS combined_score, round(weight, 6) AS target_weight, action, qty, n_sources FROM rec"),
)
def sc14(spark, sf):
    out = _records(spark, sf)
    return rounded(
        out.select(
            "key", "market", "ticker", "ts", "close", "combined_score", "target_weight", "action", "qty",
            F.size("source_scores").cast("long").alias("n_sources"),
        ),
        6,
    )


@query(
    "sc15_journal_upsert",
    sql("fused", RECORDS + "SELECT CASE WHEN hour(ts) % 3 = 0 THEN 'append' WHEN hour(ts) % 3 = 1 AND action <> 'HOLD' THEN 'conflict' ELSE 'skip' END AS verdict, key, 1 AS seq FROM rec"
        # a second record of the same key in the batch: unchanged, or with one more
        " UNION ALL SELECT CASE WHEN hour(ts) % 3 = 1 AND action <> 'HOLD' THEN 'conflict' ELSE 'skip' END, key, 2 FROM rec WHERE hour(ts) % 5 = 0"
        " UNION ALL SELECT CASE WHEN hour(ts) % 3 = 1 AND action <> 'HOLD' THEN 'skip' ELSE 'conflict' END, key, 2 FROM rec WHERE hour(ts) % 5 = 1"),
)
def sc15(spark, sf):
    new = _records(spark, sf, "r1")
    old = new.withColumn("run_id", F.lit("r0"))
    changed = F.when((F.hour("ts") % 3 == 1) & (F.col("action") != "HOLD"), F.col("qty") + 1).otherwise(F.col("qty"))
    journal = recon.decision_hash(old.filter(F.hour("ts") % 3 != 0).withColumn("qty", changed))
    more = F.when(F.hour("ts") % 5 == 1, F.col("qty") + 1).otherwise(F.col("qty"))
    batch = new.withColumn("seq", F.lit(1)).unionByName(
        new.filter(F.hour("ts") % 5 < 2).withColumn("qty", more).withColumn("seq", F.lit(2))
    )
    return rounded(recon.journal_upsert(journal, recon.decision_hash(batch)).select("verdict", "key", "seq"))


@query(
    "sc12_canonical_hash",
    sql("lines", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sha256('{"l_orderkey":' || l_orderkey || ',"market":"' || market || '","supplier":"' || supplier || '"}') AS hash FROM lines"""),
)
def sc12(spark, sf):
    return lines(spark, sf).select(*ID, fn.canonical_hash(["supplier", "market", "l_orderkey"]).alias("hash"))


@query(
    "sc10_error_class",
    sql("", """SELECT doc_id, CASE WHEN contains(m, '초당 거래건수') OR contains(m, 'EGW00201') OR contains(m, '일시') OR contains(m, 'timeout') OR contains(m, '잠시 후') THEN 'TRANSIENT'
WHEN contains(m, '해당업무 미제공') OR contains(m, '장시작전') OR contains(m, '장종료') OR contains(m, '수량') OR contains(m, '잔고') OR contains(m, '매수가능') OR contains(m, '거부') THEN 'TERMINAL' ELSE 'UNKNOWN' END AS class
FROM (SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN ' EGW00201' WHEN 1 THEN ' 잔고 부족' WHEN 2 THEN ' 수량 timeout' WHEN 3 THEN ' 장종료' ELSE '' END AS m FROM documents)"""),
)
def sc10(spark, sf):
    tail = F.when(F.col("doc_id") % 7 == 0, " EGW00201").when(F.col("doc_id") % 7 == 1, " 잔고 부족").when(F.col("doc_id") % 7 == 2, " 수량 timeout").when(F.col("doc_id") % 7 == 3, " 장종료").otherwise("")
    return table(spark, sf, "documents").select("doc_id", fn.error_class(F.concat("text", tail)).alias("class"))


@query(
    "sc11_lenient_casts",
    sql("", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 7.5 WHEN 1 THEN 7.5 WHEN 2 THEN 7.5 WHEN 3 THEN 7.5 ELSE value END AS f, CASE event_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE CAST(trunc(value) AS BIGINT) END AS i FROM events"""),
)
def sc11(spark, sf):
    kind = F.col("event_id") % 6
    raw = F.when(kind == 0, "").when(kind == 1, "-").when(kind == 2, "abc").when(kind == 3, None).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", fn.lenient_double(raw, 7.5).alias("f"), fn.lenient_long(raw, 3).alias("i"))


# ---- reports --------------------------------------------------------------------------------------------


@query(
    "ag27_trial_counts",
    sql("", """SELECT kind, strategy, trials, round(CASE WHEN trials > 1 THEN sqrt(2 * ln(trials)) ELSE 0 END, 8) AS expected_best, CASE WHEN trials = 1 THEN 'single' WHEN trials < 5 THEN 'early' WHEN trials < 10 THEN 'caution' ELSE 'strong' END AS tier
FROM (SELECT o_orderpriority AS kind, CAST(o_custkey AS VARCHAR) AS strategy, count(*) AS trials FROM orders GROUP BY ALL)"""),
)
def ag27(spark, sf):
    log = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_custkey").cast("string").alias("strategy"))
    return rounded(recon.trial_counts(log))


@query(
    "ag32_latest_decisions",
    sql("track", """, o AS (SELECT *, row_number() OVER (PARTITION BY sleeve, market ORDER BY d DESC, k DESC) AS rn FROM track)
SELECT sleeve, market, d, k, round(equity, 2) AS equity, rn AS rank, rn = 1 AS latest FROM o WHERE rn <= 8"""),
)
def ag32(spark, sf):
    from barquet.sources.ingest import first_n

    recent = first_n(_track(spark, sf), 8, ["sleeve", "market"], [F.col("as_of").desc()])
    newest = _track(spark, sf).groupBy("sleeve", "market").agg(F.max("as_of").alias("top"))
    out = recent.join(newest, ["sleeve", "market"]).withColumn("latest", F.col("as_of") == F.col("top"))
    return rounded(out.select("sleeve", "market", F.col("as_of.d").alias("d"), F.col("as_of.o_orderkey").alias("k"), "equity", "rank", "latest"), 2)


@query(
    "ag33_benchmark_return",
    sql("bars", """SELECT market, ticker, round(latest * 1390.0 / 1300.0 / base - 1, 8) AS ret FROM (SELECT market, ticker, arg_min(close, d) FILTER (WHERE d >= DATE '1997-07-01') AS base, arg_max(close, d) AS latest FROM bars GROUP BY ALL) WHERE base <> 0"""),
)
def ag33(spark, sf):
    return rounded(recon.benchmark_return(bars_day(spark, sf), "1997-07-01", 1300.0, 1390.0))
