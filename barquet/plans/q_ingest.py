"""Source, cleaning, ingest and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barquet import schemas
from barquet.operators import quality as qa
from barquet.plans.registry import query, rounded
from barquet.plans.views import define, with_views as sql
from barquet.session import run_folder, staged
from barquet.sources import bars as rest
from barquet.sources import cleaning, ingest, text
from barquet.sources.bars import load_bars, save_bars
from barquet.sources.bridge import (
    bars_day, bars_day_s, corrupted_bars, duration_points, funding, lines, macro, nation_market, table,
)

OHLC = "round(open, 8) AS open, round(high, 8) AS high, round(low, 8) + 0.0 AS low, round(close, 8) AS close"
COLS = ["market", "ticker", "d", "open", "high", "low", "close", "volume"]
BARS_OUT = f"SELECT market, ticker, d, {OHLC}, volume FROM"


def _n():
    return F.unix_date("d")


@query("src1_load_bars", sql("bars", f"SELECT market, ticker, currency, d, CAST(d AS TIMESTAMP) AS ts, {OHLC}, volume FROM bars"))
def src1(spark, sf):
    stored = rest.to_rest(bars_day(spark, sf))
    naive = F.when(F.dayofmonth(F.substring("ts", 1, 10).cast("date")) % 2 == 0, F.substring("ts", 1, 19)).otherwise(F.col("ts"))
    return rounded(rest.parse_bars(stored.withColumn("ts", naive)).drop("timeframe"))


@query("src2_write_bars", sql("bars", f"SELECT market, ticker, currency, d, {OHLC}, volume, '1d' AS timeframe FROM bars"))
def src2(spark, sf):
    folder = run_folder(spark, "bars")
    rest.save_bars(bars_day(spark, sf), folder)
    return rounded(rest.load_bars(spark, folder).drop("ts"))


@query("src3_market_panel", sql("bars", f"{BARS_OUT} bars WHERE market = 'KOSPI'"))
def src3(spark, sf):
    folder = run_folder(spark, "bars")
    rest.save_bars(bars_day(spark, sf), folder)
    return rounded(rest.load_bars(spark, folder, "KOSPI").select(*COLS))


define(
    "nogaps",
    """SELECT market, ticker, currency, d, open, high, low, close, coalesce(volume, 0) AS volume, ingest_seq FROM dirty
WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL""",
    ("dirty",),
)
define(
    "repaired",
    """SELECT market, ticker, currency, d, open, close, volume, ingest_seq,
CASE WHEN high < hi AND hi - high <= tol THEN hi ELSE high END AS high, CASE WHEN low > lo AND low - lo <= tol THEN lo ELSE low END AS low
FROM (SELECT *, greatest(open, high, low, close) AS hi, least(open, high, low, close) AS lo,
 1e-6 * greatest(abs(open), abs(high), abs(low), abs(close), 1.0) AS tol FROM nogaps)""",
    ("nogaps",),
)
BAD = "(high < greatest(open, close, low) OR low > least(open, close, high))"


@query("src4_clean_rows", sql("nogaps", f"SELECT market, ticker, d, {OHLC}, volume, ingest_seq FROM nogaps"))
def src4(spark, sf):
    return rounded(cleaning.without_gaps(corrupted_bars(spark, sf)).select(*COLS, "ingest_seq"))


@query(
    "src5_repair_float_noise",
    sql("repaired", f"SELECT market, ticker, d, ingest_seq, {OHLC}, {BAD} AS bad FROM repaired"),
)
def src5(spark, sf):
    out = cleaning.repair_float_noise(cleaning.without_gaps(corrupted_bars(spark, sf)))
    return rounded(out.withColumn("bad", cleaning.inconsistent()).drop("currency", "volume"))


@query(
    "src6_drop_bad_ticks",
    sql("repaired", f"""SELECT market, ticker, d, {OHLC}, volume, ingest_seq FROM repaired JOIN (SELECT market, ticker FROM repaired GROUP BY ALL
HAVING count(*) FILTER (WHERE {BAD}) <= greatest(25.0, 0.005 * count(*))) USING (market, ticker) WHERE NOT {BAD}"""),
)
def src6(spark, sf):
    rows = cleaning.repair_float_noise(cleaning.without_gaps(corrupted_bars(spark, sf)))
    return rounded(cleaning.drop_bad_ticks(rows, max_dropped=25).select(*COLS, "ingest_seq"))


@query(
    "src7_rows_consistent",
    sql("repaired", f"""SELECT market, ticker, CAST(date_trunc('month', d) AS DATE) AS month, bool_and(NOT {BAD}) AS consistent
FROM repaired GROUP BY ALL"""),
)
def src7(spark, sf):
    rows = cleaning.repair_float_noise(cleaning.without_gaps(corrupted_bars(spark, sf)))
    return cleaning.consistent_symbols(rows.withColumn("month", F.trunc("d", "month")), ["market", "ticker", "month"])


def _month_pages(rows, body):
    return rows.groupBy("market", "ticker", F.trunc("d", "month").alias("month")).agg(body.alias("body"))


@query(
    "src8_parse_chart_text",
    sql("numbered", f""", ok AS (SELECT * FROM numbered WHERE n % 17 <> 0 AND n % 19 <> 0 AND n % 23 <> 0)
{BARS_OUT} ok JOIN (SELECT market, ticker, max(d) AS last FROM ok GROUP BY ALL) USING (market, ticker) WHERE last - d <= 3 * 365.25"""),
)
def src8(spark, sf):
    bars = bars_day(spark, sf).withColumn("n", _n())
    day = F.when(F.col("n") % 23 == 0, "2020XX01").otherwise(F.date_format("d", "yyyyMMdd"))
    close = F.when(F.col("n") % 19 == 0, "0").otherwise(F.col("close").cast("string"))
    full = F.concat_ws("|", day, *[F.col(c).cast("string") for c in ("open", "high", "low")], close, F.col("volume").cast("string"))
    item = F.concat(F.lit('<item data="'), F.when(F.col("n") % 17 == 0, F.concat_ws("|", day, F.lit("1"))).otherwise(full), F.lit('" />'))
    pages = _month_pages(bars.withColumn("item", item), F.concat_ws("\n", F.collect_list("item")))
    out = text.chart_items(pages.withColumnRenamed("body", "text"), ["market", "ticker"], years=3)
    return rounded(out)


@query(
    "src9_parse_broker_pages",
    sql("numbered", f"""SELECT market, ticker, d, {OHLC}, CASE WHEN n % 29 = 0 THEN 0 ELSE volume END AS volume
FROM numbered WHERE n % 19 <> 0 AND n % 23 <> 0"""),
)
def src9(spark, sf):
    bars = bars_day(spark, sf).withColumn("n", _n())
    close = F.when(F.col("n") % 19 == 0, "").when(F.col("n") % 23 == 0, "0").otherwise(F.col("close").cast("string"))
    volume = F.when(F.col("n") % 29 != 0, F.col("volume").cast("string"))
    day, o, h, lo = F.date_format("d", "yyyyMMdd"), *[F.col(c).cast("string") for c in ("open", "high", "low")]

    def body(names):
        row = F.struct(*[c.alias(n) for c, n in zip((day, o, h, lo, close, volume), names)])
        return F.to_json(F.struct(F.lit("0").alias("rt_cd"), F.collect_list(row).alias("output2")))

    us = _month_pages(bars.filter("market = 'NASDAQ'"), body(("xymd", "open", "high", "low", "clos", "tvol")))
    kr = _month_pages(
        bars.filter("market = 'KOSPI'"), body(("stck_bsop_date", "stck_oprc", "stck_hgpr", "stck_lwpr", "stck_clpr", "acml_vol"))
    )
    keys = ["market", "ticker"]
    return rounded(text.overseas_pages(us, keys).unionByName(text.domestic_pages(kr, keys)))


@query(
    "src10_stitch_pages",
    sql("numbered", f"SELECT market, ticker, d, {OHLC}, volume + CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END AS volume FROM numbered"),
)
def src10(spark, sf):
    bars = bars_day(spark, sf).select(*COLS).withColumn("page", F.lit(2))
    again = bars.withColumn("page", F.when(_n() % 3 == 0, 1).otherwise(3)).withColumn("volume", F.col("volume") + 1)
    return rounded(text.stitch_pages(bars.unionByName(again), ["market", "ticker"]))


@query("src11_macro_csv", sql("macro", "SELECT d, val FROM macro WHERE (d - DATE '1970-01-01') % 7 <> 0"))
def src11(spark, sf):
    series = macro(spark, sf)
    value = F.when(_n() % 7 == 0, ".").otherwise(F.col("val").cast("string"))
    lines_ = series.select(F.concat_ws(",", F.col("d").cast("string"), value).alias("value"))
    junk = series.agg(F.count(F.lit(1))).select(F.explode(F.array(F.lit("observation_date,VAL"), F.lit("bad,row"), F.lit(""))).alias("value"))
    return text.macro_csv(lines_.unionByName(junk))


@query(
    "src12_fundamentals_json",
    sql("points", """SELECT ticker, CASE form WHEN '10-Q' THEN 'ni_quarterly' WHEN '10-K' THEN 'equity' ELSE 'shares' END AS concept,
period_end, filed, val FROM points WHERE NOT (form = '10-Q' AND year(period_end) = 1996)"""),
)
def src12(spark, sf):
    points = duration_points(spark, sf)
    bad = (F.col("form") == "10-Q") & (F.year("period_end") == 1996)
    point = F.struct(
        F.col("period_end").cast("string").alias("period_end"),
        F.when(bad, "not a date").otherwise(F.col("filed").cast("string")).alias("filed"),
        "val",
    )

    def points_of(form):
        return F.collect_list(F.when(F.col("form") == form, point))

    files = points.groupBy("ticker").agg(
        F.to_json(
            F.struct(
                "ticker",
                points_of("10-Q").alias("ni_quarterly"),
                points_of("10-K").alias("equity"),
                points_of("10-H").alias("shares"),
            )
        ).alias("value")
    )
    folder = run_folder(spark, "fundamentals")
    files.select(F.col("ticker").alias("file"), "value").write.partitionBy("file").text(folder)
    return text.load_fundamentals(spark, folder)


define(
    "units",
    """SELECT ticker, form AS concept, period_end, filed, val, lot AS seq, CASE lot WHEN 0 THEN 'EUR' WHEN 1 THEN 'shares' WHEN 2 THEN 'USD' ELSE 'KRW' END AS unit
FROM (SELECT ticker, form, s1 - 1 AS period_end, CAST(s1 + CAST(20 + lot * 13 AS INTEGER) AS DATE) AS filed, lot, round(sum(o_totalprice), 2) AS val
FROM cuts GROUP BY ticker, form, s0, s1, lot) WHERE NOT (lot = 2 AND ticker IN ('N03', 'N06', 'N09', 'N12')) AND NOT (lot < 3 AND ticker = 'N10') AND NOT (form = '10-K' AND ticker IN ('N01', 'N02'))""",
    ("cuts",),
)


@query(
    "src13_choose_series",
    sql("units", """SELECT ticker, concept, unit, period_end, filed, val FROM (SELECT *, dense_rank() OVER (PARTITION BY ticker
ORDER BY CASE concept WHEN '10-K' THEN 0 ELSE 1 END, CASE unit WHEN 'USD' THEN 0 WHEN 'shares' THEN 1 ELSE 2 END, seq) AS k
FROM units WHERE concept IN ('10-K', '10-Q')) WHERE k = 1"""),
)
def src13(spark, sf):
    points = duration_points(spark, sf)
    lot = (F.datediff("filed", "period_end") - 21) / 13
    rows = points.withColumn("seq", lot.cast("int")).withColumn("concept", F.col("form"))
    rows = rows.withColumn("unit", F.get(F.array(*[F.lit(u) for u in ("EUR", "shares", "USD", "KRW")]), F.col("seq")))
    rows = rows.filter(
        ~((F.col("seq") == 2) & F.col("ticker").isin("N03", "N06", "N09", "N12"))
        & ~((F.col("seq") < 3) & (F.col("ticker") == "N10"))
        & ~((F.col("form") == "10-K") & F.col("ticker").isin("N01", "N02"))
    )
    # the bodies as they are downloaded: units in order of arrival, with points that cannot be used among them
    point = F.struct(F.col("start").cast("string").alias("start"), F.col("period_end").cast("string").alias("end"), F.col("filed").cast("string").alias("filed"), "val", "fy", "form")
    bad = F.array(F.struct(F.lit("").alias("start"), F.lit("soon").alias("end"), F.lit("2020-01-01").alias("filed"), F.lit(1.0).alias("val"), F.lit(2020).alias("fy"), F.lit("x").alias("form")))
    units = rows.groupBy("ticker", "concept", "seq", "unit").agg(F.concat(F.collect_list(point), bad).alias("points"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "unit", "points")))
    bodies = units.groupBy("ticker", "concept").agg(F.map_from_entries(F.transform(ordered, lambda u: F.struct(u["unit"], u["points"]))).alias("units"))
    bodies = bodies.select("ticker", "concept", F.to_json(F.struct(F.lit(320193).alias("cik"), F.col("concept").alias("tag"), "units")).alias("body"))
    # a concept that a company does not report comes as an error page
    missing = bodies.select("ticker", F.lit("10-K").alias("concept"), F.lit("<html>not found</html>").alias("body")).filter(F.col("ticker").isin("N01", "N02"))
    found = text.concept_points(bodies.unionByName(missing), ["ticker", "concept"])
    out = text.preferred_series(found, ["ticker"], concepts=["10-K", "10-Q"])
    return rounded(out.select("ticker", "concept", "unit", "period_end", "filed", "val"))


@query(
    "src14_constituents",
    sql("", "SELECT replace('S' || CAST(s_suppkey AS VARCHAR) || '.B', '.', '-') AS ticker, s_name AS name FROM supplier WHERE s_suppkey % 10 <> 0"),
)
def src14(spark, sf):
    rows = table(spark, sf, "supplier").select(
        F.when(F.col("s_suppkey") % 10 == 0, "  ").otherwise(F.concat(F.lit(" S"), "s_suppkey", F.lit(".B "))).alias("Symbol"),
        F.col("s_name").alias("name"),
    )
    return text.constituents(rows)


def _supplier_listing(spark, sf):
    return table(spark, sf, "supplier").select(
        nation_market("s_nationkey").alias("market"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.col("s_suppkey").alias("seq"),
        F.col("s_acctbal").alias("cap"),
    )


@query(
    "src15_universe",
    sql("", """SELECT * FROM (SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'NASDAQ' ELSE 'KOSPI' END AS market, 'S' || CAST(s_suppkey AS VARCHAR) AS ticker,
row_number() OVER (PARTITION BY s_nationkey % 2 ORDER BY s_suppkey) AS rank FROM supplier) WHERE rank <= CASE market WHEN 'NASDAQ' THEN 30 ELSE 20 END"""),
)
def src15(spark, sf):
    return rounded(ingest.universe(_supplier_listing(spark, sf), 30, 20).select("market", "ticker", "rank"))


@query(
    "src16_size_bucket",
    sql("sbars", """, l AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS ticker, s_acctbal AS cap FROM supplier),
a AS (SELECT supplier AS ticker, sum(px * qty) AS amount FROM lines GROUP BY 1),
r AS (SELECT ticker, row_number() OVER (ORDER BY cap DESC, ticker) AS cap_rank FROM l),
b AS (SELECT r.ticker, cap_rank, row_number() OVER (ORDER BY cap_rank) AS pick FROM r JOIN a USING (ticker) WHERE cap_rank > 10 AND cap_rank <= 80 AND amount > 1e7)
SELECT ticker, cap_rank, n_bars FROM b JOIN (SELECT ticker, count(*) AS n_bars FROM sbars WHERE open > 0 AND close > 0 GROUP BY 1 HAVING count(*) >= 252) USING (ticker) WHERE pick <= 40"""),
)
def src16(spark, sf):
    amount = lines(spark, sf).groupBy(F.col("supplier").alias("ticker")).agg(F.sum(F.col("px") * F.col("qty")).alias("amount"))
    listing = _supplier_listing(spark, sf).join(amount, "ticker", "left")
    out = ingest.size_bucket(listing, bars_day_s(spark, sf), 10, 80, 1e7, 40)
    return rounded(out.select("ticker", "cap_rank", "n_bars"))


@query(
    "src17_daily_funding",
    sql("funding", "SELECT coin, CAST(make_timestamp(epoch_ms * 1000) AS DATE) AS d, round(sum(rate), 8) + 0.0 AS rate FROM funding GROUP BY ALL"),
)
def src17(spark, sf):
    return rounded(text.daily_funding(funding(spark, sf)))


@query(
    "src18_jsonl_log",
    sql("", """SELECT 'E' || CAST(o_orderkey AS VARCHAR) AS experiment_id, o_orderpriority AS kind, o_orderstatus AS strategy,
round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0"""),
)
def src18(spark, sf):
    orders = table(spark, sf, "orders")
    record = F.to_json(
        F.struct(
            F.when(F.col("o_orderkey") % 13 != 0, F.concat(F.lit("E"), "o_orderkey")).alias("experiment_id"),
            F.col("o_orderpriority").alias("kind"),
            F.col("o_orderstatus").alias("strategy"),
            F.create_map(F.lit("price"), F.col("o_totalprice")).alias("metrics"),
        )
    )
    lines_ = orders.select(F.when(F.col("o_orderkey") % 11 == 0, F.substring(record, 1, 25)).otherwise(record).alias("value"))
    folder = run_folder(spark, "log")
    lines_.write.text(folder)
    log = text.load_jsonl(spark, folder, schemas.EXPERIMENT, "experiment_id")
    return rounded(log.select("experiment_id", "kind", "strategy", F.col("metrics")["price"].alias("price")), 2)


define(
    "member_log",
    "SELECT DISTINCT market, ticker, CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) - 1 AS as_of_date FROM bars",
    ("bars",),
)


def _membership_log(spark, sf):
    members = bars_day(spark, sf).select("market", "ticker", F.last_day("d").alias("as_of_date")).distinct()
    return members.groupBy("as_of_date").agg(
        F.collect_list(F.struct("market", "ticker")).alias("symbols")
    ).withColumn("universe_id", F.lit("nations"))


@query(
    "src19_idempotent_append",
    sql("member_log", """SELECT as_of_date, count(*) AS n FROM member_log WHERE as_of_date NOT IN
(SELECT as_of_date FROM member_log WHERE as_of_date < DATE '1998-01-01') GROUP BY 1"""),
)
def src19(spark, sf):
    log = _membership_log(spark, sf)
    fresh = ingest.new_rows(log.filter("as_of_date < DATE '1998-01-01'"), log, ["as_of_date"])
    return rounded(fresh.select("as_of_date", F.size("symbols").alias("n")))


@query(
    "src20_membership",
    sql("member_log", """SELECT b.market, b.ticker, b.d, CASE WHEN b.market = 'KOSPI' THEN b.ticker || '.KS' ELSE b.ticker END AS source_symbol
FROM bars b JOIN (SELECT d, (SELECT max(as_of_date) FROM member_log m WHERE m.as_of_date <= x.d) AS s FROM (SELECT DISTINCT d FROM bars) x) k USING (d)
JOIN member_log m ON m.as_of_date = k.s AND m.market = b.market AND m.ticker = b.ticker"""),
)
def src20(spark, sf):
    members = ingest.membership(_membership_log(spark, sf))
    bars = bars_day(spark, sf).select("market", "ticker", "d")
    kept = ingest.members_as_of(bars, members)
    names = members.select("as_of_date", "market", "ticker", "source_symbol")
    return kept.join(names, ["as_of_date", "market", "ticker"]).select("market", "ticker", "d", "source_symbol")


def _merge(spark, sf):
    bars = bars_day(spark, sf).select(*COLS)
    existing = bars.filter((F.col("d") < "1997-06-01") & (F.col("ticker") != "N04"))
    first = bars.filter("d >= DATE '1997-01-01'").withColumn("seq", F.lit(1))
    again = first.withColumn("volume", F.col("volume") + 1).withColumn("seq", F.when(_n() % 2 == 0, 0).otherwise(2))
    return existing, first.unionByName(again)


define(
    "fresh_bars",
    """SELECT b.market, b.ticker, b.d, open, high, low, close, volume + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS volume
FROM numbered b LEFT JOIN (SELECT market, ticker, max(d) AS m FROM bars WHERE d < DATE '1997-06-01' AND ticker <> 'N04' GROUP BY ALL) e USING (market, ticker)
WHERE b.d >= DATE '1997-01-01' AND b.d < DATE '1998-01-01' AND (m IS NULL OR b.d > m)""",
    ("numbered",),
)


@query(
    "src21_append_only_merge",
    sql("fresh_bars", f"""{BARS_OUT} fresh_bars UNION ALL {BARS_OUT} bars WHERE d < DATE '1997-06-01' AND ticker <> 'N04'"""),
)
def src21(spark, sf):
    existing, fetched = _merge(spark, sf)
    return rounded(ingest.append_bars(existing, fetched, "1998-01-01", "seq"))


@query(
    "src22_forward_summary",
    sql("fresh_bars", "SELECT market, count(DISTINCT ticker) AS symbols_updated, count(*) AS bars_appended FROM fresh_bars GROUP BY market"),
)
def src22(spark, sf):
    existing, fetched = _merge(spark, sf)
    return ingest.append_summary(ingest.appendable(existing, fetched, "1998-01-01", "seq"))


HALF = "sum(CAST('0x' || substring(h, {}, 15) AS BIGINT))"
define(
    "hashes",
    f"""SELECT market, sha256(concat_ws('|', count(*), {HALF.format(1)}, {HALF.format(17)})) AS content_hash FROM (
SELECT market, md5(concat_ws('|', market, ticker, strftime(d, '%Y-%m-%d'),
CAST(CAST(round(open, 8) AS DECIMAL(24,8)) AS VARCHAR), CAST(CAST(round(high, 8) AS DECIMAL(24,8)) AS VARCHAR), CAST(CAST(round(low, 8) AS DECIMAL(24,8)) AS VARCHAR),
CAST(CAST(round(close, 8) AS DECIMAL(24,8)) AS VARCHAR), CAST(volume AS VARCHAR))) AS h FROM bars) GROUP BY market""",
    ("bars",),
)


@query(
    "src23_manifest",
    sql("hashes", """SELECT market, min(d) AS start_date, max(d) AS end_date, count(*) AS n_bars, array_to_string(list_sort(list(DISTINCT ticker)), ',') AS symbols,
count(DISTINCT ticker) AS n_symbols, any_value(content_hash) AS content_hash, 'research' AS provider, 'adjusted' AS adjustment
FROM bars JOIN hashes USING (market) GROUP BY market"""),
)
def src23(spark, sf):
    return ingest.manifest(bars_day(spark, sf)).withColumn("symbols", F.array_join("symbols", ","))


@query("src23_manifest_symbols", sql("bars", "SELECT market, ticker, min(d) AS start_date, max(d) AS end_date, count(*) AS n_bars FROM bars GROUP BY market, ticker"))
def src23_symbols(spark, sf):
    return ingest.manifest_symbols(bars_day(spark, sf))


@query("src24_content_hash", sql("hashes", "SELECT market, content_hash, market = 'KOSPI' AS verified FROM hashes"))
def src24(spark, sf):
    bars = bars_day(spark, sf)
    stored = ingest.content_hashes(bars)
    touched = bars.withColumn("volume", F.col("volume") + F.when((F.col("market") == "NASDAQ") & (F.col("d") == "1997-03-03"), 1).otherwise(0))
    return stored.join(ingest.verify(stored, touched), "market")


# ---- quality ----------------------------------------------------------------------------------

BYQ = "PARTITION BY market, ticker ORDER BY ingest_seq"
define("qnames", "SELECT DISTINCT market, ticker FROM bars UNION ALL SELECT 'NASDAQ', 'X' || CAST(r_regionkey AS VARCHAR) FROM region", ("bars",))
define(
    "qrows",
    f"""SELECT *, lag(d) OVER ({BYQ}) AS pd, lag(close) OVER ({BYQ}) AS pc FROM nogaps""",
    ("nogaps",),
)
define(
    "qcounts",
    """SELECT n.market, n.ticker, coalesce(n_bars, 0) AS n_bars, start_date, end_date, CASE WHEN coalesce(n_bars, 0) < 2 THEN 1 ELSE 0 END AS TOO_FEW_BARS,
coalesce(dup, 0) AS DUPLICATE_TIMESTAMPS, coalesce(uns, 0) AS NOT_SORTED, coalesce(neg, 0) AS NONPOSITIVE_PRICE_OR_NEG_VOLUME, coalesce(bad, 0) AS OHLC_INCONSISTENT,
coalesce(ext, 0) AS EXTREME_RETURN, coalesce(runs, 0) AS STALE_PRICE_RUN, coalesce(zv, 0) AS ZERO_VOLUME, coalesce(gap, 0) AS CALENDAR_GAP FROM qnames n
LEFT JOIN (SELECT market, ticker, count(*) AS n_bars, min(d) AS start_date, max(d) AS end_date, count(*) FILTER (WHERE d <= pd) AS uns,
 count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR volume < 0) AS neg,
 count(*) FILTER (WHERE high < greatest(open, close, low) OR low > least(open, close, high) OR high < low) AS bad,
 count(*) FILTER (WHERE pc > 0 AND abs(close / pc - 1) > 0.4) AS ext, count(*) FILTER (WHERE volume = 0) AS zv,
 count(*) FILTER (WHERE d > pd AND CASE WHEN d - pd > 14 THEN (d - pd) - 2 * ((d - pd + isodow(pd) - 1) // 7)
   ELSE len(list_filter(generate_series(pd + 1, d - 1, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) END > 5) AS gap FROM qrows GROUP BY ALL) a USING (market, ticker)
LEFT JOIN (SELECT market, ticker, count(*) AS dup FROM (SELECT market, ticker, d FROM nogaps GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL) b USING (market, ticker)
LEFT JOIN (SELECT market, ticker, count(*) AS runs FROM (SELECT market, ticker, g FROM (SELECT market, ticker, sum(CASE WHEN pc IS NULL OR close <> pc THEN 1 ELSE 0 END)
 OVER (PARTITION BY market, ticker ORDER BY ingest_seq) AS g FROM qrows) GROUP BY ALL HAVING count(*) > 5) GROUP BY ALL) c USING (market, ticker)""",
    ("qnames", "nogaps", "qrows"),
)


def _quality_input(spark, sf):
    rows = staged(cleaning.without_gaps(corrupted_bars(spark, sf)))
    extra = table(spark, sf, "region").select(F.lit("NASDAQ").alias("market"), F.concat(F.lit("X"), "r_regionkey").alias("ticker"))
    names = rows.select("market", "ticker").distinct().unionByName(extra)
    return rows, names


def _counts(spark, sf):
    rows, names = _quality_input(spark, sf)
    return qa.issue_counts(rows, names)


CHECKS = {
    "qa1_too_few_bars": "TOO_FEW_BARS",
    "qa2_duplicate_timestamps": "DUPLICATE_TIMESTAMPS",
    "qa3_not_sorted": "NOT_SORTED",
    "qa4_nonpositive": "NONPOSITIVE_PRICE_OR_NEG_VOLUME",
    "qa5_ohlc_inconsistent": "OHLC_INCONSISTENT",
    "qa6_extreme_return": "EXTREME_RETURN",
    "qa8_zero_volume": "ZERO_VOLUME",
    "qa9_calendar_gap": "CALENDAR_GAP",
}


def _check(code):
    def run(spark, sf):
        return _counts(spark, sf).filter(F.col(code) > 0).select("market", "ticker", "n_bars", F.col(code).alias("count"))

    return run


for _id, _code in CHECKS.items():
    query(_id, sql("qcounts", f"SELECT market, ticker, n_bars, {_code} AS count FROM qcounts WHERE {_code} > 0"))(_check(_code))


@query(
    "qa7_stale_price_run",
    sql("hours", """, q AS (SELECT market, ticker, ts, floor(close / 100) AS c, lag(floor(close / 100)) OVER (PARTITION BY market, ticker ORDER BY ts) AS pc FROM hours),
g AS (SELECT *, sum(CASE WHEN pc IS NULL OR c <> pc THEN 1 ELSE 0 END) OVER (PARTITION BY market, ticker ORDER BY ts) AS run FROM q)
SELECT market, ticker, count(*) AS stale_runs FROM (SELECT market, ticker, run FROM g GROUP BY ALL HAVING count(*) > 5) GROUP BY ALL"""),
)
def qa7(spark, sf):
    from barquet.sources.bridge import bars_hour

    flat = bars_hour(spark, sf).withColumn("close", F.floor(F.col("close") / 100).cast("double")).withColumn("d", F.to_date("ts"))
    return qa.stale_runs(qa.with_arrival(flat, "ts"), "ts", 5).withColumnRenamed("STALE_PRICE_RUN", "stale_runs")


@query(
    "qa10_report",
    sql("qcounts", """SELECT market, ticker, n_bars, start_date, end_date,
sign(TOO_FEW_BARS) + sign(DUPLICATE_TIMESTAMPS) + sign(NOT_SORTED) + sign(NONPOSITIVE_PRICE_OR_NEG_VOLUME) + sign(OHLC_INCONSISTENT) + sign(EXTREME_RETURN)
 + sign(STALE_PRICE_RUN) + sign(ZERO_VOLUME) + sign(CALENDAR_GAP) AS n_issues,
TOO_FEW_BARS + DUPLICATE_TIMESTAMPS + NOT_SORTED + NONPOSITIVE_PRICE_OR_NEG_VOLUME + OHLC_INCONSISTENT = 0 AS passed FROM qcounts"""),
)
def qa10(spark, sf):
    return qa.report(_counts(spark, sf))


@query(
    "qa11_stale_symbols",
    sql("qnames", """SELECT n.market, n.ticker, last_date, (SELECT max(d) FROM bars) - last_date AS age_days, CASE WHEN last_date IS NULL THEN 'NO_BARS' ELSE 'STALE' END AS code
FROM qnames n LEFT JOIN (SELECT market, ticker, max(d) AS last_date FROM bars GROUP BY ALL) USING (market, ticker)
WHERE last_date IS NULL OR (SELECT max(d) FROM bars) - last_date > 1"""),
)
def qa11(spark, sf):
    bars = bars_day(spark, sf)
    _, names = _quality_input(spark, sf)
    return qa.staleness(bars, names, bars.agg(F.max("d")).scalar(), 1)


@query("qa12_duplicate_dates", sql("nogaps", "SELECT market, ticker, d, count(*) AS n FROM nogaps GROUP BY ALL HAVING count(*) > 1"))
def qa12(spark, sf):
    return qa.duplicate_dates(_quality_input(spark, sf)[0])


@query(
    "qa13_fx_rate",
    sql("", """SELECT event_id, CASE WHEN event_id % 50 = 1 THEN 'FX_BAD' WHEN event_id % 50 = 2 THEN 'FX_NAN'
WHEN value - 10 * (event_id % 3) <= 0 THEN 'FX_NONPOSITIVE' WHEN (value - 10 * (event_id % 3)) * CASE WHEN event_id % 50 = 3 THEN 1e9 ELSE 1 END > 1e7
 OR (value - 10 * (event_id % 3)) < 1e-6 THEN 'FX_OUT_OF_BAND' END AS code FROM events"""),
)
def qa13(spark, sf):
    events = table(spark, sf, "events")
    number = (F.col("value") - 10 * (F.col("event_id") % 3)) * F.when(F.col("event_id") % 50 == 3, 1e9).otherwise(1.0)
    kind = F.col("event_id") % 50
    rate = F.when(kind == 1, "n/a").when(kind == 2, "NaN").otherwise(number.cast("string"))
    return events.select("event_id", qa.fx_check(rate).alias("code"))


@query(
    "qa14_price_jumps",
    sql("bars", """SELECT market, ticker, d, round(move, 8) AS move FROM (SELECT market, ticker, d, close / lag(close) OVER (PARTITION BY market, ticker ORDER BY d) - 1 AS move FROM bars)
WHERE abs(move) > 0.5"""),
)
def qa14(spark, sf):
    return rounded(qa.price_jumps(bars_day(spark, sf)))


@query(
    "qa15_validate_all",
    sql("qcounts", """SELECT count(*) AS datasets, count(*) FILTER (WHERE p) AS passed, sum(n_bars) AS n_bars, bool_and(p) AS all_passed FROM (
SELECT n_bars, TOO_FEW_BARS + DUPLICATE_TIMESTAMPS + NOT_SORTED + NONPOSITIVE_PRICE_OR_NEG_VOLUME + OHLC_INCONSISTENT = 0 AS p FROM qcounts)"""),
)
def qa15(spark, sf):
    return qa.validation_summary(qa.report(_counts(spark, sf)))


@query(
    "src25_gated_update",
    sql("bars", """, v AS (SELECT market, ticker, bool_and(NOT (close > 20000)) AS passed FROM bars WHERE d >= DATE '1998-01-01' GROUP BY ALL),
st AS (SELECT market, ticker, CASE WHEN passed THEN 'ok' WHEN EXISTS (SELECT 1 FROM bars p WHERE p.ticker = v.ticker AND p.d < DATE '1998-01-01' AND CAST(substring(p.ticker, 2) AS INTEGER) % 3 <> 0)
 THEN 'quality_fail_transient' ELSE 'quality_fail' END AS status FROM v),
kept AS (SELECT market, ticker, 'prior' AS origin FROM bars p WHERE d < DATE '1998-01-01' AND CAST(substring(ticker, 2) AS INTEGER) % 3 <> 0
  AND NOT EXISTS (SELECT 1 FROM st WHERE st.ticker = p.ticker AND status = 'ok')
 UNION ALL SELECT market, ticker, 'fetched' FROM bars f WHERE d >= DATE '1998-01-01' AND EXISTS (SELECT 1 FROM st WHERE st.ticker = f.ticker AND status = 'ok'))
SELECT market, ticker, status, origin, count(k.origin) AS n FROM st LEFT JOIN kept k USING (market, ticker) GROUP BY ALL"""),
)
def src25(spark, sf):
    prior, fetched, verdicts = _update(spark, sf)
    prior, fetched = prior.withColumn("origin", F.lit("prior")), fetched.withColumn("origin", F.lit("fetched"))
    served, status = ingest.gated_update(prior, fetched, verdicts)
    counts = served.groupBy("market", "ticker", "origin").agg(F.count(F.lit(1)).alias("n"))
    return status.join(counts, ["market", "ticker"], "left").select(
        "market", "ticker", "status", "origin", F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def _update(spark, sf):
    """Stored bars, newly fetched ones and the verdict on each fetched symbol."""
    bars = bars_day(spark, sf)
    prior = bars.filter("d < DATE '1998-01-01' AND cast(substring(ticker, 2) as int) % 3 <> 0")
    fetched = bars.filter("d >= DATE '1998-01-01'")
    verdicts = fetched.groupBy("market", "ticker").agg(F.bool_and(~(F.col("close") > 20000)).alias("passed"))
    return prior, fetched, verdicts


@query(
    "src25_gated_store",
    sql("bars", """, v AS (SELECT ticker, bool_and(NOT (close > 20000)) AS passed FROM bars WHERE d >= DATE '1998-01-01' GROUP BY ALL)
SELECT market, ticker, d, open, high, low, close, volume, currency FROM bars WHERE d >= DATE '1998-01-01' AND ticker IN (SELECT ticker FROM v WHERE passed)
UNION ALL SELECT market, ticker, d, open, high, low, close, volume, currency FROM bars WHERE d < DATE '1998-01-01' AND CAST(substring(ticker, 2) AS INTEGER) % 3 <> 0
 AND NOT ticker IN (SELECT ticker FROM v WHERE passed)"""),
)
def src25_store(spark, sf):
    prior, fetched, verdicts = _update(spark, sf)
    folder = run_folder(spark, "store")
    save_bars(prior, folder)
    verdicts = staged(verdicts, "verdicts")
    for _ in range(2):  # the second call finds the update committed and only repeats it
        ingest.store_update(spark, folder, fetched, verdicts, "u1")
    return load_bars(spark, folder).select("market", "ticker", "d", "open", "high", "low", "close", "volume", "currency")


define(
    "istate",
    """SELECT market, ticker, k, (SELECT max(d) FROM bars) + INTERVAL 2 DAY AS now, CAST(max(d) AS TIMESTAMP) AS last_success, max(d) AS last_date,
['pending', 'ok', 'error', 'cooldown', 'quality_fail'][1 + k % 5] AS status,
CASE WHEN k % 5 = 3 THEN (SELECT max(d) FROM bars) + INTERVAL 2 DAY + CASE WHEN k % 2 = 0 THEN INTERVAL 1 DAY ELSE -INTERVAL 1 DAY END END AS cooldown_until
FROM (SELECT *, CAST(substring(ticker, 2) AS INTEGER) AS k FROM bars) WHERE k % 7 <> 6 GROUP BY market, ticker, k""",
    ("bars",),
)
define("iuniverse", "SELECT DISTINCT market, ticker, CAST(substring(ticker, 2) AS INTEGER) AS seq, (SELECT max(d) FROM bars) + INTERVAL 2 DAY AS now FROM bars", ("bars",))


def _state(spark, sf):
    bars = bars_day(spark, sf).withColumn("k", F.substring("ticker", 2, 2).cast("int"))
    now = F.timestamp_add("DAY", F.lit(2), bars.agg(F.max("d")).scalar().cast("timestamp"))
    kinds = F.array(*[F.lit(s) for s in ("pending", "ok", "error", "cooldown", "quality_fail")])
    state = bars.filter("k % 7 <> 6").groupBy("market", "ticker", "k").agg(F.max("d").alias("last_date")).select(
        "market",
        "ticker",
        "last_date",
        F.col("last_date").cast("timestamp").alias("last_success"),
        F.get(kinds, F.col("k") % 5).alias("status"),
        F.when(F.col("k") % 5 == 3, F.timestamp_add("DAY", F.when(F.col("k") % 2 == 0, 1).otherwise(-1), now)).alias("cooldown_until"),
    )
    names = bars.select("market", "ticker", F.col("k").alias("seq")).distinct()
    return names, state, now


CLASS = """CASE WHEN s.cooldown_until > u.now THEN 'cooldown' WHEN coalesce(status, 'pending') = 'ok' THEN CASE WHEN last_success >= u.now - INTERVAL 3 DAY THEN 'done' ELSE 'pending' END
WHEN status = 'error' THEN 'error' WHEN status = 'quality_fail' THEN 'quality_fail' ELSE 'pending' END"""


@query(
    "src26_ingest_backlog",
    sql("istate iuniverse", """SELECT market, ticker, seq, rank FROM (SELECT u.market, u.ticker, seq, row_number() OVER (ORDER BY seq) AS rank FROM iuniverse u LEFT JOIN istate s USING (market, ticker)
WHERE NOT coalesce(s.cooldown_until > u.now, false) AND coalesce(status, 'pending') <> 'quality_fail'
 AND (coalesce(status, 'pending') = 'pending' OR last_success IS NULL OR status IN ('error', 'cooldown') OR (status = 'ok' AND last_success < u.now - INTERVAL 3 DAY))) WHERE rank <= 10"""),
)
def src26(spark, sf):
    names, state, now = _state(spark, sf)
    return rounded(ingest.backlog(names, state, now, 10, 3))


@query(
    "src27_ingest_progress",
    sql("istate iuniverse", f"""SELECT count(*) AS total, count(*) FILTER (WHERE c = 'done') AS done, count(*) FILTER (WHERE c = 'pending') AS pending,
count(*) FILTER (WHERE c = 'cooldown') AS cooldown, count(*) FILTER (WHERE c = 'error') AS error, count(*) FILTER (WHERE c = 'quality_fail') AS quality_fail
FROM (SELECT {CLASS} AS c FROM iuniverse u LEFT JOIN istate s USING (market, ticker))"""),
)
def src27(spark, sf):
    names, state, now = _state(spark, sf)
    return ingest.progress(names, state, now, 3)


@query(
    "ag31_data_freshness",
    sql("istate", "SELECT count(*) AS symbols, count(*) FILTER (WHERE status = 'ok') AS ok, max(last_date) AS newest, min(last_date) AS oldest FROM istate"),
)
def ag31(spark, sf):
    _, state, _ = _state(spark, sf)
    return state.agg(
        F.count(F.lit(1)).alias("symbols"), F.count_if(F.col("status") == "ok").alias("ok"),
        F.max("last_date").alias("newest"), F.min("last_date").alias("oldest"),
    )


@query(
    "ag34_fundamental_inputs",
    sql("points", """, f AS (SELECT market, ticker, CASE form WHEN '10-Q' THEN 'ni' WHEN '10-K' THEN 'equity' ELSE 'shares' END AS concept, period_end, filed,
 CASE WHEN form = '10-H' AND ticker IN ('N05', 'N06') THEN 0 ELSE val END AS val FROM points),
n AS (SELECT market, ticker, round(sum(val), 2) AS ttm_net_income FROM (SELECT *, row_number() OVER (PARTITION BY market, ticker ORDER BY period_end DESC, filed DESC) AS rn FROM f WHERE concept = 'ni') WHERE rn <= 4 GROUP BY ALL)
SELECT market, ticker, ttm_net_income, e.equity, e.shares FROM n JOIN (SELECT market, ticker, arg_max(val, row(period_end, filed)) FILTER (WHERE concept = 'equity') AS equity,
 arg_max(val, row(period_end, filed)) FILTER (WHERE concept = 'shares') AS shares FROM f GROUP BY ALL) e USING (market, ticker) WHERE coalesce(equity, 0) <> 0 AND coalesce(shares, 0) <> 0"""),
)
def ag34(spark, sf):
    points = duration_points(spark, sf)
    concept = F.when(F.col("form") == "10-Q", "ni").when(F.col("form") == "10-K", "equity").otherwise("shares")
    empty = (F.col("form") == "10-H") & F.col("ticker").isin("N05", "N06")
    filings = points.withColumn("concept", concept).withColumn("val", F.when(empty, 0.0).otherwise(F.col("val")))
    return rounded(ingest.fundamental_inputs(filings), 2)
