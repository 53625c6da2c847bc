"""Sources that arrive as text, CSV or JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barquet import schemas
from barquet.functions.columns import lenient_double, lenient_long


def chart_items(texts: DataFrame, keys: Sequence[str], years: float | None = None, text: str = "text") -> DataFrame:
    """Bars from ``data="YYYYMMDD|o|h|l|c|v"`` items; malformed items and zero closes are skipped.

    With ``years`` only the bars within that many 365.25-day years of each key's newest bar stay.
    """
    keys = list(keys)
    item = F.explode(F.regexp_extract_all(F.col(text), F.lit(r'data="([^"]*)"'), 1)).alias("item")
    part = F.split("item", r"\|")
    rows = texts.select(*keys, item).withColumn("p", part).filter(F.size("p") >= 6)
    day = F.get("p", F.lit(0))
    bars = rows.select(
        *keys,
        F.when(F.length(day) == 8, F.try_to_date(day, "yyyyMMdd")).alias("d"),
        *[F.get("p", F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(("open", "high", "low", "close"), 1)],
        F.get("p", F.lit(5)).try_cast("double").cast("long").alias("volume"),
    ).dropna()
    bars = bars.filter("close <> 0")
    if years:
        newest = bars.groupBy(*keys).agg(F.max("d").alias("_last"))
        bars = bars.join(newest, keys).filter(F.datediff("_last", "d") <= years * 365.25).drop("_last")
    return bars


def _paged(pages: DataFrame, schema, keys: Sequence[str], body: str) -> DataFrame:
    parsed = pages.select(*keys, F.from_json(body, schema).alias("j")).filter("j.rt_cd = '0'")
    return parsed.select(*keys, F.explode("j.output2").alias("row"))


def _bars_from(rows: DataFrame, keys: Sequence[str], day: str, o: str, h: str, lo: str, c: str, v: str) -> DataFrame:
    close = F.col(f"row.{c}").try_cast("double")
    return rows.select(
        *keys,
        F.try_to_date(F.col(f"row.{day}"), "yyyyMMdd").alias("d"),
        F.col(f"row.{o}").try_cast("double").alias("open"),
        F.col(f"row.{h}").try_cast("double").alias("high"),
        F.col(f"row.{lo}").try_cast("double").alias("low"),
        close.alias("close"),
        lenient_long(f"row.{v}").alias("volume"),
    ).filter("close IS NOT NULL AND close <> 0")


def overseas_pages(pages: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    rows = _paged(pages, schemas.OVERSEAS_PAGE, keys, body)
    return _bars_from(rows, keys, "xymd", "open", "high", "low", "clos", "tvol")


def domestic_pages(pages: DataFrame, keys: Sequence[str], body: str = "body") -> DataFrame:
    rows = _paged(pages, schemas.DOMESTIC_PAGE, keys, body)
    return _bars_from(rows, keys, "stck_bsop_date", "stck_oprc", "stck_hgpr", "stck_lwpr", "stck_clpr", "acml_vol")


def stitch_pages(bars: DataFrame, keys: Sequence[str], page: str = "page") -> DataFrame:
    """Overlapping pages of one history: per date the first page wins."""
    rest = [c for c in bars.columns if c not in (*keys, "d")]
    return bars.groupBy(*keys, "d").agg(F.min_by(F.struct(*rest), page).alias("w")).select(*keys, "d", "w.*").drop(page)


def macro_csv(lines: DataFrame, line: str = "value") -> DataFrame:
    """date,value lines; the header, missing values and unparseable rows drop out."""
    part = F.split(line, ",")
    return (
        lines.select(
            F.try_to_date(F.trim(F.get(part, F.lit(0))), "yyyy-MM-dd").alias("d"),
            F.trim(F.get(part, F.lit(1))).try_cast("double").alias("val"),
        )
        .dropna()
    )


def load_macro_csv(spark: SparkSession, path: str) -> DataFrame:
    return macro_csv(spark.read.text(path))


CONCEPTS = ("ni_quarterly", "equity", "shares")


def load_fundamentals(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file per ticker to long filings; ``_`` files, bad files and bad points are skipped."""
    files = (
        spark.read.schema(schemas.FUNDAMENTALS_FILE)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(path)
        .filter("_corrupt_record IS NULL AND ticker IS NOT NULL")
    )
    named = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(c).alias("points")) for c in CONCEPTS])
    points = files.select("ticker", F.explode(named).alias("s")).select(
        "ticker", F.col("s.concept").alias("concept"), F.explode("s.points").alias("p")
    )
    return points.select(
        "ticker",
        "concept",
        F.col("p.period_end").try_cast("date").alias("period_end"),
        F.col("p.filed").try_cast("date").alias("filed"),
        F.col("p.val").alias("val"),
    ).dropna()


def concept_points(bodies: DataFrame, keys: Sequence[str], body: str = "body", units: Sequence[str] = ("USD", "shares")) -> DataFrame:
    """Points of raw company-concept bodies, one body per row: keys, unit, seq, start, period_end, filed, val, fy, form.

    A body maps units to lists of points. The first of ``units`` it has counts (even an empty list), else the
    unit that stands first; ``seq`` is its place. A body that is no such object has no points; a point
    without a usable end, filing date or value is left out. Nothing is shuffled.
    """
    parsed = bodies.select(*keys, F.from_json(body, schemas.CONCEPT_BODY)["units"].alias("_u")).filter(F.size("_u") > 0)
    names = F.map_keys("_u")
    unit = F.coalesce(*[F.when(F.array_contains(names, u), F.lit(u)) for u in units], F.get(names, F.lit(0)))
    chosen = parsed.select(*keys, unit.alias("unit"), (F.array_position(names, unit) - 1).alias("seq"), F.explode(F.col("_u")[unit]).alias("p"))
    return chosen.select(
        *keys, "unit", "seq",
        F.col("p.start").try_cast("date").alias("start"),
        F.col("p.end").try_cast("date").alias("period_end"),
        F.col("p.filed").try_cast("date").alias("filed"),
        F.col("p.val").try_cast("double").alias("val"),
        F.col("p.fy").try_cast("int").alias("fy"),
        F.col("p.form").alias("form"),
    ).dropna(subset=["period_end", "filed", "val"])


def preferred_series(points: DataFrame, keys: Sequence[str], units: Sequence[str] = ("USD", "shares"),
                     concepts: Sequence[str] | None = None) -> DataFrame:
    """Per key the points of one series only: the first concept with data, and in it the preferred unit.

    ``points`` has ``concept``, ``unit`` and ``seq`` (order of arrival of the unit). The choice is an
    aggregate over small (key, concept, unit) rows that is joined back.
    """
    keys = list(keys)
    unit_rank = F.coalesce(*[F.when(F.col("unit") == u, F.lit(i)) for i, u in enumerate(units)], F.lit(len(units)))
    if concepts:
        concept_rank = F.coalesce(*[F.when(F.col("concept") == c, F.lit(i)) for i, c in enumerate(concepts)])
    else:
        concept_rank = F.lit(0)
    ranked = points.withColumn("_c", concept_rank).filter("_c IS NOT NULL")
    series = ranked.groupBy(*keys, "concept", "unit").agg(
        F.min(F.struct(F.col("_c"), unit_rank.alias("_u"), F.col("seq"))).alias("_o")
    )
    best = series.groupBy(*keys).agg(F.min_by(F.struct("concept", "unit"), "_o").alias("w"))
    chosen = best.select(*keys, F.col("w.concept").alias("concept"), F.col("w.unit").alias("unit"))
    return points.join(chosen, [*keys, "concept", "unit"], "left_semi")


def constituents(rows: DataFrame) -> DataFrame:
    """Tickers from the columns ``Symbol`` and ``symbol``: trimmed, dots become dashes, blanks drop out.

    Where a row's ``Symbol`` is null or empty its ``symbol`` counts.
    """
    spelt = [c for c in ("Symbol", "symbol") if c in rows.columns]
    if not spelt:
        raise ValueError("no Symbol or symbol column")
    # by place: names that differ in case only are one name to the analyzer
    places = {f"_s{spelt.index(c)}": i for i, c in enumerate(rows.columns) if c in spelt}
    renamed = rows.toDF(*[f"_s{spelt.index(c)}" if c in spelt else c for c in rows.columns])
    named = F.coalesce(*[F.when(F.col(s) != "", F.col(s)) for s in sorted(places)])
    ticker = F.translate(F.trim(named), ".", "-")
    return renamed.withColumn("ticker", ticker).drop(*places).filter("ticker <> ''")


def load_constituents(spark: SparkSession, path: str) -> DataFrame:
    return constituents(spark.read.option("header", True).csv(path))


def load_jsonl(spark: SparkSession, path: str, schema, required: str) -> DataFrame:
    """JSON lines; malformed lines and rows without the required key are skipped.

    A line is judged whole, whatever columns are asked for later. ``line`` orders the lines as reading the
    files one by one in order of their paths would: it is (path, start of the split, place in the split).
    """
    broken = "_corrupt_record"
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    parsed = F.from_json(
        "value", T.StructType([*schema.fields, T.StructField(broken, T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken},
    )
    # the id grows within a split, whatever splits a task reads; across splits the file's own facts decide
    line = F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )
    lines = spark.read.text(path).select("value", line.alias("line"))
    read = lines.select("line", parsed.alias("r")).filter(
        F.col(f"r.{broken}").isNull() & F.col(f"r.{required}").isNotNull()
    )
    return read.select(*[F.col(f"r.`{f.name}`") for f in schema.fields], "line")


def daily_funding(ticks: DataFrame) -> DataFrame:
    """Epoch-millisecond funding ticks to a daily sum per coin."""
    day = F.to_date(F.timestamp_millis("epoch_ms"))
    return ticks.groupBy("coin", day.alias("d")).agg(F.sum("rate").alias("rate"))


SIDES = {"02": "BUY", "01": "SELL"}  # Fixed values: broker side codes.


def _side(code: Column) -> Column:
    known = F.coalesce(*[F.when(code == c, F.lit(s)) for c, s in SIDES.items()])
    return F.coalesce(known, code)


def overseas_fills(pages: DataFrame, body: str = "body") -> DataFrame:
    rows = pages.select(F.explode(F.from_json(body, schemas.OVERSEAS_FILLS)["output"]).alias("f"))
    return rows.select(
        F.col("f.odno").alias("order_id"),
        F.col("f.pdno").alias("ticker"),
        F.lit("NASDAQ").alias("market"),
        F.lit("USD").alias("currency"),
        _side(F.col("f.sll_buy_dvsn_cd")).alias("side"),
        F.coalesce(F.col("f.ft_ccld_qty").try_cast("long"), F.lit(0)).cast("long").alias("qty"),
        lenient_double("f.ft_ccld_unpr3").alias("price"),
        F.lit(0.0).alias("commission"),
    ).filter("qty > 0")


def domestic_fills(pages: DataFrame, body: str = "body") -> DataFrame:
    rows = pages.select(F.explode(F.from_json(body, schemas.DOMESTIC_FILLS)["output1"]).alias("f"))
    qty = F.coalesce(F.col("f.tot_ccld_qty").try_cast("long"), F.lit(0)).cast("long")
    average = F.col("f.avg_prvs")
    given = average.isNotNull() & ~average.isin("", "0", "-")
    return rows.select(
        F.col("f.odno").alias("order_id"),
        F.col("f.pdno").alias("ticker"),
        F.lit("KOSPI").alias("market"),
        F.lit("KRW").alias("currency"),
        _side(F.col("f.sll_buy_dvsn_cd")).alias("side"),
        qty.alias("qty"),
        F.when(given, lenient_double(average)).otherwise(
            F.try_divide(lenient_double("f.tot_ccld_amt"), qty.cast("double"))
        ).alias("price"),
        F.lit(0.0).alias("commission"),
    ).filter("qty > 0")


def account_snapshots(accounts: DataFrame, domestic: str = "domestic", overseas: str = "overseas") -> tuple[DataFrame, DataFrame]:
    """(cash, positions) from one domestic and one overseas balance body per ``account``."""
    parsed = accounts.select(
        "account",
        F.from_json(domestic, schemas.DOMESTIC_BALANCE).alias("dom"),
        F.from_json(overseas, schemas.OVERSEAS_BALANCE).alias("ovr"),
    )
    s = F.get("dom.output2", F.lit(0))
    filled = lambda name: F.nullif(s[name], F.lit(""))
    raw_cash = lenient_double(F.coalesce(filled("prvs_rcdl_excc_amt"), filled("nxdy_excc_amt"), s["dnca_tot_amt"]))
    bought = lenient_double(F.col("ovr.output2.frcr_pchs_amt1"))
    cash = parsed.select(
        "account",
        F.greatest(F.lit(0.0), raw_cash - bought).alias("cash_krw"),
        lenient_double(s["nass_amt"]).alias("nass_krw"),
        bought.alias("ovr_purchase_krw"),
    )

    def held(market: str, rows: str, ticker: str, qty: str, price: str) -> DataFrame:
        each = parsed.select("account", F.explode(rows).alias("p"))
        return each.select(
            "account",
            F.lit(market).alias("market"),
            F.trim(F.col(f"p.{ticker}")).alias("ticker"),
            lenient_long(f"p.{qty}").alias("qty"),
            lenient_double(f"p.{price}").alias("mark"),
        ).filter("ticker <> '' AND qty <> 0")

    positions = held("KOSPI", "dom.output1", "pdno", "hldg_qty", "prpr").unionByName(
        held("NASDAQ", "ovr.output1", "ovrs_pdno", "ovrs_cblc_qty", "now_pric2")
    )
    return cash, positions
