"""Append-only logs, universe and membership tables, manifests, gated updates, ingest state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barquet.operators.scan import SYMBOL
from barquet.sources.bars import STORED, dated, stored_bars

STALE_DAYS = 5


SALTS = 64


def new_rows(log: DataFrame, rows: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows whose key the log does not hold yet, one per key: appending them twice is a no-op.

    Of several rows of one key the first by ``order`` comes in; without an order any one of them.
    """
    fresh = rows.join(log.select(*key).distinct(), list(key), "left_anti")
    if order is None:
        return fresh.dropDuplicates(list(key))
    rest = [c for c in rows.columns if c not in key]
    first = fresh.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("w"))
    return first.select(*key, "w.*").select(*rows.columns)


def first_n(df: DataFrame, n: int, group: Sequence[str], order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """The first n rows of each group, in two steps: of every salted part, then of what these keep.

    The final rank sees at most ``SALTS`` * n rows of a group. A row's salt is a hash of its values, so it is
    the same when a task runs again; salts steer balance only.
    """
    group = list(group)
    values = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*values), F.lit(SALTS)))
    part = W.partitionBy(*group, "_salt").orderBy(*order)
    some = salted.withColumn("_part", F.row_number().over(part)).filter(F.col("_part") <= n).drop("_salt", "_part")
    w = W.partitionBy(*group).orderBy(*order)
    return some.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def universe(listing: DataFrame, us: int = 503, kr: int = 200, order: str = "seq") -> DataFrame:
    """First ``us`` NASDAQ and first ``kr`` KOSPI names, tagged with their market."""
    pick = lambda market, n: first_n(listing.filter(F.col("market") == market), n, ["market"], [order])
    return pick("NASDAQ", us).unionByName(pick("KOSPI", kr))


def size_bucket(
    listing: DataFrame, bars: DataFrame, lower: int = 100, upper: int = 500, min_amount: float = 1e9, top: int = 250,
    min_bars: int = 252,
) -> DataFrame:
    """Names ranked ``lower``..``upper`` by market cap, liquid, the first ``top`` of them, with enough priced bars."""
    ranked = first_n(listing.filter("cap IS NOT NULL"), upper, [], [F.col("cap").desc(), "ticker"], "cap_rank")
    bucket = ranked.filter((F.col("cap_rank") > lower) & (F.col("amount") > min_amount))
    picked = first_n(bucket, top, [], ["cap_rank"], "pick")
    lengths = (
        bars.groupBy("ticker")
        .agg(F.count(F.lit(1)).alias("raw"), F.count_if((F.col("open") > 0) & (F.col("close") > 0)).alias("n_bars"))
        .filter((F.col("raw") >= min_bars) & (F.col("n_bars") >= min_bars))
    )
    return picked.join(lengths.select("ticker", "n_bars"), "ticker")


def membership(log: DataFrame) -> DataFrame:
    """Membership log to point-in-time rows, with currency and source symbol."""
    kr = F.col("s.market") == "KOSPI"
    return log.select("as_of_date", "universe_id", F.explode("symbols").alias("s")).select(
        "as_of_date",
        "universe_id",
        F.col("s.market").alias("market"),
        F.col("s.ticker").alias("ticker"),
        F.when(kr, "KRW").otherwise("USD").alias("currency"),
        F.when(kr, F.concat("s.ticker", F.lit(".KS"))).otherwise(F.col("s.ticker")).alias("source_symbol"),
    )


def members_as_of(bars: DataFrame, members: DataFrame) -> DataFrame:
    """Bars of the symbols in the latest membership on or before each date.

    Snapshots are few: each covers the dates up to the next one, so every date maps to one snapshot
    and the rest is an equi-join.
    """
    from barquet.operators.pit import as_of_series

    snaps = members.select(F.col("as_of_date").alias("d")).distinct().withColumn("v", F.col("d"))
    dates = as_of_series(bars.select("d").distinct(), snaps).filter("v IS NOT NULL")
    return (
        bars.join(dates.withColumnRenamed("v", "as_of_date"), "d")
        .join(members.select("as_of_date", *SYMBOL).distinct(), ["as_of_date", *SYMBOL], "left_semi")
    )


def appendable(existing: DataFrame, fetched: DataFrame, today, seq: str) -> DataFrame:
    """Finished bars newer than everything stored for their symbol; of one date the first by ``seq``."""
    keys = list(SYMBOL)
    newest = existing.groupBy(*keys).agg(F.max("d").alias("_max"))
    cut = F.lit(today).cast("date") if not isinstance(today, Column) else today
    fresh = (
        fetched.filter(F.col("d") < cut)
        .join(newest, keys, "left")
        .filter(F.col("_max").isNull() | (F.col("d") > F.col("_max")))
        .drop("_max")
    )
    rest = [c for c in fresh.columns if c not in (*keys, "d")]
    return fresh.groupBy(*keys, "d").agg(F.min_by(F.struct(*rest), F.col(seq)).alias("w")).select(*keys, "d", "w.*")


def append_bars(existing: DataFrame, fetched: DataFrame, today, seq: str) -> DataFrame:
    fresh = appendable(existing, fetched, today, seq)
    return existing.unionByName(fresh.select(*existing.columns))


def append_summary(fresh: DataFrame) -> DataFrame:
    """Symbols updated and bars appended per market."""
    each = fresh.groupBy(*SYMBOL).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("market").agg(
        F.count(F.lit(1)).alias("symbols_updated"), F.sum("n").alias("bars_appended")
    )


def canonical_row() -> Column:
    price = lambda c: F.round(c, 8).cast("decimal(24,8)").cast("string")
    return F.concat_ws(
        "|", "market", "ticker", F.date_format("d", "yyyy-MM-dd"), *[price(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("string"),
    )


def content_hashes(bars: DataFrame, keys: Sequence[str] = ("market",)) -> DataFrame:
    """Order-insensitive content hash: number of rows and two sums of halves of their digests, hashed.

    Sums are partial aggregates, so no group is gathered anywhere; a row that changes, comes or goes
    changes the sums.
    """
    row = F.md5(canonical_row())

    def half(start: int) -> Column:
        return F.sum(F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")

    totals = bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), half(1).alias("_a"), half(17).alias("_b"))
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in ("_n", "_a", "_b")])
    return totals.select(*keys, F.sha2(text, 256).alias("content_hash"))


def manifest(bars: DataFrame, provider: str = "research", adjustment: str = "adjusted") -> DataFrame:
    """One row per market: symbols, span, sizes, hash, how it was made.

    The list holds each symbol's name once, whatever the number of its bars; ``manifest_symbols`` has
    the symbols as rows.
    """
    each = manifest_symbols(bars).groupBy("market").agg(
        F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"), F.sum("n_bars").alias("n_bars"),
        F.sort_array(F.collect_list("ticker")).alias("symbols"), F.count(F.lit(1)).alias("n_symbols"),
    )
    return (
        each.join(content_hashes(bars), "market")
        .withColumn("provider", F.lit(provider))
        .withColumn("adjustment", F.lit(adjustment))
    )


def manifest_symbols(bars: DataFrame) -> DataFrame:
    """One row per market and symbol."""
    return bars.groupBy(*SYMBOL).agg(
        F.min("d").alias("start_date"), F.max("d").alias("end_date"), F.count(F.lit(1)).alias("n_bars")
    )


def verify(stored: DataFrame, bars: DataFrame) -> DataFrame:
    """Whether bars still match the hash in their manifest."""
    now = content_hashes(bars).withColumnRenamed("content_hash", "_now")
    return stored.select("market", "content_hash").join(now, "market", "left").select(
        "market", F.coalesce(F.col("content_hash") == F.col("_now"), F.lit(False)).alias("verified")
    )


def gated_update(prior: DataFrame, fetched: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars to serve, status per symbol) for a fetch that must pass quality.

    pass: the new bars replace the old; fail with old bars: keep them, ``quality_fail_transient``;
    fail without: quarantine, ``quality_fail``. ``verdicts(market, ticker, passed)``.
    """
    keys = list(SYMBOL)
    had = prior.select(*keys).distinct().withColumn("had", F.lit(True))
    status = verdicts.join(had, keys, "left").select(
        *keys,
        F.when(F.col("passed"), "ok").when(F.col("had"), "quality_fail_transient").otherwise("quality_fail").alias("status"),
    )
    good = fetched.join(status.filter("status = 'ok'"), keys, "left_semi")
    kept = prior.join(status.filter("status = 'ok'"), keys, "left_anti")
    return kept.unionByName(good.select(*kept.columns)), status


def _path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a job has written ``path`` to its end."""
    place, files = _path(spark, f"{path}/_SUCCESS")
    return files.exists(place)


def store_update(spark: SparkSession, path: str, fetched: DataFrame, verdicts: DataFrame, update: str) -> DataFrame:
    """Bring a gated update into the bars stored below ``path`` (as by ``save_bars``); the status per symbol.

    First the new content of the touched partitions (market and year of what changes) is written below
    ``path/_updates/<update>``; its completion is the commit. Then it overwrites those partitions, the
    others keep their files, and partitions left without bars go. Whenever a run dies, calling again with
    the same ``update`` gives the same table: before the commit nothing stored has changed, after it the
    second step is repeated from what was written. Let one update end before the next begins.
    """
    place = f"{path}/_updates/{update}"
    keys = [*SYMBOL]
    parts = ["market", "year"]
    if not _complete(spark, f"{place}/touched"):
        stored = stored_bars(spark, path)
        coming = dated(fetched).select(*stored.columns)
        _, status = gated_update(stored, coming, verdicts)
        status.write.mode("overwrite").parquet(f"{place}/status")
        status = spark.read.schema(status.schema).parquet(f"{place}/status")
        passed = status.filter("status = 'ok'").select(*keys)
        new = coming.join(passed, keys, "left_semi")
        gone = stored.join(passed, keys, "left_semi")
        touched = new.select(*parts).unionByName(gone.select(*parts)).distinct()
        kept = stored.join(touched, parts, "left_semi").join(passed, keys, "left_anti")
        rows = kept.select(*stored.columns).unionByName(new.select(*stored.columns))
        rows.hint("rebalance", *parts).write.mode("overwrite").partitionBy(*parts).parquet(f"{place}/bars")
        left = rows.select(*parts).distinct().withColumn("left", F.lit(True))
        # one row per market and year
        touched.join(left, parts, "left").write.mode("overwrite").parquet(f"{place}/touched")
    rows = spark.read.schema(STORED).parquet(f"{place}/bars")
    rows.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    for r in spark.read.parquet(f"{place}/touched").filter("left IS NULL").toLocalIterator():
        folder, files = _path(spark, f"{path}/market={r['market']}/year={r['year']}")
        files.delete(folder, True)
    return spark.read.parquet(f"{place}/status")


def ingest_class(now: Column, stale_days: int = STALE_DAYS) -> Column:
    """done / pending / cooldown / error / quality_fail of one symbol's state."""
    cooling = F.col("cooldown_until").isNotNull() & (F.col("cooldown_until") > now)
    fresh = F.col("last_success").isNotNull() & (F.col("last_success") >= now - F.expr(f"INTERVAL {stale_days} DAYS"))
    status = F.coalesce("status", F.lit("pending"))
    return (
        F.when(cooling, "cooldown")
        .when(status == "ok", F.when(fresh, "done").otherwise("pending"))
        .when(status == "error", "error")
        .when(status == "quality_fail", "quality_fail")
        .otherwise("pending")
    )


def backlog(names: DataFrame, state: DataFrame, now: Column, per_run: int, stale_days: int = STALE_DAYS) -> DataFrame:
    """The first ``per_run`` names that need work, in universe order (column ``seq``)."""
    joined = names.join(state, list(SYMBOL), "left")
    status = F.coalesce("status", F.lit("pending"))
    cooling = F.coalesce(F.col("cooldown_until") > now, F.lit(False))
    stale = F.col("last_success") < now - F.expr(f"INTERVAL {stale_days} DAYS")
    due = (
        (status == "pending")
        | F.col("last_success").isNull()
        | ((status == "ok") & stale)
        | status.isin("error", "cooldown", "quality_fail_transient")
    )
    eligible = joined.filter(~cooling & (status != "quality_fail") & F.coalesce(due, F.lit(False)))
    return first_n(eligible, per_run, [], ["seq"]).select(*SYMBOL, "seq", "rank")


def progress(names: DataFrame, state: DataFrame, now: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """Counts by class, one row."""
    classed = names.join(state, list(SYMBOL), "left").withColumn("class", ingest_class(now, stale_days))
    return classed.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("class") == c).alias(c) for c in ("done", "pending", "cooldown", "error", "quality_fail")],
    )


def fundamental_inputs(filings: DataFrame) -> DataFrame:
    """Latest equity and shares and the sum of the four latest net incomes (NULLs in them count 0)."""
    w = W.partitionBy(*SYMBOL).orderBy(F.col("period_end").desc(), F.col("filed").desc())
    last4 = filings.filter("concept = 'ni'").withColumn("_rn", F.row_number().over(w)).filter("_rn <= 4")
    income = last4.groupBy(*SYMBOL).agg(F.coalesce(F.sum("val"), F.lit(0.0)).alias("ttm_net_income"))
    order = F.struct("period_end", "filed")
    heads = filings.filter("concept IN ('equity', 'shares')").groupBy(*SYMBOL).agg(
        F.max_by(F.when(F.col("concept") == "equity", F.col("val")), F.when(F.col("concept") == "equity", order)).alias("equity"),
        F.max_by(F.when(F.col("concept") == "shares", F.col("val")), F.when(F.col("concept") == "shares", order)).alias("shares"),
    )
    return income.join(heads, list(SYMBOL)).filter("coalesce(equity, 0) <> 0 AND coalesce(shares, 0) <> 0")
