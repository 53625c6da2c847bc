"""Reconciliation, idempotency, heartbeats, decision journal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.functions.columns import canonical_hash, sorted_map
from barquet.operators.scan import SYMBOL, framed


def reconcile_orders(submitted: DataFrame, fills: DataFrame) -> DataFrame:
    """Ordered against filled quantity per order id; partial fills add up before the join."""
    filled = fills.groupBy("order_id").agg(F.sum("qty").alias("_f"))
    f, o = F.coalesce("_f", F.lit(0)), F.col("qty")
    return submitted.join(filled, "order_id", "left").select(
        "order_id",
        o.alias("ordered"),
        f.alias("filled"),
        F.when(f == o, "OK").when(f == 0, "UNFILLED").when(f < o, "PARTIAL").otherwise("OVERFILLED").alias("status"),
        F.when(f == o, "OK").when(f <= o, "WARN").otherwise("CRITICAL").alias("severity"),
    )


def reconcile_positions(expected: DataFrame, reported: DataFrame, keys: Sequence[str], ignore_zero: bool = True) -> DataFrame:
    """Symbols whose two quantities differ; every drift is critical."""
    e = expected.select(*keys, F.col("qty").alias("expected"))
    b = reported.select(*keys, F.col("qty").alias("reported"))
    zero = F.lit(0).cast("long")
    both = e.join(b, list(keys), "full_outer").select(
        *keys, F.coalesce("expected", zero).alias("expected"), F.coalesce("reported", zero).alias("reported")
    )
    if ignore_zero:
        both = both.filter("NOT (expected = 0 AND reported = 0)")
    return both.filter("expected <> reported").withColumn("drift", F.col("reported") - F.col("expected"))


def unconfirmed(submitted: DataFrame, confirmed: DataFrame, key: str = "order_id") -> DataFrame:
    return submitted.join(confirmed.select(key), key, "left_anti")


def route_fills(fills: DataFrame, order_sleeve: DataFrame) -> DataFrame:
    """Fills with the sleeve that placed the order; others drop out."""
    return fills.join(order_sleeve, "order_id")


def free_slots(requests: DataFrame, ledger: DataFrame, keys: Sequence[str] = ("account", "d", *SYMBOL)) -> DataFrame:
    """Requests that may take their run slot: one per key, none that the ledger already holds."""
    keys = list(keys)
    return requests.select(*keys).distinct().join(ledger.select(*keys), keys, "left_anti")


def already_submitted(requests: DataFrame, track: DataFrame, keys: Sequence[str] = ("market", "d")) -> DataFrame:
    """Requests for which a live row with an order number exists."""
    done = track.filter("live AND submitted_odno IS NOT NULL AND submitted_odno <> ''")
    return requests.join(done.select(*keys), list(keys), "left_semi")


def stale_jobs(expected: DataFrame, heartbeats: DataFrame, now: Column) -> DataFrame:
    """Jobs never recorded, with an unreadable time, or older than their limit. ``last`` is text."""
    parsed = F.try_to_timestamp("last")
    age = (F.unix_micros(now) - F.unix_micros(parsed)) / 3.6e9
    reason = (
        F.when(F.col("last").isNull(), "never recorded")
        .when(parsed.isNull(), "unparseable timestamp")
        .when(age > F.col("max_age_hours"), "stale")
    )
    return (
        expected.join(heartbeats, "component", "left")
        .withColumn("reason", reason)
        .filter("reason IS NOT NULL")
        .select("component", F.when(F.col("reason") == "stale", F.round(age, 1)).alias("age_hours"), "max_age_hours", "reason")
    )


def outcomes(decisions: DataFrame, bars: DataFrame, horizons: Sequence[int] = (1, 5, 20), order: str = "d") -> DataFrame:
    """Returns n bars after each decision on the symbol's own bars, and whether the score had their sign."""

    def build(df: DataFrame, f) -> DataFrame:
        return df.select("*", *[f.lead("close", n).alias(f"_c{n}") for n in horizons])

    ahead = framed(bars.select(*SYMBOL, order, "close"), build, order=(order,), ahead=max(horizons))
    newest = bars.groupBy(*SYMBOL).agg(F.max(order).alias("max_bar"))
    joined = decisions.join(ahead.drop("close", "pos"), [*SYMBOL, order], "left").join(newest, list(SYMBOL), "left")
    columns = []
    for n in horizons:
        move = F.try_divide(F.col(f"_c{n}"), F.nullif(F.col("decision_price"), F.lit(0.0))) - 1.0
        agree = (F.col("combined_score") > 0) == (move > 0)
        columns += [
            move.alias(f"fwd_return_{n}"),
            F.when((F.col("combined_score") != 0) & (move != 0), agree).alias(f"hit_{n}"),
        ]
    return joined.select(*decisions.columns, "max_bar", *columns)


def source_hit_rates(reconciled: DataFrame, horizon: int = 5) -> DataFrame:
    """Mean hit per source key; decisions without a verdict drop out."""
    each = reconciled.filter(F.col(f"hit_{horizon}").isNotNull()).select(
        F.explode(F.map_keys("source_scores")).alias("source"), F.col(f"hit_{horizon}").cast("int").alias("hit")
    )
    return each.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("hit_rate"))


def decision_records(
    signals: DataFrame, scores: DataFrame, orders: DataFrame, engine: str, run_id: str, order: str = "ts",
    stamp: str = "yyyy-MM-dd HH:mm",
) -> DataFrame:
    """One record per symbol and bar: score maps, combined score, action and quantity of its first order.

    ``scores(market, ticker, order, close, combined, weight)``; ``orders(..., seq, side, quantity)``.
    """
    keys = [*SYMBOL, order]

    def as_map(value: str, name: str) -> Column:
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", value)))).alias(name)

    maps = signals.groupBy(*keys).agg(
        as_map("score", "source_scores"), as_map("confidence", "source_confidences"), as_map("horizon", "source_horizons")
    )
    first = orders.groupBy(*keys).agg(F.min_by(F.struct("side", "quantity"), "seq").alias("_o"))
    text = F.date_format(F.col(order), stamp)
    return (
        scores.join(maps, keys, "left").join(first, keys, "left")
        .select(
            F.lit(engine).alias("engine"),
            F.lit(run_id).alias("run_id"),
            *keys,
            F.concat_ws(":", F.lit(engine), "market", "ticker", text).alias("key"),
            "close",
            F.col("close").alias("decision_price"),
            "source_scores",
            "source_confidences",
            "source_horizons",
            F.col("combined").alias("combined_score"),
            F.col("weight").alias("target_weight"),
            F.coalesce("_o.side", F.lit("HOLD")).alias("action"),
            F.coalesce("_o.quantity", F.lit(0)).cast("long").alias("qty"),
        )
    )


def decision_hash(records: DataFrame, leave_out: Sequence[str] = ("run_id", "outcome", "hash", "seq")) -> DataFrame:
    """Content hash of each record without the run id and the outcome."""
    kept = [c for c in records.columns if c not in leave_out]
    ordered = records
    for name, kind in records.dtypes:
        if kind.startswith("map<"):
            ordered = ordered.withColumn(name, sorted_map(name))
    return ordered.withColumn("hash", canonical_hash(kept))


def journal_upsert(journal: DataFrame, records: DataFrame, seq: str = "seq") -> DataFrame:
    """Verdict per record, as if the records came one by one in the order of ``seq``.

    append (new key), skip (the key's hash is already there) or conflict (the key has another hash).
    A key's first record decides what later ones of the batch are compared with. A journal that
    holds two hashes for a key counts with the smaller one.
    """
    known = journal.groupBy("key").agg(F.min("hash").alias("_known"))
    first = records.groupBy("key").agg(F.min_by("hash", seq).alias("_first"), F.min(seq).alias("_at"))
    against = F.coalesce("_known", "_first")
    return records.join(first, "key").join(known, "key", "left").withColumn(
        "verdict",
        F.when(F.col("_known").isNull() & (F.col(seq) == F.col("_at")), "append")
        .when(against == F.col("hash"), "skip")
        .otherwise("conflict"),
    ).drop("_known", "_first", "_at")


def next_open_fills(orders: DataFrame, bars: DataFrame, order: str = "ts") -> DataFrame:
    """Each order fills at the open of its symbol's next bar; without one it does not fill."""

    def build(df: DataFrame, f) -> DataFrame:
        return df.withColumn("fill_price", f.lead("open")).withColumn("fill_time", f.lead(order))

    nexts = framed(bars.select(*SYMBOL, order, "open"), build, order=(order,), ahead=1).drop("pos", "open")
    return orders.join(nexts, [*SYMBOL, order]).filter("fill_price IS NOT NULL")


def trial_counts(log: DataFrame) -> DataFrame:
    """Trials per kind and strategy, the best score expected from noise, and the warning tier."""
    n = F.col("trials")
    return log.groupBy("kind", "strategy").agg(F.count(F.lit(1)).alias("trials")).select(
        "kind",
        "strategy",
        "trials",
        F.when(n > 1, F.sqrt(2.0 * F.ln(n))).otherwise(0.0).alias("expected_best"),
        F.when(n <= 0, "none").when(n == 1, "single").when(n < 5, "early").when(n < 10, "caution").otherwise("strong").alias("tier"),
    )


def benchmark_return(bars: DataFrame, since: str, base_fx: float | None = None, latest_fx: float | None = None, order: str = "d") -> DataFrame:
    """Latest close over the first close on or after ``since``, optionally in KRW at both ends."""
    late = F.col(order) >= F.lit(since).cast("date")
    ends = bars.groupBy(*SYMBOL).agg(
        F.min_by(F.when(late, F.col("close")), F.when(late, F.col(order))).alias("base"),
        F.max_by("close", order).alias("latest"),
    )
    scale = 1.0 if base_fx is None or latest_fx is None else latest_fx / base_fx
    return ends.filter("base <> 0").select(*SYMBOL, (F.col("latest") * scale / F.col("base") - 1.0).alias("ret"))
