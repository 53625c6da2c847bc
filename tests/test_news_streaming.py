import datetime as dt

import pytest
from helpers import day
from pyspark.sql import functions as F

from barquet.functions import indicators as ind
from barquet.functions.columns import keyword_sentiment
from barquet.operators import news as nw
from barquet.streaming import bars as st
from barquet.streaming import state
from barquet.streaming.run import drain_to_table, read_table

T = lambda d, h=0, m=0: dt.datetime(2026, 1, d, h, m)
ITEM = "market string, ticker string, provider string, id string, title string, published_at timestamp"


def items(spark, rows):
    return nw.scored_once(spark.createDataFrame([("M", "X", "p", str(i), t, at) for i, (t, at) in enumerate(rows)], ITEM))


def bars(spark, times):
    return spark.createDataFrame([("M", "X", t) for t in times], "market string, ticker string, ts timestamp")


def test_keywords(spark):
    rows = [("X BEATS estimates", 0.7), ("shares plunge", -0.7), ("record probe", 0.7), ("nothing", 0.0)]
    df = spark.createDataFrame(rows, "t string, want double").withColumn("s", keyword_sentiment(F.col("t")))
    assert all(r["s"]["score"] == r["want"] for r in df.collect())


def test_future_items_are_ignored_and_no_items_no_signal(spark):
    data = items(spark, [("beats", T(9)), ("plunge", T(11))])
    got = nw.news_signal(data, bars(spark, [T(10), T(8)])).collect()
    assert len(got) == 1 and got[0]["ts"] == T(10) and got[0]["score"] == pytest.approx(1 * 0.7)


def test_window_equals_brute_force(spark):
    rows = [(("beats", "plunge", "quiet")[i % 3], T(1) + dt.timedelta(hours=17 * i)) for i in range(30)]
    times = [T(1) + dt.timedelta(hours=5 * k) for k in range(120)]
    got = {r["ts"]: r for r in nw.news_signal(items(spark, rows), bars(spark, times)).collect()}
    scores = {"beats": (0.7, 0.7), "plunge": (-0.7, 0.7), "quiet": (0.0, 0.2)}
    for t in times:
        near = [(*scores[w], 0.5 ** ((t - at).total_seconds() / 86400 / 3)) for w, at in rows if t - dt.timedelta(days=7) <= at <= t]
        if not near:
            assert t not in got
            continue
        den = sum(c * w for _, c, w in near)
        assert got[t]["score"] == pytest.approx(sum(s * c * w for s, c, w in near) / den)
        assert got[t]["confidence"] == pytest.approx(max(c * w for _, c, w in near))
        assert got[t]["features"]["n_items"] == len(near)


CLOSES = [1, 2, 3, 4, 5, 6, 5, 4, 5, 6, 7, 8]


def bar_rows(lo, hi):
    return [("M", t, T(1) + dt.timedelta(days=i), CLOSES[i % 12] * f, CLOSES[i % 12] * f + 0.5, CLOSES[i % 12] * f - 0.5, CLOSES[i % 12] * f)
            for t, f in (("A", 1.0), ("B", 3.0)) for i in range(lo, hi)]


BARS = "market string, ticker string, ts timestamp, open double, high double, low double, close double"


def test_stream_goes_on_after_a_restart_and_equals_batch(spark, tmp_path):
    source, out, memory = (str(tmp_path / n) for n in ("in", "out", "state"))
    every = spark.createDataFrame(bar_rows(0, 24), BARS)
    spark.createDataFrame(bar_rows(0, 9), BARS).write.parquet(source)
    drain_to_table(state.ranges(read_table(spark, source), period=3), "r", out, memory)
    late = bar_rows(4, 6)
    spark.createDataFrame(bar_rows(9, 24) + late, BARS).write.mode("append").parquet(source)
    got = drain_to_table(state.ranges(read_table(spark, source), period=3), "r", out, memory)
    want = ind.average_true_range(every, 3)
    both = got.withColumnRenamed("atr", "live").join(want, ["market", "ticker", "ts"], "full_outer").collect()
    assert len(both) == 48
    assert all((r["live"] is None) == (r["atr"] is None) and (r["atr"] is None or abs(r["live"] - r["atr"]) < 1e-12) for r in both)


def test_only_closed_windows_are_emitted(spark, tmp_path):
    ticks = [("M", "A", T(1, 9, 10), 1, 5.0), ("M", "A", T(1, 9, 50), 2, 4.0), ("M", "A", T(1, 9, 30), 3, 9.0), ("M", "A", T(1, 10, 30), 4, 7.0)]
    spark.createDataFrame(ticks, "market string, ticker string, ts timestamp, event_id long, px double").write.parquet(str(tmp_path / "t"))
    got = drain_to_table(st.closed_bars(read_table(spark, str(tmp_path / "t"))), "b", str(tmp_path / "o"), str(tmp_path / "c")).collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in got] == [(5.0, 9.0, 4.0, 4.0, 3)]


FILLS = "order_id string, qty long, ts timestamp"


def test_duplicate_fills_and_finished_bars(spark, tmp_path):
    orders = spark.createDataFrame([("o1", "S")], "order_id string, sleeve string")
    got = None
    # the earlier fill of o1 arrives in a later batch; a fill after the horizon is a new session
    for batch in ([("o1", 7, T(1, 1)), ("o2", 1, T(1))], [("o1", 5, T(1)), ("o2", 9, T(1, 2))], [("o1", 3, T(9)), ("x", 0, T(20))]):
        spark.createDataFrame(batch, FILLS).write.mode("append").parquet(str(tmp_path / "f"))
        stream = st.first_fills(read_table(spark, str(tmp_path / "f")), orders, "1 day", "12 hours", order=("ts", "qty"))
        got = drain_to_table(stream, "f", str(tmp_path / "fo"), str(tmp_path / "fc"))
    assert sorted((r["order_id"], r["qty"], r["ts"], r["sleeve"]) for r in got.collect()) == [
        ("o1", 3, T(9), "S"), ("o1", 5, T(1), "S"), ("o2", 1, T(1), None)]
    schema = "market string, ticker string, d date, close double"
    start = spark.createDataFrame([("M", "A", day(0), 1.0), ("M", "A", day(1), 1.0)], schema)
    rows = [("M", "A", day(i), 2.0, i) for i in range(6)] + [("M", "A", day(3), 1.5, 9)]  # the later arrival loses
    spark.createDataFrame(rows, schema + ", seq int").write.parquet(str(tmp_path / "d"))
    done = st.append_finished(spark, read_table(spark, str(tmp_path / "d")), start, day(4)).orderBy("d").collect()
    assert [(r["d"], r["close"]) for r in done] == [(day(0), 1.0), (day(1), 1.0), (day(2), 2.0), (day(3), 2.0)]


def test_jumps_across_batches(spark, tmp_path):
    rows = [("M", "A", T(1), 10.0), ("M", "A", T(2), 16.0), ("M", "A", T(3), 17.0)]
    spark.createDataFrame(rows, "market string, ticker string, ts timestamp, close double").write.parquet(str(tmp_path / "j"))
    got = drain_to_table(state.jumps(read_table(spark, str(tmp_path / "j"))), "j", str(tmp_path / "o"), str(tmp_path / "c")).collect()
    assert [(r["ts"], round(r["move"], 6)) for r in got] == [(T(2), 0.6)]


def test_quality_stream_takes_prices_of_zero(spark, tmp_path):
    """Hours with values of 0, among them a close before another bar, against the SQL."""
    import duckdb
    from barquet.plans.catalog import ORACLES, QUERIES

    values = [(i * 7919) % 5 * 10.0 for i in range(60)]
    events = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=25 * i), 1, "view", v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    frame.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["str7_streaming_quality"](spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = db.execute(ORACLES["str7_streaming_quality"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(r["move"] == float("inf") for r in got)


def test_one_step_serves_table_and_stream(spark, tmp_path):
    """All indicators and the combined score over five arrivals, one of late bars: as on the whole table."""
    every = bar_rows(0, 95)
    names = list(ind.INDICATORS)
    (short, one), (long, two) = ind.indicator_columns(names), ind.combined_columns()
    source, run = str(tmp_path / "in"), None
    for lo, hi in ((0, 5), (5, 40), (20, 25), (40, 41), (41, 95)):
        spark.createDataFrame(every[lo:hi] + every[95 + lo : 95 + hi], BARS).write.mode("append").parquet(source)
        run = run or state.framed_stream(read_table(spark, source), (max(short, long), lambda df, f: two(one(df, f), f)))
        got = run()
    assert got.count() == 190
    table = spark.createDataFrame(every, BARS)
    for live, batch in ((ind.signal_rows(got), ind.indicator_signals(table)), (ind.combined_rows(got), ind.combined_technical(table))):
        live, batch = ({(r["source"], r["ticker"], r["ts"]): (r["score"], r["confidence"]) for r in x.collect()} for x in (live, batch))
        assert set(live) == set(batch) and len(live) > 80
        assert all(live[k] == pytest.approx(batch[k], abs=1e-9) for k in live)


def test_news_of_later_files_counts_and_state_is_dropped(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("bars", "news", "out", "state")]
    stories = [("beats", T(1)), ("plunge", T(3)), ("record", T(4, 2)), ("beats", T(11)), ("falls", T(12, 5))]
    scored = items(spark, stories).select("market", "ticker", "published_at", "score", "confidence")
    hours = [T(1, 6), T(4), T(4, 3), T(10), T(11, 1), T(13)]
    got = None
    # news of the 4th arrives a batch after the bars of that day; the last row of each only moves the watermark
    for b, n in ((hours[:3], (T(1), T(3, 1))), (hours[3:5], (T(3, 1), T(11, 1))), (hours[5:], (T(11, 1), T(13))), ([T(28)], None)):
        spark.createDataFrame([("M", "X" if t < T(28) else "-", t) for t in b], "market string, ticker string, ts timestamp").write.mode("append").parquet(paths[0])
        near = scored.filter((F.col("published_at") >= n[0]) & (F.col("published_at") < n[1])) if n else scored.limit(1).withColumn("ticker", F.lit("-")).withColumn("published_at", F.lit(T(28)))
        near.write.mode("append").parquet(paths[1])
        schema = "market string, ticker string, ts timestamp"
        stream = st.news_signals(read_table(spark, paths[0], schema), read_table(spark, paths[1], scored.schema))
        got = drain_to_table(stream, "n", paths[2], paths[3])
    want = {r["ts"]: r for r in nw.news_signal(items(spark, stories), bars(spark, hours)).collect()}
    live = {r["ts"]: r for r in got.collect()}
    assert set(live) == set(want) == set(hours)
    for t, r in live.items():
        assert (r["score"], r["confidence"], r["n_items"]) == (pytest.approx(want[t]["score"]), pytest.approx(want[t]["confidence"]), want[t]["features"]["n_items"])
    # both sides of the join are empty again but for the closing rows
    left = spark.read.format("statestore").option("operatorId", 1).option("joinSide", "left").load(paths[3]).count()
    right = spark.read.format("statestore").option("operatorId", 1).option("joinSide", "right").load(paths[3]).count()
    assert left <= 1 and right <= 1


def test_news_join_keeps_buckets_and_not_items(spark, tmp_path):
    """Many items in an hour are one row of the join's state; bars between hours see their part of it."""
    paths = [str(tmp_path / n) for n in ("bars", "news", "out", "state")]
    stories = [(("beats", "plunge", "quiet")[i % 3], T(1, 6) + dt.timedelta(seconds=17 * i)) for i in range(200)]
    scored = items(spark, stories).select("market", "ticker", "published_at", "score", "confidence")
    hours = [T(1, 6, 30), T(1, 7), T(3), T(8, 6, 20), T(8, 7)]
    for at in (T(3), T(28)):
        rows = hours if at == T(3) else [at]
        bars(spark, rows).withColumn("ticker", F.lit("X" if at == T(3) else "-")).write.mode("append").parquet(paths[0])
        mark = scored.limit(1).withColumn("ticker", F.lit("-")).withColumn("published_at", F.lit(at))
        (scored.unionByName(mark) if at == T(3) else mark).write.mode("append").parquet(paths[1])
        schema = "market string, ticker string, ts timestamp"
        got = drain_to_table(st.news_signals(read_table(spark, paths[0], schema), read_table(spark, paths[1], scored.schema)), "n", paths[2], paths[3])
        if at == T(3):
            state_rows = spark.read.format("statestore").option("operatorId", 1).option("joinSide", "right").load(paths[3])
            assert 1 <= state_rows.count() <= 3
    want = {r["ts"]: r for r in nw.news_signal(items(spark, stories), bars(spark, hours)).collect()}
    live = {r["ts"]: r for r in got.collect()}
    assert set(live) == set(want) == set(hours[:-1])
    for t, r in live.items():
        assert (r["score"], r["confidence"], r["n_items"]) == (pytest.approx(want[t]["score"]), pytest.approx(want[t]["confidence"]), want[t]["features"]["n_items"])


def test_a_silent_job_is_reported_without_a_row_of_its_own(spark, tmp_path):
    schema = "component string, ts timestamp, max_age_hours double"
    got = None
    batches = ([("a", T(1), 5.0), ("b", T(1), 30.0)], [("b", T(1, 6), 30.0)], [("b", T(2), 30.0), ("a", T(2, 1), 5.0), ("a", T(2, 6), 5.0)], [("b", T(3), 30.0)])
    seen = []
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "b"))
        got = drain_to_table(st.silences(read_table(spark, str(tmp_path / "b"))), "b", str(tmp_path / "o"), str(tmp_path / "c"))
        seen.append(sorted((r["component"], r["last"], r["silent_since"], r["beats"]) for r in got.collect()))
    first = ("a", T(1), T(1, 5), 1)
    # 'a' is reported by the batch that has rows of 'b' only; beats exactly five hours apart are no silence
    assert seen == [[], [first], [first], [first, ("a", T(2, 6), T(2, 11), 2)]]
