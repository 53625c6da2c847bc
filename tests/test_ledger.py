import datetime as dt

import pytest
from helpers import BAR, as_dict, day
from pyspark.sql import functions as F

from barquet.functions import columns as fn
from barquet.operators import filters, ledger, recon

FILL = "account string, market string, ticker string, currency string, d date, k int, side string, quantity long, price double, commission double"


def fill(spark, rows):
    return spark.createDataFrame(rows, FILL)


def test_krw_three_trades(spark):
    trades = [("BUY", 37, 8_250.0, 41.5), ("BUY", 13, 8_400.0, 15.25), ("SELL", 29, 9_125.0, 560.75)]
    rows = [("A", "KOSPI", "K1", "KRW", day(i), i, side, q, p, c) for i, (side, q, p, c) in enumerate(trades)]
    got = ledger.apply_fills(fill(spark, rows), initial_cash=700_000.0).orderBy("d").collect()
    cash, held, want = 700_000.0, 0, []
    for side, q, p, c in trades:
        sign = 1 if side == "BUY" else -1
        cash -= sign * q * p + c
        held += sign * q
        want.append((held, pytest.approx(cash)))
    assert [(r["position"], r["cash_krw"]) for r in got] == want


def test_fills_over_parts_share_one_shuffle(spark):
    """Two accounts, three symbols, many parts: running sums as in a loop, in one exchange of the fills."""
    rows, cash, held, want = [], {}, {}, {}
    for i in range(400):
        account, ticker, side = "AB"[i % 7 == 0], f"K{i * 31 % 3}", ("BUY", "SELL")[i * 17 % 5 == 0]
        rows.append((account, "KOSPI", ticker, "KRW", day(i // 90), i, side, i % 9 + 1, 100.0 + i % 13, float(i % 3)))
        sign = 1 if side == "BUY" else -1
        cash[account] = cash.get(account, 1e6) - sign * (i % 9 + 1) * (100.0 + i % 13) - i % 3
        held[account, ticker] = held.get((account, ticker), 0) + sign * (i % 9 + 1)
        want[i] = (held[account, ticker], cash[account])
    got = ledger.apply_fills(fill(spark, rows[::-1]).repartition(5), initial_cash=1e6, keep=["side"])
    assert got.columns == ["account", "market", "ticker", "d", "k", "side", "position", "cash_krw"]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r["k"]: (r["position"], r["cash_krw"]) for r in got.collect()} == want


def test_foreign_fill_and_mark(spark):
    rows = [("A", "NASDAQ", "N1", "USD", day(0), 1, "BUY", 4, 55.5, 1.75), ("A", "NASDAQ", "N1", "USD", day(1), 2, "SELL", 1, 60.0, 0.5)]
    bars = spark.createDataFrame([("NASDAQ", "N1", day(2), 58.0, 58.0, 58.0, 58.0, 1)], BAR)
    values = ledger.symbol_values(fill(spark, rows), bars)
    got = ledger.equity_curve(values, 5_000_000.0).orderBy("d").collect()
    rate = ledger.FX["USD"]
    first = 5_000_000.0 - (4 * 55.5 + 1.75) * rate
    second = first + (60.0 - 0.5) * rate
    assert [r["cash_krw"] for r in got][:2] == [pytest.approx(first), pytest.approx(second)]
    assert got[2]["equity_krw"] == pytest.approx(second + 3 * 58.0 * rate)


@pytest.mark.parametrize(
    "market,side,price,qty,cost",
    [("KOSPI", "SELL", 7_350.0, 41, 645.0478), ("KOSPI", "BUY", 7_350.0, 41, 42.3478), ("NASDAQ", "BUY", 81.25, 16, 4.55),
     ("NASDAQ", "SELL", 81.25, 16, 4.5799), ("NASDAQ", "SELL", 0.75, 90_000, 237.6405 + 9.79)],
)
def test_commissions_by_hand(spark, market, side, price, qty, cost):
    df = spark.createDataFrame([(market, side, price, qty)], "market string, side string, price double, quantity long")
    got = fn.with_costs(df).select(fn.market_commission(F.col("price"), F.col("quantity"), F.col("side")).alias("c")).first()["c"]
    assert got == pytest.approx(cost, abs=1e-3)


def test_unknown_market_and_currency_fail(spark):
    df = spark.createDataFrame([("MOON", "BUY", 1.0, 1, "XXX")], "market string, side string, price double, quantity long, currency string")
    with pytest.raises(Exception, match="no cost rates"):
        fn.with_costs(df).select("commission_bps").collect()
    with pytest.raises(Exception, match="no rate for currency"):
        fn.to_krw(df, ["price"], ledger.FX).collect()


def test_slippage_is_off_by_default(spark):
    df = spark.createDataFrame([("KOSPI", 100.0, 10)], "market string, price double, quantity long")
    args = (F.col("price"), F.col("quantity"), F.col("market"))
    got = df.select(fn.Slippage().cost(*args).alias("off"), fn.Slippage(True).cost(*args).alias("on"),
                    fn.Slippage(True).cost(*args, at_open_or_close=False).alias("mid")).first()
    assert (got["off"], got["on"], got["mid"]) == (0.0, pytest.approx(1.3), pytest.approx(0.8))


def test_reconcile_orders(spark):
    submitted = spark.createDataFrame([(c, 100) for c in "abcdef"], "order_id string, qty long")
    fills = spark.createDataFrame([("a", 100), ("c", 60), ("d", 200), ("e", 40), ("e", 60), ("f", 100), ("f", 100)], "order_id string, qty long")
    got = {r["order_id"]: (r["status"], r["severity"]) for r in recon.reconcile_orders(submitted, fills).collect()}
    assert got == {"a": ("OK", "OK"), "b": ("UNFILLED", "WARN"), "c": ("PARTIAL", "WARN"), "d": ("OVERFILLED", "CRITICAL"),
                   "e": ("OK", "OK"), "f": ("OVERFILLED", "CRITICAL")}


def test_reconcile_positions(spark):
    s = "ticker string, qty long"
    e, b = spark.createDataFrame([("A", 5), ("B", 0), ("C", 1)], s), spark.createDataFrame([("A", 5), ("C", 3), ("D", 2)], s)
    got = {r["ticker"]: r["drift"] for r in recon.reconcile_positions(e, b, ["ticker"]).collect()}
    assert got == {"C": 2, "D": 2}


def test_holding_periods_on_the_global_bar_index(spark):
    held = {"A": [0, 1, 1, 0], "B": [1, 1, 1, 1]}
    rows = [("M", t, day(i), float(h)) for t, hs in held.items() for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "market string, ticker string, d date, weight double").withColumn("run", F.lit("r"))
    flags = ledger.open_flags(df, ["run", "market", "ticker"], "d")
    got = ledger.holding_periods(flags, ["run"], ("d", "ticker", "market")).first()
    # A opens at event 2 and closes at 6; B opens at 1 and is open at the end (8 events)
    assert got["holdings"] == 2 and got["avg_holding"] == pytest.approx((4 + 7) / 2)
    assert ledger.exposure(flags, ["run"], ("d", "ticker", "market")).first()["exposure"] == pytest.approx(7 / 8)


def test_pretrade_order_of_rules(spark):
    base = dict(side="BUY", quantity=10, decision_price=100.0, last_close=100.0, notional_krw=1e6, cash_krw=2e6, equity_krw=1e8, position_weight=0.0)
    cases = [({}, None), (dict(quantity=0), "FAT_FINGER_QTY"), (dict(quantity=20_000, last_close=0.0), "FAT_FINGER_QTY"),
             (dict(decision_price=131.0), "PRICE_SANITY"), (dict(last_close=0.0), "PRICE_SANITY"), (dict(notional_krw=6e6), "MAX_ORDER_NOTIONAL"),
             (dict(cash_krw=1e6), "INSUFFICIENT_CASH"), (dict(cash_krw=1e6, side="SELL"), None), (dict(position_weight=0.295), "MAX_POSITION_WEIGHT")]
    rows = [(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{k} {'string' if k == 'side' else 'long' if k == 'quantity' else 'double'}" for k in base))
    got = as_dict(df.withColumn("code", filters.pretrade_code()), "i", "code")
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_heartbeats(spark):
    expected = spark.createDataFrame([("a", 24.0), ("b", 24.0), ("c", 24.0), ("d", 24.0)], "component string, max_age_hours double")
    beats = spark.createDataFrame([("a", "2024-01-01T00:00:00"), ("b", "2024-01-02 23:00:00"), ("c", "soon")], "component string, last string")
    got = {r["component"]: (r["reason"], r["age_hours"]) for r in recon.stale_jobs(expected, beats, F.lit("2024-01-03").cast("timestamp")).collect()}
    assert got == {"a": ("stale", 48.0), "c": ("unparseable timestamp", None), "d": ("never recorded", None)}


def test_outcomes(spark):
    bars = spark.createDataFrame([("M", "T", day(i), c) for i, c in enumerate([100.0, 110.0, 110.0, 99.0])], "market string, ticker string, d date, close double")
    rows = [("M", "T", day(0), 100.0, 0.5), ("M", "T", day(1), 110.0, 0.5), ("M", "T", day(3), 99.0, 0.0)]
    df = spark.createDataFrame(rows, "market string, ticker string, d date, decision_price double, combined_score double")
    got = recon.outcomes(df, bars, (1, 2)).orderBy("d").collect()
    assert got[0]["fwd_return_1"] == pytest.approx(0.1) and got[0]["hit_1"] is True
    assert got[1]["hit_1"] is None and got[1]["hit_2"] is False
    assert got[2]["fwd_return_1"] is None and got[2]["max_bar"] == day(3)


def test_journal_verdicts(spark):
    schema = "key string, run_id string, qty long, scores map<string,double>"
    old = spark.createDataFrame([("a", "r0", 1, {"x": 1.0, "y": 2.0}), ("b", "r0", 1, {})], schema)
    rows = [("a", "r1", 1, {"y": 2.0, "x": 1.0}), ("b", "r1", 2, {}), ("c", "r1", 1, {}), ("c", "r1", 1, {}), ("c", "r1", 9, {}), ("d", "r1", 5, {})]
    new = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", seq long")
    got = as_dict(recon.journal_upsert(recon.decision_hash(old), recon.decision_hash(new)), "seq", "verdict")
    assert got == {0: "skip", 1: "conflict", 2: "append", 3: "skip", 4: "conflict", 5: "append"}


def test_a_journal_with_two_hashes_gives_one_verdict(spark):
    journal = spark.createDataFrame([("a", "h1"), ("a", "h2")], "key string, hash string")
    records = spark.createDataFrame([("a", "h2", 1)], "key string, hash string, seq long")
    assert [r["verdict"] for r in recon.journal_upsert(journal, records).collect()] == ["conflict"]


def test_error_classes(spark):
    rows = [("EGW00201 수량", "TRANSIENT"), ("잔고 부족", "TERMINAL"), ("hello", "UNKNOWN")]
    df = spark.createDataFrame(rows, "m string, want string").withColumn("c", fn.error_class(F.col("m")))
    assert all(r["c"] == r["want"] for r in df.collect())


def test_record_rules_reject_nulls(spark):
    df = spark.createDataFrame([(0.5, 0.5, 1), (2.0, 0.5, 1), (0.5, None, 1), (0.5, 0.5, 0)], "score double, confidence double, quantity int")
    assert [r["rejected"] for r in filters.checked(df).collect()] == [None, "score", "confidence", "quantity"]


@pytest.mark.parametrize("parts", [1, 6])
def test_exposure_and_holding_on_minutes_of_alike_names(spark, parts):
    """Minute bars, all names with one prefix, one name with most rows: equal to stepping through the bars."""
    import random

    from barquet.operators.scan import in_order

    rng = random.Random(5)
    rows = []
    for ticker, minutes in (("AA1", 150), ("AA2", 40), ("AAB", 12), ("A", 5)):
        for m in sorted(rng.sample(range(160), minutes)):
            rows.append(("R", "M", ticker, dt.datetime(2026, 1, 5, 9) + dt.timedelta(minutes=m), float(rng.random() < 0.3)))
    flags = ledger.open_flags(spark.createDataFrame(rows, "run string, market string, ticker string, ts timestamp, weight double"), ["run", "market", "ticker"])
    cut = in_order(flags, ["run"], ["ts", "ticker", "market"], parts)
    assert cut.select("_part").distinct().count() == parts
    held, since, lengths, exposed = {}, {}, [], 0
    bars = sorted(rows, key=lambda r: (r[3], r[2]))
    for i, (_, _, ticker, _, weight) in enumerate(bars):
        if weight and not held.get(ticker):
            since[ticker] = i
        if not weight and held.get(ticker):
            lengths.append(i - since.pop(ticker))
        held[ticker] = bool(weight)
        exposed += any(held.values())
    lengths += [len(bars) - i for i in since.values()]
    assert ledger.exposure(cut, ["run"]).first()["exposure"] == pytest.approx(exposed / len(bars))
    got = ledger.holding_periods(cut, ["run"]).first()
    assert (got["holdings"], got["avg_holding"]) == (len(lengths), pytest.approx(sum(lengths) / len(lengths)))


def test_marks_follow_the_holding_intervals(spark):
    """Random fills and bars, gaps in both: equal to stepping through the dates; a closed position makes no row."""
    import random

    rng = random.Random(8)
    fills, bars = [], []
    for ticker in ("X", "Y", "Z"):
        bars += [("NASDAQ", ticker, day(i), 1.0, 1.0, 1.0, rng.choice([None, 5.0 + i % 7]) if i % 5 == 0 else 5.0 + i % 7, 1)
                 for i in range(60) if rng.random() < 0.6 and ticker != "Z"]
        for account in ("A", "B"):
            held = 0
            for k, i in enumerate(sorted(rng.sample(range(60), 7))):
                side = "SELL" if held and rng.random() < 0.6 else "BUY"
                qty = held if side == "SELL" else rng.randint(1, 4)
                held += qty if side == "BUY" else -qty
                fills.append((account, "NASDAQ", ticker, "USD", day(i), k, side, qty, 3.0 + i, 0.0))
    got = {}
    for r in ledger.symbol_values(fill(spark, fills), spark.createDataFrame(bars, BAR)).collect():
        assert (r["account"], r["ticker"], r["d"]) not in got
        got[r["account"], r["ticker"], r["d"]] = (r["position"], r["mark"])
    closes = {(t, d): c for _, t, d, _, _, _, c, _ in bars}
    want = {}
    for account in ("A", "B"):
        for ticker in ("X", "Y", "Z"):
            mine = [f for f in fills if f[0] == account and f[2] == ticker]
            position, mark = 0, mine[0][8]
            for i in range(60):
                d = day(i)
                today = [f for f in mine if f[4] == d]
                position += sum(f[7] if f[6] == "BUY" else -f[7] for f in today)
                close = closes.get((ticker, d))
                if d >= mine[0][4]:
                    mark = close if close is not None else mark
                    if today or (position and close is not None):
                        want[account, ticker, d] = (position, mark)
    assert got == want
