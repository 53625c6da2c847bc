import datetime as dt

import numpy as np
import pytest
from helpers import bars_frame, day, path_rows
from pyspark.sql import functions as F

from barquet.functions import extension, indicators, signals
from barquet.operators import fusion


def rising(spark, n):
    rows = [("NASDAQ", "R", day(i), 100.0 + i, 102.0 + i, 98.0 + i, 100.0 + i, 1000 + i) for i in range(n)]
    return bars_frame(spark, rows)


def test_all_signals_on_a_long_series(spark):
    names = list(signals.SIGNALS)
    last = signals.signals_wide(rising(spark, 800), names).orderBy(F.desc("d")).first()
    assert all(last[n] is not None for n in names)
    assert last["momentum_12_1"] == pytest.approx((899 - 21) / (899 - 252) - 1)
    assert last["reversal_5"] < 0 < last["volume_trend"]


def test_short_series_has_no_opinion(spark):
    names = [n for n in signals.SIGNALS if signals.SIGNALS[n].bars > 5]
    assert all(r[n] is None for r in signals.signals_wide(rising(spark, 5), names).collect() for n in names)


def test_flat_prices(spark):
    flat = bars_frame(spark, path_rows("F", [50.0] * 70))
    last = signals.signals_wide(flat, ["low_volatility_60", "return_skewness_60"]).orderBy(F.desc("d")).first()
    assert last["low_volatility_60"] == 0.0 and last["return_skewness_60"] is None


def test_appending_bars_never_changes_earlier_rows(spark):
    rng = np.random.default_rng(3)
    closes = list(100 * np.exp(np.cumsum(rng.normal(0, 0.02, 320))))
    full = bars_frame(spark, path_rows("X", closes))
    early = full.filter(F.col("d") < F.lit(day(300)))
    names = list(signals.SIGNALS)
    a = signals.signals_wide(early, names).orderBy("d").select(*names).collect()
    b = signals.signals_wide(full, names).orderBy("d").select(*names).collect()
    assert a == b[:300]
    ind = lambda df: [
        (r["d"], r["source"], r["score"]) for r in indicators.indicator_signals(df, order="d").orderBy("d", "source").collect()
    ]
    assert ind(early) == [x for x in ind(full) if x[0] < day(300)]


def test_python_signal_sees_only_its_window(spark):
    n = 2500  # several chunks
    full = bars_frame(spark, path_rows("X", [float(i + 1) for i in range(n)]) + path_rows("Y", [1.0] * 3))

    def score(windows):
        close = windows["close"]
        assert set(windows) == {"open", "high", "low", "close", "volume"}
        return np.where(close[:, -1] % 10 == 0, np.nan, close.shape[1] * 1e6 + close[:, 0] * 1e3 - close[:, -1])

    seen = signals.python_signal(full, score, 7)
    got = [r["score"] for r in seen.filter("ticker = 'X'").orderBy("d").collect()]
    assert got == [None] * 6 + [None if i % 10 == 0 else 7e6 + (i - 6) * 1e3 - i for i in range(7, n + 1)]
    assert [r["score"] for r in seen.filter("ticker = 'Y'").collect()] == [None] * 3


def indicator(spark, closes, name):
    rows = indicators.indicators_wide(bars_frame(spark, path_rows("I", closes)), [name], "d").orderBy("d").collect()
    return [r[name] for r in rows]


def ema(values, n):
    k, e = 2.0 / (n + 1), values[0]
    for v in values[1:]:
        e = v * k + e * (1 - k)
    return e


def test_macd_equals_the_folds(spark):
    rng = np.random.default_rng(4)
    closes = list(100 + np.cumsum(rng.normal(size=60)))
    got = indicator(spark, closes, "macd_trend")
    assert got[33] is None and got[34] is not None
    for at in (34, 47, 59):
        tail = closes[at - 33 : at + 1]
        line = [ema(tail[: 26 + i], 12) - ema(tail[: 26 + i], 26) for i in range(9)]
        hist = line[-1] - ema(line, 9)
        assert got[at]["score"] == pytest.approx(max(-1, min(1, hist / closes[at] * 100)), abs=1e-9)


def test_rsi_extremes_and_flat(spark):
    up = indicator(spark, [float(i) for i in range(1, 30)], "rsi_reversion")[-1]
    flat = indicator(spark, [5.0] * 30, "rsi_reversion")[-1]
    down = indicator(spark, [float(60 - i) for i in range(30)], "rsi_reversion")[-1]
    assert up["score"] == -1.0 and flat["score"] == -1.0 and down["score"] == 1.0 and up["confidence"] == 0.9


def test_bollinger_without_width(spark):
    flat = indicator(spark, [5.0] * 25, "bollinger_reversion")
    assert flat[18] is None and flat[19]["score"] == 0.0 and flat[19]["confidence"] == 0.1


def test_combined_technical_grows_its_window(spark):
    closes = [100 + (i % 7) - 0.3 * i for i in range(80)]
    rows = indicators.combined_technical(bars_frame(spark, path_rows("T", closes)), order="d").orderBy("d").collect()
    assert len(rows) == 31
    for r, at in ((rows[0], 49), (rows[5], 54), (rows[-1], 79)):
        tail = closes[max(0, at - 59) : at + 1]
        assert r["features"]["macd_hist"] == pytest.approx(ema(tail, 12) - ema(tail, 26), abs=1e-9)


def test_average_true_range(spark):
    rows = [("NASDAQ", "A", day(i), 10.0, 12.0 + i % 3, 9.0, 10.0 + i % 2, 1) for i in range(40)]
    got = indicators.average_true_range(bars_frame(spark, rows), order="d").orderBy("d").collect()
    atr, trs, prev = None, [], None
    for r, row in zip(got, rows):
        _, _, _, _, h, lo, c, _ = row
        tr = h - lo if prev is None else max(h - lo, abs(h - prev), abs(lo - prev))
        prev = c
        trs.append(tr)
        if len(trs) == 14:
            atr = sum(trs) / 14
        elif len(trs) > 14:
            atr = (atr * 13 + tr) / 14
        assert r["atr"] == (None if atr is None else pytest.approx(atr))


def test_daily_loss_is_sticky_for_the_day(spark):
    t = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [("a", t(1, 9), 100.0), ("a", t(1, 10), 96.0), ("a", t(1, 11), 100.0), ("a", t(2, 9), 90.0), ("a", t(2, 10), 88.0)]
    df = spark.createDataFrame(rows, "acc string, ts timestamp, equity double")
    out = indicators.daily_loss(df, ["acc"]).orderBy("ts").collect()
    assert [r["breached"] for r in out] == [False, True, True, False, False]


def test_fusion_and_hysteresis(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", "M", "T", t, 1.0, 0.5), ("b", "M", "T", t, -1.0, 0.25), ("z", "M", "U", t, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "source string, market string, ticker string, ts timestamp, score double, confidence double")
    got = {r["ticker"]: r["combined"] for r in fusion.combined(df, {"a": 2.0}).collect()}
    assert got == {"T": pytest.approx((1.0 - 0.25) / 1.25), "U": 0.0}
    scores = [0.1, 0.5, 0.3, -0.1, 0.1, 0.4]
    series = spark.createDataFrame([("M", "T", day(i), s) for i, s in enumerate(scores)], "market string, ticker string, d date, combined double")
    held = fusion.hysteresis(series, 0.4, 0.0, order=("d",)).orderBy("d").collect()
    assert [r["weight"] for r in held] == [0.0, 0.5, 0.5, 0.0, 0.0, 0.4]


def test_live_only_sources_fail_in_backtests(spark):
    extension.register_source(extension.SignalSource("live", lambda b: b, supports_backtest=False))
    with pytest.raises(ValueError):
        extension.run_sources(rising(spark, 3), ["live"], backtest=True)
