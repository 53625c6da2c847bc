"""Small panels built in code."""

from __future__ import annotations

import datetime as dt

BAR = "market string, ticker string, d date, open double, high double, low double, close double, volume long"


def day(i: int, start: str = "2020-01-01") -> dt.date:
    return dt.date.fromisoformat(start) + dt.timedelta(days=i)


def bars_frame(spark, rows):
    return spark.createDataFrame(rows, BAR)


def path_rows(ticker, closes, start="2020-01-01", market="NASDAQ", volume=1000, pad=0.0):
    closes = [float(c) for c in closes]
    rows, before = [], closes[0]
    for i, c in enumerate(closes):
        rows.append((market, ticker, day(i, start), before, max(before, c) + pad, min(before, c) - pad, c, volume))
        before = c
    return rows


def drift_panel(spark, names=40, days=120):
    """Names with constant drifts; open is the previous close."""
    rows = []
    for k in range(names):
        g = 0.001 * (k - names // 2)
        rows += path_rows(f"S{k:03d}", [100.0 * (1 + g) ** i for i in range(days)], volume=1_000_000)
    return bars_frame(spark, rows)


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
