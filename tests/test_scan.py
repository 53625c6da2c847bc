"""The ordered operators give the plain window results for any chunking, with a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barquet.operators import scan


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    rows = []
    for ticker, n in (("HOT", 400), ("A", 150), ("B", 60), ("C", 1)):
        days = np.sort(rng.choice(2000, n, replace=False))
        rows.append(pd.DataFrame({"market": "M", "ticker": ticker, "d": pd.to_datetime(days, unit="D").date,
                                  "x": rng.normal(size=n), "close": rng.uniform(1, 9, n)}))
    return pd.concat(rows, ignore_index=True)


def collected(df, value):
    out = df.select("ticker", "d", value).toPandas()
    return out.sort_values(["ticker", "d"])[value].to_numpy()


def test_positions_are_dense(spark, skewed):
    df = scan.with_position(spark.createDataFrame(skewed), width=7)
    want = skewed.sort_values(["ticker", "d"]).groupby("ticker").cumcount().to_numpy()
    assert (collected(df, "pos") == want).all()


@pytest.mark.parametrize("chunk", [25, 4096])
def test_halo_frames_equal_plain_windows(spark, skewed, chunk):
    def build(df, f):
        return df.withColumn("s", F.sum("x").over(f.rows(-20))).withColumn("p", f.lag("x", 20)).withColumn("n", f.lead("x", 5))

    df = scan.framed(spark.createDataFrame(skewed), build, back=20, ahead=5, chunk=chunk).cache()
    g = skewed.sort_values(["ticker", "d"]).groupby("ticker")["x"]
    np.testing.assert_allclose(collected(df, "s"), g.rolling(21, min_periods=1).sum().to_numpy())
    np.testing.assert_allclose(collected(df, "p").astype(float), g.shift(20).to_numpy())
    np.testing.assert_allclose(collected(df, "n").astype(float), g.shift(-5).to_numpy())
    assert df.count() == len(skewed)


@pytest.mark.parametrize("width", [3, 10_000])
def test_running_equals_plain_windows(spark, skewed, width):
    data = skewed.assign(y=skewed["x"].where(skewed["x"] > 0.5))
    df = scan.running(
        spark.createDataFrame(data).withColumn("y", F.nanvl("y", F.lit(None))),
        {"s": ("sum", "x"), "m": ("max", "x"), "l": ("last", "y"), "c": ("count", "y")}, width=width,
    ).cache()
    g = data.sort_values(["ticker", "d"]).groupby("ticker")
    np.testing.assert_allclose(collected(df, "s"), g["x"].cumsum().to_numpy())
    np.testing.assert_allclose(collected(df, "m"), g["x"].cummax().to_numpy())
    np.testing.assert_allclose(collected(df, "l").astype(float), g["y"].ffill().to_numpy())
    want = data.sort_values(["ticker", "d"])["y"].notna().groupby(data["ticker"]).cumsum()
    assert (collected(df, "c") == want.sort_index().loc[data.sort_values(["ticker", "d"]).index].to_numpy()).all()


def test_running_exclusive_end(spark, skewed):
    df = scan.running(spark.createDataFrame(skewed), {"s": ("sum", "x")}, end=-1, width=9)
    g = skewed.sort_values(["ticker", "d"]).groupby("ticker")["x"]
    np.testing.assert_allclose(collected(df, "s").astype(float), (g.cumsum() - g.shift(0)).where(g.cumcount() > 0).to_numpy(), atol=1e-9)


@pytest.mark.parametrize("size", [8, 256])
def test_discounted_sum_equals_recursion(spark, skewed, size):
    df = scan.with_position(spark.createDataFrame(skewed))
    got = collected(scan.discounted_sum(df, 0.94, "close", "s", size=size), "s")
    want = []
    for _, rows in skewed.sort_values(["ticker", "d"]).groupby("ticker"):
        s = 0.0
        for c in rows["close"]:
            s = 0.94 * s + c
            want.append(s)
    np.testing.assert_allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("bounded", [True, False])
def test_ranks_and_quantiles(spark, bounded):
    rng = np.random.default_rng(2)
    data = pd.DataFrame({"g": ["hot"] * 500 + ["a"] * 40 + ["b"] * 3, "v": rng.normal(size=543).round(1)})
    data.loc[:150, "v"] = 0.0  # a heavy tie
    ranks = scan.value_ranks(spark.createDataFrame(data), ["g"], "v", bounded=bounded, splits=7)
    got = {(r["g"], r["v"]): r["before"] + (r["n"] + 1) / 2 for r in ranks.collect()}
    want = data.assign(r=data.groupby("g")["v"].rank())
    assert all(got[(r.g, r.v)] == r.r for r in want.itertuples())
    q = scan.linear_quantiles(ranks, ["g"], "v", {"lo": 0.13, "hi": 0.87}).toPandas().set_index("g")
    for g, rows in data.groupby("g"):
        np.testing.assert_allclose([q.loc[g, "lo"], q.loc[g, "hi"]], np.quantile(rows["v"], [0.13, 0.87]))


@pytest.mark.parametrize("parts", [1, 7])
def test_any_order_is_cut_in_parts(spark, parts):
    """Few times, many rows at each, nearly all of them of one symbol, and a second small key."""
    made = spark.range(200).selectExpr(
        "IF(id < 180, 'a', 'b') AS key", "date_add(DATE '2024-01-01', CAST(id % 2 AS INT)) AS d", "IF(id % 9 = 0, 'X', 'H') AS t",
        "id AS k", "(id * 37) % 11 AS v",
    )
    df = scan.in_order(made, ["key"], ["d", "t", "k"], parts)
    assert df.select(scan.PART).distinct().count() >= min(parts, 5)
    rows = sorted((r["key"], r["d"], r["t"], r["k"], r["v"]) for r in df.collect())
    placed = scan.with_position(df, ["key"], ("d", "t", "k"), part=scan.PART).collect()
    got = scan.running(df, {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "v")}, ["key"], ("d", "t", "k"), part=scan.PART)
    where, sums = {}, {}
    for key in ("a", "b"):
        total, most = 0, -1
        for i, (_, d, t, k, v) in enumerate(r for r in rows if r[0] == key):
            total, most = total + v, max(most, v)
            where[k], sums[k] = i, (total, most, v)
    assert {r["k"]: r["pos"] for r in placed} == where
    assert {r["k"]: (r["s"], r["m"], r["l"]) for r in got.collect()} == sums
