"""Technical indicators as window expressions: STRUCT<score, confidence> per bar.

``INDICATORS`` maps a name to an :class:`Indicator`; register further ones with
``register_indicator``. Exponential averages on a bounded tail are fixed linear combinations of
the last closes, so their weights are computed once, here, and the plan holds plain arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.functions.columns import clamp
from barquet.operators.scan import Frames, discounted_sum, framed

HORIZON = "5d"


@dataclass(frozen=True)
class Indicator:
    min_bars: int
    prepare: Callable[[DataFrame, Frames], DataFrame]
    result: Callable[[], Column]


INDICATORS: dict[str, Indicator] = {}


def register_indicator(name: str, indicator: Indicator) -> None:
    INDICATORS[name] = indicator


def sma(f: Frames, n: int, col: str = "close") -> Column:
    return F.avg(col).over(f.rows(-(n - 1)))


def sd_pop(f: Frames, n: int, col: str = "close") -> Column:
    return F.stddev_pop(col).over(f.rows(-(n - 1)))


def ema_weights(length: int, span: int) -> list[float]:
    """Weights, oldest first, of an exponential average seeded at the oldest of ``length`` values."""
    k = 2.0 / (span + 1)
    weights = [1.0]
    for _ in range(length - 1):
        weights = [w * (1 - k) for w in weights] + [k]
    return weights


def _struct(score: Column, confidence: Column) -> Column:
    return F.struct(score.alias("score"), confidence.alias("confidence"))


def moving_average_cross(fast: int = 10, slow: int = 30, k: float = 20.0) -> Indicator:
    def prepare(df: DataFrame, f: Frames) -> DataFrame:
        return df.withColumn("_ma_f", sma(f, fast)).withColumn("_ma_s", sma(f, slow))

    def result() -> Column:
        spread = (F.col("_ma_f") - F.col("_ma_s")) / F.col("_ma_s")
        x = F.abs(spread) * k
        return F.when(F.col("_ma_s") != 0, _struct(clamp(spread * k), clamp(0.1 + 0.8 * (x / (1.0 + x)), 0.1, 0.9)))

    return Indicator(slow, prepare, result)


def rsi_column(df: DataFrame, f: Frames, period: int, out: str) -> DataFrame:
    """Relative strength from plain sums of the last ``period`` moves; 100 without a fall."""
    df = df.withColumn("_diff", F.col("close") - f.lag("close"))
    frame = f.rows(-(period - 1))
    ups = F.sum(F.when(F.col("_diff") > 0, F.col("_diff")).otherwise(0.0)).over(frame) / period
    downs = F.sum(F.when(F.col("_diff") < 0, -F.col("_diff")).otherwise(0.0)).over(frame) / period
    return (
        df.withColumn("_up", ups)
        .withColumn("_dn", downs)
        .withColumn(out, F.when(F.col("_dn") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col("_up") / F.col("_dn"))))
        .drop("_up", "_dn", "_diff")
    )


def rsi_reversion(period: int = 14, oversold: float = 30.0, overbought: float = 70.0) -> Indicator:
    mid = (oversold + overbought) / 2.0
    scale = mid or 50.0

    def result() -> Column:
        return _struct(
            clamp((mid - F.col("_rsi")) / scale), clamp(0.1 + 0.8 * (F.abs(F.col("_rsi") - mid) / scale), 0.1, 0.9)
        )

    return Indicator(period + 1, lambda df, f: rsi_column(df, f, period, "_rsi"), result)


def macd_weights(fast: int, slow: int, signal: int) -> tuple[list[float], list[float]]:
    """Weights, oldest first, of (MACD line, histogram) over the last slow+signal-1 closes."""
    tail = slow + signal - 1
    lines = []
    for i in range(signal):
        n = slow + i
        quick, calm = ema_weights(n, fast), ema_weights(n, slow)
        lines.append([a - b for a, b in zip(quick, calm)] + [0.0] * (tail - n))
    smooth = ema_weights(signal, signal)
    line = lines[-1]
    signal_line = [sum(s * row[j] for s, row in zip(smooth, lines)) for j in range(tail)]
    return line, [a - b for a, b in zip(line, signal_line)]


def macd_trend(fast: int = 12, slow: int = 26, signal: int = 9) -> Indicator:
    line, histogram = macd_weights(fast, slow, signal)
    tail = len(line)

    def prepare(df: DataFrame, f: Frames) -> DataFrame:
        lags = [F.col("close")] + [f.lag("close", n) for n in range(1, tail)]
        df = df.withColumn("_tail", F.array(*reversed(lags)))

        def dot(weights: Sequence[float]) -> Column:
            total = F.lit(0.0)
            for j, w in enumerate(weights):
                total = total + F.get("_tail", F.lit(j)) * w
            return total

        return df.withColumn("_macd", dot(line)).withColumn("_hist", dot(histogram)).drop("_tail")

    def result() -> Column:
        price = F.when(F.col("close") != 0, F.col("close")).otherwise(1.0)
        hist = F.col("_hist")
        weight = F.abs(hist) / (price * 0.01 + F.abs(hist))
        confidence = F.when(hist * F.col("_macd") > 0, clamp(0.5 + 0.4 * weight, 0.1, 0.9)).otherwise(
            clamp(0.1 + 0.3 * weight, 0.1, 0.9)
        )
        return _struct(clamp(hist / price * 100.0), confidence)

    return Indicator(slow + signal, prepare, result)


def bollinger_reversion(period: int = 20, stdevs: float = 2.0) -> Indicator:
    def prepare(df: DataFrame, f: Frames) -> DataFrame:
        return df.withColumn("_bb_m", sma(f, period)).withColumn("_bb_s", sd_pop(f, period))

    def result() -> Column:
        mean, sd = F.col("_bb_m"), F.col("_bb_s")
        z = (F.col("close") - mean) / (stdevs * sd)
        far = F.abs(z)
        base = F.when(far >= 1.0, clamp(0.1 + 0.5 * (far - 1.0), 0.1, 0.9)).otherwise(clamp(0.1 + 0.3 * far, 0.1, 0.4))
        narrow = clamp(2.0 * stdevs * sd / mean / 0.01, 0.2, 1.0)
        return F.when((sd == 0) | (mean == 0), _struct(F.lit(0.0), F.lit(0.1))).otherwise(
            _struct(clamp(-z), clamp(base * narrow, 0.1, 0.9))
        )

    return Indicator(period, prepare, result)


register_indicator("ma_cross", moving_average_cross())
register_indicator("rsi_reversion", rsi_reversion())
register_indicator("macd_trend", macd_trend())
register_indicator("bollinger_reversion", bollinger_reversion())


def indicator_columns(names: Iterable[str]) -> tuple[int, Callable[[DataFrame, Frames], DataFrame]]:
    """How far back the named indicators look, and the step that adds one STRUCT column for each.

    The step runs on a table (``framed``) and on the batches of a stream (``streaming.state.framed_stream``).
    """
    chosen = list(names)

    def build(df: DataFrame, f: Frames) -> DataFrame:
        for name in chosen:
            df = INDICATORS[name].prepare(df, f)
        return df.select(
            "*", *[F.when(f.full(INDICATORS[n].min_bars), INDICATORS[n].result()).alias(n) for n in chosen]
        )

    return max(INDICATORS[n].min_bars for n in chosen), build


def indicators_wide(bars: DataFrame, names: Iterable[str] | None = None, order: str = "ts") -> DataFrame:
    """One STRUCT column per indicator, NULL until it has its bars."""
    back, build = indicator_columns(names or INDICATORS)
    return framed(bars, build, order=(order,), back=back)


def signal_rows(wide: DataFrame, names: Iterable[str] | None = None, order: str = "ts") -> DataFrame:
    """Long signal rows of a table with one column per indicator."""
    chosen = list(names or INDICATORS)
    pairs = ", ".join(f"'{n}', `{n}`" for n in chosen)
    return (
        wide.selectExpr("market", "ticker", order, "close", f"stack({len(chosen)}, {pairs}) as (source, res)")
        .filter("res is not null")
        .select(
            "source", "market", "ticker", order, "close",
            clamp(F.col("res.score")).alias("score"),
            clamp(F.col("res.confidence"), 0.0, 1.0).alias("confidence"),
            F.lit(HORIZON).alias("horizon"),
        )
    )


def indicator_signals(bars: DataFrame, names: Iterable[str] | None = None, order: str = "ts") -> DataFrame:
    """Long signal rows: source, symbol, time, clamped score and confidence, horizon."""
    return signal_rows(indicators_wide(bars, names, order), names, order)


def combined_columns(fast: int = 20, slow: int = 50) -> tuple[int, Callable[[DataFrame, Frames], DataFrame]]:
    """The combined technical score as a step over frames: the column ``technical``, NULL until ``slow`` bars are there."""
    size = max(slow, 60)

    def build(df: DataFrame, f: Frames) -> DataFrame:
        df = rsi_column(df, f, 14, "_rsi")
        df = (
            df.withColumn("_mf", sma(f, fast))
            .withColumn("_ms", sma(f, slow))
            .withColumn("_sd", sd_pop(f, fast))
            .withColumn("_old", F.first("close").over(f.rows(-(size - 1))))
        )
        # A shorter window behaves like one padded with its oldest close: the average is seeded there.
        lags = [F.col("close")] + [F.coalesce(f.lag("close", n), F.col("_old")) for n in range(1, size)]
        df = df.withColumn("_tail", F.array(*reversed(lags)))
        weights = [a - b for a, b in zip(ema_weights(size, 12), ema_weights(size, 26))]
        macd = F.lit(0.0)
        for j, w in enumerate(weights):
            macd = macd + F.get("_tail", F.lit(j)) * w
        df = df.withColumn("_macd", macd)
        ms = F.col("_ms")
        ma_part = clamp(F.when(ms != 0, (F.col("_mf") - ms) / ms).otherwise(0.0) * 10)
        rsi_part = clamp((F.col("_rsi") - 50.0) / 50.0)
        macd_part = clamp(F.col("_macd") / F.when(ms != 0, ms).otherwise(1.0) * 10)
        bb = F.when(F.col("_sd") != 0, (F.col("close") - F.col("_mf")) / (2 * F.col("_sd"))).otherwise(0.0)
        features = F.create_map(
            F.lit("ma_fast"), F.col("_mf"), F.lit("ma_slow"), ms, F.lit("rsi"), F.col("_rsi"),
            F.lit("macd_hist"), F.col("_macd"), F.lit("bb_pos"), bb,
        )
        score = clamp((ma_part + rsi_part + macd_part + clamp(bb)) / 4.0)
        made = F.struct(score.alias("score"), F.lit(0.6).alias("confidence"), features.alias("features"))
        return df.withColumn("technical", F.when(f.full(slow), made)).drop("_tail", "_old", "_rsi", "_mf", "_ms", "_sd", "_macd")

    return size, build


def combined_rows(wide: DataFrame, order: str = "ts") -> DataFrame:
    """Signal rows of a table with the column ``technical``."""
    return wide.filter("technical IS NOT NULL").select(
        F.lit("technical").alias("source"), "market", "ticker", order, F.col("technical.score").alias("score"),
        F.col("technical.confidence").alias("confidence"), F.lit("1d").alias("horizon"), F.col("technical.features").alias("features"),
    )


def combined_technical(bars: DataFrame, fast: int = 20, slow: int = 50, order: str = "ts") -> DataFrame:
    """Mean of four clamped parts on a window of at most max(slow, 60) closes, with its feature map."""
    back, build = combined_columns(fast, slow)
    return combined_rows(framed(bars, build, order=(order,), back=back), order)


def average_true_range(bars: DataFrame, period: int = 14, order: str = "ts") -> DataFrame:
    """Wilder's ATR: seeded with the mean of the first ``period`` ranges, NULL before."""

    def build(df: DataFrame, f: Frames) -> DataFrame:
        before = f.lag("close")
        span = F.col("high") - F.col("low")
        df = df.withColumn(
            "tr", F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before))
        )
        seed = F.avg("tr").over(f.rows(-(period - 1)))
        return df.withColumn(
            "_y",
            F.when(F.col("pos") < period - 1, 0.0)
            .when(F.col("pos") == period - 1, seed)
            .otherwise(F.col("tr") / period),
        )

    ranges = framed(bars, build, order=(order,), back=period)
    out = discounted_sum(ranges, (period - 1) / period, "_y", "atr")
    return out.withColumn("atr", F.when(F.col("pos") >= period - 1, F.col("atr"))).drop("_y")


def daily_loss(equity: DataFrame, keys: Sequence[str], order: str = "ts", value: str = "equity", limit: float = 0.03):
    """First equity of the day and a breach flag that stays set for the rest of the day."""
    from pyspark.sql import Window as W

    day = F.to_date(order)
    so_far = W.partitionBy(*keys, "day").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    df = equity.withColumn("day", day).withColumn("day_start", F.first(value).over(so_far))
    hit = (F.col("day_start") > 0) & (1.0 - F.col(value) / F.col("day_start") > limit)
    return df.withColumn("breached", F.max(hit).over(so_far))
