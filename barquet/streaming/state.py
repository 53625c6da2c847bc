"""Keyed state per symbol: the tail of its bars, ATR and EWMA scalars, last close.

State per key is of fixed size, so a symbol of any length costs the same. Rows of one batch are
put in time order per symbol; a bar not newer than the last one seen is late and is dropped. Size
the batches with ``read_table(..., files_per_batch=n)``: a task holds one symbol's rows of a batch.

Window expressions are not written a second time for streams: ``framed_stream`` keeps only the tail
that a frame reaches back to, hands it out ahead of each batch's new bars, and runs the same step that
``framed`` runs on a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barquet.operators.scan import SYMBOL, Frames
from barquet.session import run_folder
from barquet.streaming.run import drain_batches, use_rocksdb


class _InOrder(StatefulProcessor):
    """Common part: time order within a batch, late bars dropped by the stored last time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t long")
        self.open_state(handle)

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("ts")
        micros = batch["ts"].astype("datetime64[us]").astype("int64")
        seen = self.last.get()[0] if self.last.exists() else None
        if seen is not None:
            batch, micros = batch[micros > seen], micros[micros > seen]
        if len(batch):
            self.last.update((int(micros.iloc[-1]),))
            yield self.step(batch)

    def close(self) -> None:
        pass


class TailState(_InOrder):
    """The last ``size`` bars of a symbol and how many there were, as one array per column.

    Each batch comes out as tail and new bars in order, with their positions; ``_own`` marks the new ones.
    """

    def __init__(self, size: int, columns: tuple[str, ...] = ("close",)):
        self.size, self.columns = size, columns

    def open_state(self, handle) -> None:
        arrays = ", ".join(f"{c} array<double>" for c in self.columns)
        self.tail = handle.getValueState("tail", f"seen long, ts array<long>, {arrays}")

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        seen, *old = self.tail.get() if self.tail.exists() else (0, [], *[[] for _ in self.columns])
        new = [rows["ts"].astype("datetime64[us]").astype("int64"), *[rows[c] for c in self.columns]]
        kinds = [np.int64, *[np.float64] * len(self.columns)]
        both = [np.concatenate([np.asarray(o, k), n.to_numpy(k)]) for o, n, k in zip(old, new, kinds)]
        self.tail.update((int(seen) + len(rows), *[x[-self.size :].tolist() for x in both]))
        back = len(old[0])
        at = np.arange(len(both[0]))
        out = pd.DataFrame({"ts": pd.to_datetime(both[0], unit="us"), "pos": seen - back + at, "_own": at >= back})
        for name, values in zip(self.columns, both[1:]):
            out[name] = values
        return out.assign(**{k: rows[k].iloc[0] for k in SYMBOL})


class RangeState(_InOrder):
    """Wilder ATR and EWMA variance of returns per symbol from a handful of numbers."""

    def __init__(self, period: int = 14, lam: float = 0.94):
        self.period, self.lam = period, lam

    def open_state(self, handle) -> None:
        self.numbers = handle.getValueState("numbers", "n long, prev double, tr_sum double, atr double, var double")

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        n, prev, tr_sum, atr, var = self.numbers.get() if self.numbers.exists() else (0, 0.0, 0.0, 0.0, 0.0)
        atrs, variances = [], []
        for high, low, close in zip(rows["high"], rows["low"], rows["close"]):
            spread = high - low
            tr = spread if n == 0 else max(spread, abs(high - prev), abs(low - prev))
            if n < self.period:
                tr_sum += tr
                atr = tr_sum / self.period if n == self.period - 1 else 0.0
            else:
                atr = (atr * (self.period - 1) + tr) / self.period
            if n > 0:
                square = (close / prev - 1.0) ** 2
                var = square if n == 1 else self.lam * var + (1 - self.lam) * square
            n, prev = n + 1, float(close)
            atrs.append(atr if n >= self.period else None)
            variances.append(var if n > 1 else None)
        self.numbers.update((int(n), prev, float(tr_sum), float(atr), float(var)))
        return rows[[*SYMBOL, "ts"]].assign(
            atr=pd.array(atrs, dtype="Float64"), var=pd.array(variances, dtype="Float64")
        )


class JumpState(_InOrder):
    """Moves larger than the threshold against the last close of the symbol.

    Only positive closes have a move after them, unless ``positive`` is off: from a close of 0 it is infinite then.
    """

    def __init__(self, threshold: float = 0.5, positive: bool = True):
        self.threshold, self.positive = threshold, positive

    def open_state(self, handle) -> None:
        self.close_ = handle.getValueState("close", "c double")

    def step(self, rows: pd.DataFrame) -> pd.DataFrame:
        before = rows["close"].shift(1)
        if self.close_.exists():
            before.iloc[0] = self.close_.get()[0]
        self.close_.update((float(rows["close"].iloc[-1]),))
        move = rows["close"] / before - 1.0
        hits = (move.abs() > self.threshold) | ((before == 0) & (rows["close"] == 0))
        if self.positive:
            hits &= before > 0
        return rows.loc[hits, [*SYMBOL, "ts"]].assign(move=move[hits])


def _apply(bars: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    use_rocksdb(bars.sparkSession)
    return bars.groupBy(*SYMBOL).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None"
    )


KEYS = "market string, ticker string, ts timestamp"


def framed_stream(
    bars: DataFrame, step: tuple[int, Callable[[DataFrame, Frames], DataFrame]], columns: tuple[str, ...] = ("close",), name: str = "frames"
) -> Callable[[], DataFrame]:
    """A function that runs a step of window expressions (how far it looks back, and its columns) over what
    has arrived since it was last called, and returns the table written so far.

    Each batch is its own folder, so a repeated batch overwrites itself.
    """
    back, build = step
    spark = bars.sparkSession
    folder, checkpoint = run_folder(spark, name), run_folder(spark, f"{name}-state")
    doubles = ", ".join(f"{c} double" for c in columns)
    schema = f"ts timestamp, pos long, _own boolean, {doubles}, market string, ticker string"
    tails = _apply(bars.select(*SYMBOL, "ts", *columns), TailState(back, columns), schema)

    def run(batch: DataFrame, batch_id: int) -> None:
        built = build(batch, Frames(SYMBOL)).filter("_own").drop("_own")
        built.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    def drain() -> DataFrame:
        drain_batches(tails, name, run, checkpoint=checkpoint)
        return spark.read.parquet(folder + "/batch=*")

    return drain


def ranges(bars: DataFrame, period: int = 14, lam: float = 0.94) -> DataFrame:
    return _apply(bars.select(*SYMBOL, "ts", "high", "low", "close"), RangeState(period, lam), f"{KEYS}, atr double, var double")


def jumps(bars: DataFrame, threshold: float = 0.5, positive: bool = True) -> DataFrame:
    return _apply(bars.select(*SYMBOL, "ts", "close"), JumpState(threshold, positive), f"{KEYS}, move double")
