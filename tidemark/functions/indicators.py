"""Indicators over one ordered series of closed candles: SMA, EMA, RSI, MACD, ATR and volume ratio.

What looks back a fixed number of rows is a window expression. What carries a state from the first row on (EMA, RSI,
MACD, ATR) is fed a series' rows in order of time, Arrow batch after batch: a task holds one batch and a few numbers of
state, however long the series. It starts at the first row it is given, so cut first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a series is: one market and one timeframe.
SERIES = ["exchange", "symbol", "timeframe"]
#: Periods of a snapshot.
EMA_PERIODS, RSI, MACD, ATR, VOLUME = (20, 50, 200), 14, (12, 26, 9), 14, 20
PERIODS = {"ema": EMA_PERIODS, "rsi": RSI, "macd": MACD, "atr": ATR, "volume": VOLUME}


def minimum_candles(periods: dict = PERIODS) -> int:
    """Closed candles that an analysis takes."""
    return max(periods["ema"][2], periods["rsi"] + 1, periods["macd"][1] + periods["macd"][2], periods["atr"] + 1, periods["volume"])


def by_time() -> W:
    return W.partitionBy(*SERIES).orderBy("open_ms")


def sma(value: str, period: int) -> Column:
    """Mean of the last `period` rows; null before there are as many, and for no period."""
    if period <= 0:
        return F.lit(None).cast("double")
    return F.when(F.row_number().over(by_time()) >= period, F.avg(value).over(by_time().rowsBetween(1 - period, 0)))


def true_range() -> Column:
    before = F.lag("close").over(by_time())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


class Smoother:
    """Values that come in pieces, smoothed: NaN up to first + period - 1, there the mean of the first `period` values
    from `first` on, then state + (x - state) * weight."""

    def __init__(self, first: int, period: int, weight: float):
        self.first, self.period, self.weight = first, period, weight
        self.seen, self.total, self.state = 0, 0.0, None

    def feed(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        at, seed = 0, self.first + self.period - 1 - self.seen  # where the mean stands, from here
        if self.state is None and self.period > 0:
            early = x[max(self.first - self.seen, 0) : max(seed + 1, 0)]
            self.total += float(early.sum())
            at = len(x)
            if seed < len(x):
                self.state, at = self.total / self.period, seed + 1
                out[seed] = self.state
        if self.state is not None and at < len(x):
            weight = self.weight
            values = list(accumulate(x[at:].tolist(), lambda s, v: s + (v - s) * weight, initial=self.state))
            out[at:], self.state = values[1:], values[-1]
        self.seen += len(x)
        return out


def smoothed(x: np.ndarray, first: int, period: int, weight: float) -> np.ndarray:
    return Smoother(first, period, weight).feed(x)


def ema(x: np.ndarray, period: int, first: int = 0) -> np.ndarray:
    return smoothed(x, first, period, 2 / (period + 1))


def wilder(x: np.ndarray, period: int) -> np.ndarray:
    """Wilder's mean of values that begin at index 1."""
    return smoothed(x, 1, period, 1 / period)


def rsi(close: np.ndarray, period: int = RSI) -> np.ndarray:
    moves = np.diff(close, prepend=np.nan)
    gain, loss = wilder(np.maximum(moves, 0), period), wilder(np.maximum(-moves, 0), period)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))


def macd(close: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray]:
    if len(close) < slow + signal:
        return np.full(len(close), np.nan), np.full(len(close), np.nan)
    line = ema(close, fast) - ema(close, slow)
    return line, ema(line, signal, slow - 1)


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, period: int = ATR) -> np.ndarray:
    before = np.concatenate([[np.nan], close[:-1]])
    return wilder(np.maximum(high - low, np.maximum(abs(high - before), abs(low - before))), period)


ADDED = ("ema20", "ema50", "ema200", "rsi14", "macd", "macd_signal", "macd_hist", "atr14")


class SeriesState:
    """All recursive indicators of one series, fed piece by piece."""

    def __init__(self, periods: dict):
        fast, slow, signal = periods["macd"]
        mean = lambda p, first=0: Smoother(first, p, 2 / (p + 1))
        wilder = lambda p: Smoother(1, p, 1 / p)
        self.emas = [mean(p) for p in periods["ema"]]
        self.fast, self.slow, self.signal = mean(fast), mean(slow), mean(signal, slow - 1)
        self.gain, self.loss, self.range = wilder(periods["rsi"]), wilder(periods["rsi"]), wilder(periods["atr"])
        self.last = np.nan

    def feed(self, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> list[np.ndarray]:
        """The columns ADDED."""
        before = np.concatenate([[self.last], close[:-1]])
        self.last = close[-1]
        moves = close - before
        gain, loss = self.gain.feed(np.maximum(moves, 0)), self.loss.feed(np.maximum(-moves, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / loss))
        line = self.fast.feed(close) - self.slow.feed(close)
        signal = self.signal.feed(line)
        true_range = np.maximum(high - low, np.maximum(abs(high - before), abs(low - before)))
        return [*[e.feed(close) for e in self.emas], rsi, line, signal, line - signal, self.range.feed(true_range)]


def with_indicators(candles: DataFrame, periods: dict = PERIODS) -> DataFrame:
    """Closed candles with their recursive indicators and the volume's mean and ratio; one shuffle, by series.

    Columns keep the names of the standard periods, whatever periods stand behind them."""
    columns = [*SERIES, "open_ms", "open", "high", "low", "close", "volume"]
    closed = candles.where("closed").select(*columns).repartition(*SERIES).sortWithinPartitions(*SERIES, "open_ms")
    enough = F.count("*").over(W.partitionBy(*SERIES)) >= periods["macd"][1] + periods["macd"][2]
    rows = closed.withColumn("volume_mean", sma("volume", periods["volume"])).withColumn("_enough", enough)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            names = [t.column(c).combine_chunks().dictionary_encode() for c in SERIES]
            codes = np.column_stack([n.indices.to_numpy() if isinstance(n, pa.DictionaryArray) else n.chunk(0).indices.to_numpy() for n in names])
            cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)) + 1), len(codes)]
            high, low, close = (t.column(c).to_numpy() for c in ("high", "low", "close"))
            made = []
            for a, z in zip(cuts, cuts[1:]):
                own = tuple(t.column(c)[a].as_py() for c in SERIES)
                if own != key:
                    key, state = own, SeriesState(periods)
                made.append(state.feed(high[a:z], low[a:z], close[a:z]))
            for name, parts in zip(ADDED, zip(*made)):
                values = np.concatenate(parts)
                t = t.append_column(name, pa.array(values, pa.float64(), mask=np.isnan(values)))  # what is not there yet is null
            yield from t.combine_chunks().to_batches()

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + "".join(f", {c} double" for c in ADDED))
    for c in ("macd", "macd_signal", "macd_hist"):
        out = out.withColumn(c, F.when(F.col("_enough"), F.col(c)))
    out = out.withColumn("volume_ratio", F.when(F.col("volume_mean") > 0, F.col("volume") / F.col("volume_mean")))
    return out.select(*columns, *ADDED, "volume_mean", "volume_ratio")


def snapshots(candles: DataFrame, history: int = 300, minimum: int = 200) -> DataFrame:
    """The indicators at the newest closed candle of each series, from its newest `history` candles; only for series
    with at least `minimum`."""
    from tidemark.operators.paging import latest_per_group, newest_per_group

    cut = newest_per_group(candles.where("closed"), SERIES, "open_ms", history)
    enough = F.count("*").over(W.partitionBy(*SERIES)) >= minimum
    return latest_per_group(with_indicators(cut.withColumn("_enough", enough).where("_enough")), SERIES, "open_ms")
