"""The recursive indicators of a series that is too long for one task, as a parallel scan.

Once it has begun, a smoothed mean is an affine map of its state: n candles take s to (1 - w)^n s + b. Maps compose, so
a series is cut into chunks of time that are worked on by themselves. One pass counts the chunks' candles and notes what the
next chunk needs of the one before; a second one finds each chunk's b, started from zero; chunks' maps are then applied one
after the other, a few numbers a chunk, which gives the state that each chunk begins with; the last pass feeds the chunks' candles to
the same kernel as a short series. The signal line depends on the two means that it is made of: their states enter its map as
geometric sums. The first candles, in which the means begin, are fed as they are; there are as many as the longest period.

A chunk is a range of open times, so candles on the grid fill one with `rows` at most; no step looks at a series as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.indicators import ADDED, PERIODS, SERIES, SeriesState, Smoother
from tidemark.functions.timeframes import duration
from tidemark.sources.tables import settled

#: Candles of a chunk.
ROWS = 100_000
CHUNK = [*SERIES, "chunk"]
CANDLE = ["open_ms", "open", "high", "low", "close", "volume"]


def smoothers(state: SeriesState) -> list[Smoother]:
    return [*state.emas, state.gain, state.loss, state.range, state.fast, state.slow, state.signal]


def dumped(state: SeriesState) -> list[float]:
    """The state as numbers: of each mean the candles seen, the sum so far and its value, and the last close."""
    return [v for s in smoothers(state) for v in (s.seen, s.total, np.nan if s.state is None else s.state)] + [state.last]


def restored(numbers: list[float], periods: dict) -> SeriesState:
    state = SeriesState(periods)
    for k, s in enumerate(smoothers(state)):
        s.seen, s.total, s.state = int(numbers[3 * k]), numbers[3 * k + 1], None if np.isnan(numbers[3 * k + 2]) else numbers[3 * k + 2]
    state.last = numbers[-1]
    return state


def head_rows(periods: dict) -> int:
    """Candles after which all means have begun."""
    return max(s.first + max(s.period, 0) for s in smoothers(SeriesState(periods)))


def from_zero(periods: dict, before: float) -> SeriesState:
    """A state in which all means have begun, at zero."""
    state = SeriesState(periods)
    for s in smoothers(state):
        s.seen, s.state = s.first + max(s.period, 0), 0.0 if s.period > 0 else None
    state.last = before
    return state


def geometric(ratio: float, weight: float, n: int) -> float:
    """What a mean of this weight gets, from zero, of ratio, ratio^2, ..., ratio^n."""
    rest = 1 - weight
    if abs(ratio - rest) < 1e-12:
        return n * weight * ratio**n
    return weight * ratio * (ratio**n - rest**n) / (ratio - rest)


def moved_on(state: SeriesState, n: int, ends: list[float], last: float) -> None:
    """state after n candles whose means, started from zero, ended in ends."""
    fast, slow, signal = state.fast, state.slow, state.signal
    linked = 0.0
    if None not in (fast.state, slow.state, signal.state):
        linked = geometric(1 - fast.weight, signal.weight, n) * fast.state - geometric(1 - slow.weight, signal.weight, n) * slow.state
    for s, b in zip(smoothers(state), ends):
        s.seen += n
        if s.state is not None:
            s.state = (1 - s.weight) ** n * s.state + b
    if signal.state is not None:
        signal.state += linked
    state.last = last


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Runs of rows of one chunk, and whether a run is the chunk's first."""
    known = None
    for b in batches:
        rows = b.to_pandas()
        if rows.empty:
            continue
        codes = rows.groupby(CHUNK, sort=False, dropna=False).ngroup().to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1), len(rows)]
        for a, z in zip(cuts, cuts[1:]):
            own = tuple(rows[c].iloc[a] for c in CHUNK)
            yield rows.iloc[a:z], own != known
            known = own


SERIES_TYPES = ", ".join(f"{c} string" for c in SERIES) + ", chunk long"


def indicators_in_chunks(candles: DataFrame, periods: dict = PERIODS, rows: int = ROWS) -> DataFrame:
    """Closed candles with the same columns as with_indicators gives."""
    head, halo = head_rows(periods), max(periods["volume"] - 1, 0)
    closed = candles.where("closed").select(*SERIES, *CANDLE)
    closed = closed.withColumn("chunk", F.floor(F.col("open_ms") / (duration(F.col("timeframe")) * rows)).cast("long"))
    by_chunk = W.partitionBy(*SERIES).orderBy("chunk")  # a row a chunk
    counts = closed.groupBy(*CHUNK).agg(F.count("*").alias("n"), F.max_by("close", "open_ms").alias("last"))
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(by_chunk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("before", F.lag("last").over(by_chunk))
    counts = settled(counts.withColumn("whole", F.sum("n").over(W.partitionBy(*SERIES))))

    def in_chunks(rows: DataFrame) -> DataFrame:
        """By a hash of the chunk: a repartitioning by the very keys of a join below it is taken for done already, and
        is then lost when that join turns out small enough to be broadcast."""
        return rows.repartition(F.xxhash64(*CHUNK)).sortWithinPartitions(*CHUNK, "open_ms")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each chunk: its first candles that belong to the head, its other candles' map, its last volumes."""
        out, state, at, last = [], None, 0, np.nan
        for run, new in pieces(batches):
            if new:
                out, state, at, last = out + [{c: run[c].iloc[0] for c in CHUNK} | {"head": [], "n": 0, "volumes": []}], None, int(run["start"].iloc[0]), run["before"].iloc[0]
            own = out[-1]
            first = max(0, min(head - at, len(run)))
            own["head"] += run[["high", "low", "close"]].iloc[:first].to_numpy().tolist()
            if first < len(run):
                if state is None:
                    # A batch may end where the head does: the close before is then that of the chunk's run before.
                    state = from_zero(periods, last if first == 0 else run["close"].iloc[first - 1])
                rest = run.iloc[first:]
                state.feed(*(rest[c].to_numpy() for c in ("high", "low", "close")))
                own["n"] += len(rest)
                own["ends"] = [0.0 if s.state is None else s.state for s in smoothers(state)]
            own["last"] = last = float(run["close"].iloc[-1])
            own["volumes"] = (own["volumes"] + run["volume"].tolist())[-halo:] if halo else []
            at += len(run)
        if out:
            names = [*CHUNK, "head", "n", "ends", "last", "volumes"]
            yield pa.RecordBatch.from_pylist([{k: o.get(k) for k in names} for o in out], pa.schema([(c, pa.string()) for c in SERIES] + [("chunk", pa.int64()), ("head", pa.list_(pa.list_(pa.float64()))), ("n", pa.int64()), ("ends", pa.list_(pa.float64())), ("last", pa.float64()), ("volumes", pa.list_(pa.float64()))]))

    def states(group: pd.DataFrame) -> pd.DataFrame:
        """The state that each chunk of a series begins with; a row a chunk."""
        state, volumes, out = SeriesState(periods), [], []
        for c in group.sort_values("chunk").itertuples(index=False):
            out.append((c.chunk, dumped(state), list(volumes)))
            if len(c.head):
                high, low, close = np.array([list(x) for x in c.head]).T
                state.feed(high, low, close)
            if c.n:
                moved_on(state, int(c.n), list(c.ends), c.last)
            volumes = (volumes + list(c.volumes))[-halo:] if halo else []
        found = pd.DataFrame(out, columns=["chunk", "state", "volumes"])
        for k, c in enumerate(SERIES):
            found.insert(k, c, group[c].iloc[0])
        return found

    maps = in_chunks(closed.join(counts.select(*CHUNK, "start", "before"), CHUNK)).mapInArrow(summaries, f"{SERIES_TYPES}, head array<array<double>>, n long, ends array<double>, last double, volumes array<double>")
    begun = maps.groupBy(*SERIES).applyInPandas(states, f"{SERIES_TYPES}, state array<double>, volumes array<double>")
    begun = settled(begun.join(counts.select(*CHUNK, "start", "whole"), CHUNK))
    # A chunk's state stands in its first row only.
    first = closed.groupBy(*CHUNK).agg(F.min("open_ms").alias("_at"))
    begun = begun.join(first, CHUNK)
    given = [F.when(F.col("open_ms") == F.col("_at"), F.col(c)).alias(c) for c in ("state", "volumes")]
    ready = in_chunks(closed.join(begun, CHUNK).select(*CHUNK, *CANDLE, "whole", *given))
    period = periods["volume"]

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, volumes = None, []
        for run, new in pieces(batches):
            if new:
                state, volumes = restored(list(run["state"].iloc[0]), periods), list(run["volumes"].iloc[0])
            made = state.feed(*(run[c].to_numpy() for c in ("high", "low", "close")))
            known = np.array(volumes + run["volume"].tolist())
            mean = np.full(len(run), np.nan)
            if 0 < period <= len(known):
                means = np.lib.stride_tricks.sliding_window_view(known, period).mean(axis=1)
                mean[len(run) - min(len(means), len(run)) :] = means[-len(run) :]
            volumes = known[-halo:].tolist() if halo else []
            columns = [pa.array(run[c], pa.string()) for c in SERIES] + [pa.array(run[c].to_numpy()) for c in CANDLE]
            columns += [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (*made, mean)] + [pa.array(run["whole"].to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, [*SERIES, *CANDLE, *ADDED, "volume_mean", "whole"])

    kind = ", ".join(f"{c} string" for c in SERIES) + ", open_ms long, " + ", ".join(f"{c} double" for c in (*CANDLE[1:], *ADDED, "volume_mean")) + ", whole long"
    out = ready.mapInArrow(finished, kind)
    enough = F.col("whole") >= periods["macd"][1] + periods["macd"][2]
    for c in ("macd", "macd_signal", "macd_hist"):
        out = out.withColumn(c, F.when(enough, F.col(c)))
    out = out.withColumn("volume_ratio", F.when(F.col("volume_mean") > 0, F.col("volume") / F.col("volume_mean")))
    return out.select(*SERIES, *CANDLE, *ADDED, "volume_mean", "volume_ratio")
