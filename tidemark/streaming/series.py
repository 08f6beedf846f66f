"""Indicators and breaks of structure of a stream of candles, with what they carry kept in Spark's state store.

Each series has one state, a few numbers (and of its candles those that a pivot may still depend on), so a batch
costs what its own candles cost, however long the series is. However the stream is cut into batches, and wherever it is
stopped and started again, the rows are those of the whole series in one piece. Candles of a batch are put in order of
time; one that is not newer than the last one of its series is late and has no part in it, as the table's cut has it.

The state store must be RocksDB (`stateful` sets it); states are versioned with the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.indicators import ADDED, PERIODS, SERIES, SeriesState
from tidemark.functions.scan import dumped, restored
from tidemark.functions.timeframes import DURATION_MS
from tidemark.operators.structure import EVENTS, SERIES_TYPES, Breaks

CANDLE = ["open_ms", "open", "high", "low", "close", "volume"]
INDICATORS = SERIES_TYPES + "open_ms long, " + ", ".join(f"{c} double" for c in (*CANDLE[1:], *ADDED, "volume_mean", "volume_ratio"))


def stateful(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class OfSeries(StatefulProcessor):
    """What processors of a series share: the state as JSON, candles in order, late ones left out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", "json string")

    def close(self) -> None:
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = json.loads(self.state.get()[0]) if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values("open_ms").drop_duplicates("open_ms", keep="last")
        if known is not None:
            batch = batch[batch["open_ms"] > known["newest_ms"]]
        if len(batch):
            out, known = self.advanced(known, batch)
            known["newest_ms"] = int(batch["open_ms"].iloc[-1])
            self.state.update((json.dumps(known),))
            if len(out):
                for k, (c, v) in enumerate(zip(SERIES, key)):
                    out.insert(k, c, v)
                yield out

    def advanced(self, known: dict | None, batch: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
        """Rows for a batch of candles in order, and what is known after it."""
        raise NotImplementedError


class Indicators(OfSeries):
    def __init__(self, periods: dict = PERIODS):
        self.periods = periods

    def advanced(self, known: dict | None, batch: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
        periods = self.periods
        known = known or {"state": None, "volumes": [], "n": 0}
        state = restored([np.nan if v is None else v for v in known["state"]], periods) if known["state"] else SeriesState(periods)
        made = state.feed(*(batch[c].to_numpy(float) for c in ("high", "low", "close")))
        period, volumes = periods["volume"], known["volumes"] + batch["volume"].tolist()
        mean = np.full(len(batch), np.nan)
        if 0 < period <= len(volumes):
            means = np.lib.stride_tricks.sliding_window_view(np.array(volumes), period).mean(axis=1)[-len(batch) :]
            mean[len(batch) - len(means) :] = means
        out = batch[CANDLE].reset_index(drop=True).assign(**dict(zip(ADDED, made)), volume_mean=mean)
        out["volume_ratio"] = np.where(mean > 0, out["volume"] / np.where(mean > 0, mean, 1.0), np.nan)
        # The line counts from the candle on with which there are enough for its signal.
        few = np.arange(known["n"] + 1, known["n"] + 1 + len(batch)) < periods["macd"][1] + periods["macd"][2]
        out.loc[few, ["macd", "macd_signal", "macd_hist"]] = np.nan
        numbers = [None if isinstance(v, float) and np.isnan(v) else float(v) for v in dumped(state)]
        return out, {"state": numbers, "volumes": volumes[-(period - 1) :] if period > 1 else [], "n": known["n"] + len(batch)}


class Structure(OfSeries):
    """Events of a layer of `left` and `right` candles. After an ambiguous break a series has no further events."""

    def __init__(self, left: int, right: int):
        self.left, self.right = left, right

    def pivot(self, bars: list[dict], kind: str) -> tuple | None:
        """The plateau that the newest bar confirms, if it does: (event time, price)."""
        field, sign = ("high", 1) if kind == "high" else ("low", -1)
        end = len(bars) - 1 - self.right
        if end < 0:
            return None
        v = lambda k: sign * bars[k][field]
        if self.right and v(end + 1) == v(end):
            return None
        first = end
        while first > 0 and v(first - 1) == v(end):
            first -= 1
        if first < self.left or bars[first]["i"] < self.left or (self.left and max(v(k) for k in range(first - self.left, first)) >= v(end)):
            return None
        if self.right and max(v(k) for k in range(end + 1, len(bars))) >= v(end):
            return None
        return bars[first]["open_ms"], bars[first][field]

    def trimmed(self, bars: list[dict]) -> list[dict]:
        """The bars that later pivots may need: `left` ones before the plateaus that are still open, and all after."""
        from_ = max(len(bars) - self.right, 0)
        for field in ("high", "low"):
            k = max(len(bars) - max(self.right, 1), 0)
            while k > 0 and bars[k - 1][field] == bars[k][field]:
                k -= 1
            from_ = min(from_, k)
        return bars[max(from_ - self.left, 0) :]

    def advanced(self, known: dict | None, batch: pd.DataFrame) -> tuple[pd.DataFrame, dict]:
        known = known or {"bars": [], "n": 0, "levels": {"up": [], "down": []}, "trend": None, "pending": None, "last": {"up": -1, "down": -1}, "over": False}
        state, bars, n = Breaks(), known["bars"], known["n"]
        state.levels = {s: [tuple(x) for x in v] for s, v in known["levels"].items()}
        state.trend, state.last = known["trend"], known["last"]
        state.pending = known["pending"] and (known["pending"][0], tuple(known["pending"][1]), known["pending"][2])
        for bar in batch.itertuples(index=False):
            if known["over"]:
                break
            bars.append({"i": n, "open_ms": int(bar.open_ms), "high": float(bar.high), "low": float(bar.low)})
            n += 1
            for kind, side in (("high", "up"), ("low", "down")):
                if found := self.pivot(bars, kind):
                    state.levels[side].append((int(bar.close_ms), *found))
            bars = self.trimmed(bars)
            try:
                state.step(bar)
            except ValueError:
                state.events.append(("AMBIGUOUS", None, None, None, bar.open_ms, bar.close_ms, None, None))
                known["over"] = True
        out = pd.DataFrame(state.events, columns=[f.split()[0] for f in EVENTS.split(", ")], dtype=object)
        pending = state.pending and [state.pending[0], list(state.pending[1]), int(state.pending[2])]
        return out, {"bars": bars, "n": n, "levels": state.levels, "trend": state.trend, "pending": pending, "last": state.last, "over": known["over"]}


def closed_ones(candles: DataFrame) -> DataFrame:
    width = F.lit(None).cast("long")
    for t, w in DURATION_MS.items():
        width = F.when(F.col("timeframe") == t, w).otherwise(width)
    return candles.where("closed").select(*SERIES, *CANDLE, (F.col("open_ms") + width).alias("close_ms"))


def indicator_stream(candles: DataFrame, periods: dict = PERIODS) -> DataFrame:
    """with_indicators over a stream; the line and its signal begin with the first candle that has enough before it."""
    stateful(candles.sparkSession)
    return closed_ones(candles).groupBy(*SERIES).transformWithStateInPandas(Indicators(periods), INDICATORS, "Append", "None")


def structure_stream(candles: DataFrame, left: int, right: int) -> DataFrame:
    """structure_events over a stream."""
    stateful(candles.sparkSession)
    return closed_ones(candles).groupBy(*SERIES).transformWithStateInPandas(Structure(left, right), SERIES_TYPES + EVENTS, "Append", "None")
