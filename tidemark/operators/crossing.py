"""When a series first goes beyond a price: for many prices and starting points at once, without pairing each with all later
candles.

A series is cut into chunks of ROWS candles. Within a chunk a table of the highest values of all runs of 1, 2, 4, ... candles
answers a probe in as many steps as that table has rows, all probes together. A probe that finds nothing goes on to the first
later chunk whose highest value is beyond its price, found in the same way among the chunks' highest values, and
is answered there. So n candles and probes take n log n steps, a task holds one chunk, and none a series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import SERIES
from tidemark.sources.tables import settled

#: Candles of a chunk.
ROWS = 1 << 16
SERIES_TYPES = ", ".join(f"{c} string" for c in SERIES)


def probe(name: str, value: str, above: bool | Column, strict: bool, price: Column) -> Column:
    """The first candle whose `value` is above (or else below) a price; not strict: or on it."""
    return F.struct(F.lit(name).alias("name"), F.lit(value).alias("value"), (above if isinstance(above, Column) else F.lit(above)).alias("above"), F.lit(strict).alias("strict"), price.cast("double").alias("price"))


class Highest:
    """Highest values of all runs of a power of two. Nan counts as lowest."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [np.where(np.isnan(values), -np.inf, values)]
        while 1 << len(self.levels) <= self.n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def first(self, starts: np.ndarray, prices: np.ndarray, strict: np.ndarray) -> np.ndarray:
        """For each probe the least place from its start on whose value is beyond its price; the number of values if
        there is none. The way there is taken in powers of two, largest first."""
        at = np.minimum(starts, self.n)
        for k in reversed(range(len(self.levels))) if self.n else ():
            level = self.levels[k]
            top = level[np.minimum(at, len(level) - 1)]
            at = np.where((at < len(level)) & ~np.where(strict, top > prices, top >= prices), at + (1 << k), at)
        return at

    def rest(self) -> np.ndarray:
        """The highest value from each place on, the end included."""
        return np.append(np.maximum.accumulate(self.levels[0][::-1])[::-1], -np.inf)


def answered(values: pd.DataFrame, starts: np.ndarray, probes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places for probes (value, above, strict, price), each from its start on, and the most extreme value from there on."""
    places, extremes = np.empty(len(probes), np.int64), np.empty(len(probes))
    for (name, above), some in probes.groupby(["value", "above"], sort=False).indices.items():
        sign, own = (1.0 if above else -1.0), probes.iloc[some]
        table = Highest(sign * values[name].to_numpy(float))
        places[some] = table.first(starts[some], sign * own["price"].to_numpy(float), own["strict"].to_numpy(bool))
        extremes[some] = sign * table.rest()[np.minimum(starts[some], table.n)]
    return places, extremes


def first_crossings(rows: DataFrame, probes: DataFrame, key: list[str], names: list[str], size: int = ROWS) -> DataFrame:
    """SERIES, key, name, found_i, found_ms and extreme of each probe: the first candle after from_i that is beyond its price
    (null if none is), and if there is none the most extreme value after from_i (null if there is no candle).

    rows: a settled table of SERIES, i (gapless), close_ms and the values, of which names are those that probes ask for;
    probes: SERIES, key, from_i, probe (a struct of `probe`)."""
    rows = rows.select(*SERIES, "i", "close_ms", *names).withColumn("chunk", F.floor(F.col("i") / size))
    # Under other names: probes that were made of rows have the very same columns, which no cogroup can tell apart.
    keys, of = [f"key_{c}" for c in key], [f"of_{c}" for c in SERIES]
    asked = probes.select(*[F.col(c).alias(k) for c, k in zip([*SERIES, *key], [*of, *keys])], "probe.*", (F.col("from_i") + 1).cast("long").alias("start")).withColumn("chunk", F.floor(F.col("start") / size)).withColumnRenamed("chunk", "to")
    kinds = dict(asked.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in asked.columns) + ", found_i long, found_ms long, extreme double"

    def in_chunk(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        low = int(rows["i"].iloc[0]) if len(rows) else 0
        places, extremes = answered(rows, np.maximum(asked["start"].to_numpy() - low, 0), asked) if len(asked) else (np.empty(0, int), np.empty(0))
        hit = places < len(rows)
        at = np.where(hit, places, 0)
        found = lambda c: pd.array(np.where(hit, rows[c].to_numpy()[at], 0) if len(rows) else np.zeros(len(asked), int), "Int64")
        out = asked.assign(found_i=found("i"), found_ms=found("close_ms"), extreme=np.where(np.isinf(extremes), np.nan, extremes))
        out.loc[~hit, ["found_i", "found_ms"]] = pd.NA
        return out

    def local(asked: DataFrame) -> DataFrame:
        return asked.groupBy(*of, "to").cogroup(rows.groupBy(*SERIES, "chunk")).applyInPandas(in_chunk, schema)

    real = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    result = [*[F.col(k).alias(c) for c, k in zip([*SERIES, *key], [*of, *keys])], "name", "found_i", "found_ms", "extreme"]
    own = local(asked).withColumn("extreme", real("extreme"))
    if (rows.agg(F.max("chunk")).first()[0] or 0) == 0:
        return own.select(*result)
    own = settled(own)
    tops = rows.groupBy(*SERIES, "chunk").agg(*[f(real(c)).alias(f"{c}_{n}") for c in names for n, f in (("max", F.max), ("min", F.min))])

    def next_chunk(asked: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        """The first later chunk with a value beyond the price takes the probe; `start` is its first candle."""
        tops = tops.sort_values("chunk")
        chunks = tops["chunk"].to_numpy()
        highs = tops.rename(columns={f"{c}_max": c for c in names})
        lows = tops.rename(columns={f"{c}_min": c for c in names})
        starts, out = np.searchsorted(chunks, asked["to"].to_numpy(), side="right"), asked.copy()
        for above, values in ((True, highs), (False, lows)):
            some = np.flatnonzero(asked["above"].to_numpy() == above)
            if len(some):
                places, extremes = answered(values, starts[some], asked.iloc[some])
                hit, far = places < len(chunks), (np.fmax if above else np.fmin)(asked["extreme"].to_numpy(float)[some], np.where(np.isinf(extremes), np.nan, extremes))
                target = chunks[np.where(hit, places, 0)] if len(chunks) else np.zeros(len(some), int)
                out.iloc[some, out.columns.get_loc("to")] = np.where(hit, target, -1)
                out.iloc[some, out.columns.get_loc("start")] = np.where(hit, target * size, -1)
                out.iloc[some, out.columns.get_loc("extreme")] = far
        return out

    open_ = own.where("found_i is null").drop("found_i", "found_ms")
    moved = settled(open_.groupBy(*of).cogroup(tops.groupBy(*SERIES)).applyInPandas(next_chunk, ", ".join(f"{c} {t}" for c, t in open_.dtypes)))
    moved = moved.withColumn("extreme", real("extreme"))
    none = F.lit(None).cast("long")
    later = local(moved.where("to >= 0").select(*asked.columns)).withColumn("extreme", F.lit(None).cast("double"))
    never = moved.where("to < 0").withColumns({"found_i": none, "found_ms": none}).select(*result)
    return own.where("found_i is not null").select(*result).unionByName(later.select(*result)).unionByName(never)
