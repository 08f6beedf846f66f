"""Price structure: pivots, displacements, fair value gaps, breaks of structure, and dealing ranges.

All look at closed candles of one series (exchange, symbol, timeframe) up to a horizon. What compares a row with its
neighbours is a window or a join bounded by the series' cut; the break-of-structure states, where each step depends
on all before, run as a grouped kernel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.indicators import SERIES, by_time, with_indicators
from tidemark.functions.timeframes import duration
from tidemark.operators.crossing import ROWS, first_crossings, probe
from tidemark.operators.paging import newest_per_group

#: Candles of a series that an evaluation looks at.
CUT = 500


def horizon(candles: DataFrame, as_of_ms: int | None = None, cut: int = CUT) -> DataFrame:
    """The newest `cut` closed candles that are over at as_of_ms, numbered from 0, with their close time."""
    over = candles.where("closed").withColumn("close_ms", F.col("open_ms") + duration(F.col("timeframe")))
    over = over if as_of_ms is None else over.where(F.col("close_ms") <= as_of_ms)
    return newest_per_group(over, SERIES, "open_ms", cut).withColumn("i", F.row_number().over(by_time()) - 1)


def pivots(rows: DataFrame, left: int, right: int, side: str) -> DataFrame:
    """Plateaus of equal highs (lows) that stand strictly above (below) `left` rows before and `right` rows after.

    A plateau is dated at its first row and confirmed when the last of the `right` rows closes."""
    value = F.col("high") if side == "high" else -F.col("low")
    rows = rows.withColumn("v", value)
    fresh = F.coalesce(F.col("v") != F.lag("v").over(by_time()), F.lit(True))
    rows = rows.withColumn("plateau", F.sum(fresh.cast("int")).over(by_time()))
    rows = rows.select(
        *SERIES, "i", "open_ms", "v", "plateau",
        F.max("v").over(by_time().rowsBetween(-left, -1)).alias("before"), F.max("v").over(by_time().rowsBetween(1, right)).alias("after"),
        F.lead("close_ms", right).over(by_time()).alias("confirmed_ms"),
    )
    flat = rows.groupBy(*SERIES, "plateau").agg(
        F.min("i").alias("first"), F.min("open_ms").alias("event_ms"), F.first("v").alias("v"),
        F.min_by("before", "i").alias("before"), F.max_by("after", "i").alias("after"), F.max_by("confirmed_ms", "i").alias("confirmed_ms"),
    )
    found = flat.where((F.col("first") >= left) & F.col("confirmed_ms").isNotNull() & (F.col("v") > F.col("before")) & (F.col("v") > F.col("after")))
    price = F.col("v") if side == "high" else -F.col("v")
    return found.select(*SERIES, F.lit(side).alias("kind"), price.alias("price"), "event_ms", "confirmed_ms")


def both_pivots(rows: DataFrame, left: int, right: int) -> DataFrame:
    return pivots(rows, left, right, "high").unionByName(pivots(rows, left, right, "low"))


def displacements(rows: DataFrame, body: float = 1.5, span: float = 2.0, bull: float = 0.6, bear: float = 0.4) -> DataFrame:
    """Candles whose body and range are large against the ATR and that close near their end. rows: with_indicators."""
    reach = F.col("high") - F.col("low")
    rows = rows.where(F.col("atr14").isNotNull()).select(
        *SERIES, "open_ms", "open", "close", (F.abs(F.col("close") - F.col("open")) / F.col("atr14")).alias("body_atr"), (reach / F.col("atr14")).alias("range_atr"),
        F.when(reach == 0, 0.5).otherwise((F.col("close") - F.col("low")) / reach).alias("close_location"),
    )
    large = (F.col("body_atr") >= body) & (F.col("range_atr") >= span)
    up = large & (F.col("close") > F.col("open")) & (F.col("close_location") >= bull)
    down = large & (F.col("close") < F.col("open")) & (F.col("close_location") <= bear)
    return rows.withColumn("direction", F.when(up, "up").when(down, "down")).where("direction is not null").select(*SERIES, "open_ms", "direction", "body_atr", "range_atr", "close_location")


def gaps(rows: DataFrame, least: float = 0.1) -> DataFrame:
    """Three-candle gaps of at least `least` ATR, dated at the middle candle. rows: with indicators, i and close_ms."""
    high, low = F.lag("high", 2).over(by_time()), F.lag("low", 2).over(by_time())
    rows = rows.select(*SERIES, "i", "close_ms", "atr14", F.lag("open_ms").over(by_time()).alias("event_ms"), F.when(F.col("low") > high, "up").when(F.col("high") < low, "down").alias("direction"), F.when(F.col("low") > high, high).otherwise(F.col("high")).alias("bottom"), F.when(F.col("low") > high, F.col("low")).otherwise(low).alias("top"))
    rows = rows.where("direction is not null and atr14 is not null")
    return rows.withColumn("size_atr", (F.col("top") - F.col("bottom")) / F.col("atr14")).where(F.col("size_atr") >= least)


def gap_lives(rows: DataFrame, found: DataFrame, age: int = 500, size: int = ROWS) -> DataFrame:
    """What later candles do to each gap, up to the first that closes beyond it: touched, half and fully filled,
    invalidated; expired after `age` candles unless ever invalidated. Each is the first candle beyond a price; a close beyond
    the gap has filled it, so that none of them can be later than the invalidation. rows: settled."""
    up = F.col("direction") == "up"
    near, far = F.when(up, F.col("top")).otherwise(F.col("bottom")), F.when(up, F.col("bottom")).otherwise(F.col("top"))
    half = (F.col("bottom") + F.col("top")) / 2
    reach = lambda name, strict, price: [F.when(up, probe(name, "low", False, strict, price)).otherwise(probe(name, "high", True, strict, price))]
    closes = F.when(up, probe("invalidated", "close", False, True, far)).otherwise(probe("invalidated", "close", True, True, far))
    asked = found.select(*SERIES, "i", F.col("i").alias("from_i"), F.explode(F.array(*reach("touched", True, near), *reach("half", False, half), *reach("filled", False, far), closes)).alias("probe"))
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("found_ms")))
    names = ["touched", "half", "filled", "invalidated"]
    lives = first_crossings(rows, asked, ["i"], ["high", "low", "close"], size).groupBy(*SERIES, "i").agg(*[at(n).alias(f"{n}_ms") for n in names], F.max(F.when(F.col("name") == "filled", F.col("extreme"))).alias("reached"))
    ends = rows.select(*SERIES, F.col("i").alias("expiry_i"), F.col("close_ms").alias("expiry_ms"))
    out = found.join(lives, [*SERIES, "i"], "left").withColumn("expiry_i", F.col("i") + age).join(ends, [*SERIES, "expiry_i"], "left")
    depth = F.abs(near - F.col("reached")) / (F.col("top") - F.col("bottom"))
    inside = F.when(up, F.col("reached") < near).otherwise(F.col("reached") > near)
    fill = F.when(F.col("filled_ms").isNotNull(), 1.0).when(inside, F.least(F.lit(1.0), depth)).otherwise(0.0)
    expired = F.when(F.col("invalidated_ms").isNull() & F.lit(age > 0), F.col("expiry_ms"))
    state = F.when(F.col("invalidated_ms").isNotNull(), "INVALIDATED").when(F.col("expired_ms").isNotNull(), "EXPIRED").when(F.col("filled_ms").isNotNull(), "FILLED").when(F.col("half_ms").isNotNull(), "CE").when(F.col("touched_ms").isNotNull(), "TOUCHED").otherwise("OPEN")
    due = F.when(F.lit(age > 0), F.col("expiry_ms")).alias("due_ms")  # the expiry, whatever came of the gap later
    out = out.withColumn("expired_ms", expired).withColumn("state", state).withColumn("fill", fill)
    return out.select(*SERIES, "event_ms", F.col("close_ms").alias("confirmed_ms"), "direction", "bottom", "top", "size_atr", "touched_ms", "half_ms", "filled_ms", "invalidated_ms", "expired_ms", "fill", "state", due)


SERIES_TYPES = ", ".join(f"{c} string" for c in SERIES) + ", "
EVENTS = "type string, dir string, level double, level_ms long, event_ms long, confirmed_ms long, anchor_price double, anchor_ms long"


def of_series(out: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    """out with the columns that name the series of rows in front."""
    for c in reversed(SERIES):
        out.insert(0, c, rows[c].iloc[0])
    return out


class Breaks:
    """State of one series: levels of both sides, and the trend they make.

    A level is (confirmed, event, price), and of those available the greatest is aimed at: the last confirmed, then
    the later, then the higher. A level is used up by the event that breaks it."""

    def __init__(self) -> None:
        self.levels: dict[str, list[tuple]] = {"up": [], "down": []}
        self.trend: str | None = None
        self.pending: tuple | None = None
        self.last = {"up": -1, "down": -1}
        self.events: list[tuple] = []

    def aim(self, side: str, least: int = -1) -> tuple | None:
        return max((x for x in self.levels[side] if x[0] >= least), default=None)

    def emit(self, kind: str, side: str, level: tuple, bar) -> None:
        """Notes the event with the level it is protected by, then uses the level up."""
        anchor = None
        if kind == "BOS":
            anchor = self.aim("down" if side == "up" else "up")
        elif kind == "CHOCH":
            anchor = self.aim(side)
        self.events.append((kind, side, level[2], level[1], bar.open_ms, bar.close_ms, anchor and anchor[2], anchor and anchor[1]))
        if kind != "CHOCH_INVALIDATED":
            self.levels[side].remove(level)
        if kind == "BOS":
            self.last[side] = level[0]
            self.trend, self.pending = side, None

    def step(self, bar) -> None:
        """One event at most for a candle."""
        up, other = {"up": 1, "down": -1}, {"up": "down", "down": "up"}

        def beyond(side: str, level: tuple | None) -> bool:
            return level is not None and (bar.close - level[2]) * up[side] > 0

        if self.pending:  # a trend was broken: confirmed by a level newer than the break, or taken back
            side, level, since = self.pending
            if beyond(other[side], level):
                self.emit("CHOCH_INVALIDATED", other[side], level, bar)
                self.trend, self.pending = other[side], None
            elif beyond(side, target := self.aim(side, since + 1)):
                self.emit("BOS", side, target, bar)
        elif self.trend is None:
            if self.levels["up"] and self.levels["down"]:
                hits = [s for s in ("up", "down") if beyond(s, self.aim(s))]
                if len(hits) == 2:
                    raise ValueError("ambiguous break")
                if hits:
                    self.emit("BOS", hits[0], self.aim(hits[0]), bar)
        else:
            side = self.trend
            on, back = self.aim(side, self.last[side]), self.aim(other[side])
            if beyond(side, on) and beyond(other[side], back):
                raise ValueError("ambiguous break")
            if beyond(side, on):
                self.emit("BOS", side, on, bar)
            elif beyond(other[side], back):
                self.emit("CHOCH", other[side], back, bar)
                self.trend, self.pending = None, (other[side], back, bar.close_ms)


def structure_events(rows: DataFrame, left: int, right: int) -> DataFrame:
    """Breaks of structure (BOS), changes of character (CHOCH) and their invalidations. A level counts from the close
    that confirms it on, that candle included. A series with a break both ways has an AMBIGUOUS row instead."""
    found = both_pivots(rows, left, right).groupBy(*SERIES, F.col("confirmed_ms").alias("close_ms")).agg(F.collect_list(F.struct("kind", "event_ms", "price")).alias("new"))  # two at most
    rows = rows.select(*SERIES, "open_ms", "close_ms", "close").join(found, [*SERIES, "close_ms"], "left")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        state = Breaks()
        try:
            for bar in pdf.sort_values("open_ms").itertuples(index=False):
                for p in bar.new if bar.new is not None else ():
                    state.levels["up" if p["kind"] == "high" else "down"].append((bar.close_ms, p["event_ms"], p["price"]))
                state.step(bar)
            events = state.events
        except ValueError:
            events = [("AMBIGUOUS", None, None, None, bar.open_ms, bar.close_ms, None, None)]
        out = pd.DataFrame(events, columns=[f.split()[0] for f in EVENTS.split(", ")], dtype=object)
        return of_series(out, pdf)

    return rows.groupBy(*SERIES).applyInPandas(kernel, SERIES_TYPES + EVENTS)


def structure_levels(pivots: DataFrame, events: DataFrame) -> DataFrame:
    """The level that each pivot is: open, or consumed by the break that went through it. A taken back change of
    character consumes none."""
    used = events.where("type in ('BOS', 'CHOCH')").select(*SERIES, F.when(F.col("dir") == "up", "high").otherwise("low").alias("kind"), F.col("level_ms").alias("event_ms"), F.col("confirmed_ms").alias("consumed_ms"), F.col("type").alias("consumed_by"))
    out = pivots.join(used, [*SERIES, "kind", "event_ms"], "left")
    return out.withColumn("state", F.when(F.col("consumed_ms").isNull(), "ACTIVE").otherwise("CONSUMED")).select(*SERIES, "kind", "price", "event_ms", "confirmed_ms", "state", "consumed_ms", "consumed_by")


def dealing_ranges(events: DataFrame) -> DataFrame:
    """Ranges between a BOS level's side and its protected anchor. A BOS with an anchor opens one; the next BOS with an
    anchor, or a CHOCH, closes it; an invalidation changes nothing."""
    turning = events.where("(type = 'BOS' and anchor_price is not null) or type = 'CHOCH'")
    turning = turning.withColumn("closed_ms", F.lead("confirmed_ms").over(W.partitionBy(*SERIES).orderBy("confirmed_ms")))
    low, high = F.least("level", "anchor_price"), F.greatest("level", "anchor_price")
    return turning.where("type = 'BOS'").select(*SERIES, "dir", low.alias("low"), high.alias("high"), F.col("confirmed_ms").alias("opened_ms"), "closed_ms", "event_ms", "level_ms")


def range_position(price: F.Column, low: F.Column, high: F.Column, band: float = 0.02) -> list:
    """Where a price stands in a range (unclamped), its zone, and whether it is outside."""
    at = (price - low) / (high - low)
    zone = F.when(at < 0.5 - band, "discount").when(at > 0.5 + band, "premium").otherwise("equilibrium")
    return [at.alias("position"), zone.alias("zone"), ((at < 0) | (at > 1)).alias("outside")]


def prepared(candles: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """The horizon with indicators, numbered."""
    cut = horizon(candles, as_of_ms)
    return with_indicators(cut).withColumn("close_ms", F.col("open_ms") + duration(F.col("timeframe"))).withColumn("i", F.row_number().over(by_time()) - 1)
