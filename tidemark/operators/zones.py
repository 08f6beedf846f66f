"""Liquidity levels and order blocks of a series.

What happens to a level or a zone afterwards is a join with the later candles of its series, bounded by the cut. Only
what depends on the order of events runs as a grouped kernel: which pivots make a cluster of equal highs or lows, and
which impulse a break of structure uses up.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.indicators import SERIES
from tidemark.operators.crossing import ROWS, first_crossings, probe
from tidemark.operators.structure import SERIES_TYPES, both_pivots, displacements, of_series
from tidemark.sources.tables import settled

# Tolerance of equal levels and least excursion of a sweep in ATR, bars that confirm a cluster, ages.
EQUAL_ATR, SWEEP_ATR, CONFIRM_BARS, LEVEL_AGE, ZONE_AGE = 0.10, 0.05, 2, 750, 750
# Bars of an impulse, bars between an impulse and its break, bars a sweep may lie before an impulse.
IMPULSE_BARS, MATCH_BARS, SWEEP_BARS = 3, 10, 5

LEVEL = "side string, origin string, price double, event_ms long, created_i int, trigger_ms long"


def fate(side: Column, price: Column, high: Column, low: Column, close: Column, atr: Column, sweep: float) -> Column:
    """What a candle does to a level: a close beyond breaks it; else a wick that goes at least `sweep` ATR beyond and
    a close strictly back sweeps it; a close on it does neither."""
    up = side == "BUY_SIDE"
    broken = F.when(up, close > price).otherwise(close < price)
    beyond = F.when(up, high >= price + sweep * atr).otherwise(low <= price - sweep * atr)
    back = F.when(up, close < price).otherwise(close > price)
    return F.when(broken, "BROKEN").when(beyond & back, "SWEPT")


class Clusters:
    """Equal highs and lows of one series. Bars come in order; within a bar, waiting clusters are confirmed or dropped,
    then its pivots join or found clusters, then open ones are resolved."""

    def __init__(self, tolerance: float, sweep: float, confirm: int, age: int):
        self.tolerance, self.sweep, self.confirm, self.age = tolerance, sweep, confirm, age
        self.seen: list[dict] = []
        self.clusters: list[dict] = []

    def bar(self, b, fresh: list[dict]) -> None:
        for c in self.clusters:
            if c["state"] == "waiting" and b.i > c["anchor_i"]:
                if (b.close - c["price"]) * c["sign"] > 0:
                    c["state"] = "dropped"
                elif b.i == c["anchor_i"] + self.confirm:
                    c.update(state="open", created_i=b.i)
        for p in sorted(fresh, key=lambda p: (p["kind"] != "high", p["event_ms"])):
            p["used"] = False
            self.seen.append(p)
            if b.atr14 is not None and b.atr14 == b.atr14:
                self.place(b, p)
        for c in self.clusters:
            if c["state"] == "open" and c["created_i"] < b.i:
                self.resolve(b, c)

    def place(self, b, p: dict) -> None:
        near = lambda price: abs(p["price"] - price) <= self.tolerance * b.atr14
        joinable = [c for c in self.clusters if c["kind"] == p["kind"] and c["state"] in ("waiting", "open") and near(c["price"])]
        sign = 1 if p["kind"] == "high" else -1
        if joinable:
            c = max(joinable, key=lambda c: (c["joined"], c["n"]))
            c["members"].append(p)
            c["joined"] = b.close_ms
            if c["state"] == "waiting":
                c.update(price=sign * max(sign * c["price"], sign * p["price"]), event_ms=p["event_ms"], anchor_i=b.i)
            return
        partners = [q for q in self.seen if q["kind"] == p["kind"] and not q["used"] and q["confirmed_ms"] < p["confirmed_ms"] and q["event_ms"] < p["event_ms"] and near(q["price"])]
        if partners:
            q = partners[-1]
            self.clusters.append({
                "n": len(self.clusters), "kind": p["kind"], "sign": sign, "members": [q, p], "price": sign * max(sign * q["price"], sign * p["price"]),
                "event_ms": p["event_ms"], "trigger_ms": p["event_ms"], "anchor_i": b.i, "joined": b.close_ms, "state": "open" if self.confirm == 0 else "waiting", "created_i": b.i if self.confirm == 0 else None,
            })

    def resolve(self, b, c: dict) -> None:
        sign, reach = c["sign"], b.high if c["sign"] > 0 else b.low
        broken = (b.close - c["price"]) * sign > 0
        atr = b.atr14 if b.atr14 is not None and b.atr14 == b.atr14 else None
        swept = atr is not None and (reach - (c["price"] + sign * self.sweep * atr)) * sign >= 0 and (b.close - c["price"]) * sign < 0
        if broken or swept or (self.age > 0 and b.i - c["created_i"] >= self.age):
            c["state"] = "resolved"
            for m in c["members"]:
                m["used"] = True

    def levels(self) -> list[tuple]:
        return [("BUY_SIDE" if c["sign"] > 0 else "SELL_SIDE", "EQUAL", c["price"], c["event_ms"], c["created_i"], c["trigger_ms"]) for c in self.clusters if c["created_i"] is not None]


def liquidity_levels(rows: DataFrame, left: int, right: int, tolerance: float = EQUAL_ATR, sweep: float = SWEEP_ATR, confirm: int = CONFIRM_BARS, age: int = LEVEL_AGE) -> DataFrame:
    """Levels of single pivots and of equal ones, and how each ended. rows: prepared."""
    found = both_pivots(rows, left, right)
    side = F.when(F.col("kind") == "high", "BUY_SIDE").otherwise("SELL_SIDE")
    at = rows.select(*SERIES, F.col("close_ms").alias("confirmed_ms"), F.col("i").cast("int").alias("created_i"))
    single = found.join(at, [*SERIES, "confirmed_ms"]).select(*SERIES, side.alias("side"), F.lit("STRUCTURAL").alias("origin"), "price", "event_ms", "created_i", F.col("event_ms").alias("trigger_ms"))
    new = found.groupBy(*SERIES, F.col("confirmed_ms").alias("close_ms")).agg(F.collect_list(F.struct("kind", "price", "event_ms", "confirmed_ms")).alias("new"))  # two at most
    bars = rows.select(*SERIES, "i", "close_ms", "high", "low", "close", "atr14").join(new, [*SERIES, "close_ms"], "left")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        state = Clusters(tolerance, sweep, confirm, age)
        for b in pdf.sort_values("i").itertuples(index=False):
            state.bar(b, [dict(p) for p in b.new] if b.new is not None else [])
        out = pd.DataFrame(state.levels(), columns=[f.split()[0] for f in LEVEL.split(", ")])
        return of_series(out, pdf)

    equal = bars.groupBy(*SERIES).applyInPandas(kernel, SERIES_TYPES + LEVEL)
    return level_fates(rows, single.unionByName(equal), sweep, age)


def level_fates(rows: DataFrame, levels: DataFrame, sweep: float = SWEEP_ATR, age: int = LEVEL_AGE, size: int = ROWS) -> DataFrame:
    """levels (with trigger_ms, the pivot that began them) and state, resolved_ms and resolved_open_ms: the first later candle that breaks, sweeps or outlives each.

    A close beyond is a crossing of the closes; a sweep is one of the wicks less the least excursion, if it comes first.
    Rounding and closes on the level itself may let in a candle that is none: then the search goes on behind it."""
    key = ["side", "origin", "event_ms"]
    own = [*SERIES, *key]
    reach = sweep * F.col("atr14")
    rows = settled(rows.select(*SERIES, "i", "open_ms", "close_ms", "high", "low", "close", "atr14", (F.col("high") - reach).alias("upper"), (F.col("low") + reach).alias("lower")))
    levels = settled(levels)
    up, slack = F.col("side") == "BUY_SIDE", F.abs("price") * 1e-9
    candle = rows.select(*SERIES, F.col("i").alias("j"), F.col("close_ms").alias("at_ms"), F.col("open_ms").alias("at_open_ms"), "high", "low", "close", "atr14")
    pending, ends = levels.select(*own, "price", F.col("created_i").alias("from_i")), None
    closes = F.when(up, probe("broken", "close", True, True, F.col("price"))).otherwise(probe("broken", "close", False, True, F.col("price")))
    wicks = F.when(up, probe("swept", "upper", True, False, F.col("price") - slack)).otherwise(probe("swept", "lower", False, False, F.col("price") + slack))
    at = lambda name: F.min(F.when(F.col("name") == name, F.col("found_i")))
    while True:
        asked = pending.select(*own, "from_i", F.explode(F.array(closes, wicks)).alias("probe"))
        hits = first_crossings(rows, asked, key, ["close", "upper", "lower"], size).groupBy(*own).agg(at("broken").alias("broken"), at("swept").alias("swept"))
        hits = hits.select(*own, F.least("broken", "swept").alias("j")).where("j is not null")
        what = fate(F.col("side"), F.col("price"), F.col("high"), F.col("low"), F.col("close"), F.col("atr14"), sweep)
        hits = settled(hits.join(candle, [*SERIES, "j"]).join(levels.select(*own, "price"), own).select(*own, "price", what.alias("what"), "at_ms", "at_open_ms", "j"))
        done = hits.where("what is not null").select(*own, F.struct("what", "at_ms", "at_open_ms", "j").alias("end"))
        ends = done if ends is None else ends.unionByName(done)
        pending = hits.where("what is null").select(*own, "price", F.col("j").alias("from_i"))
        if pending.isEmpty():
            break
    created = rows.select(*SERIES, F.col("i").cast("int").alias("created_i"), F.col("close_ms").alias("created_ms"))
    old = candle.select(*SERIES, F.col("j").alias("old_i"), F.struct(F.lit("EXPIRED").alias("what"), "at_ms", "at_open_ms", "j").alias("aged"))
    out = levels.join(ends, own, "left").join(created, [*SERIES, "created_i"])
    out = out.withColumn("old_i", F.when(F.lit(age > 0), F.col("created_i").cast("long") + age)).join(old, [*SERIES, "old_i"], "left")
    out = out.withColumn("end", F.when(F.col("end.j") <= F.coalesce("aged.j", "end.j"), F.col("end")).otherwise(F.coalesce("aged", "end")))
    return out.select(*own, "price", "created_ms", "trigger_ms", F.coalesce("end.what", F.lit("OPEN")).alias("state"), F.col("end.at_ms").alias("resolved_ms"), F.col("end.at_open_ms").alias("resolved_open_ms"), F.col("end.j").alias("resolved_i"))


BLOCK = "dir string, start_i int, end_i int, origin_i int, bottom double, top double, event_i int, event_ms long, confirmed_ms long, origin_ms long, level_ms long"


def impulses(bars: list, direction: str, longest: int = IMPULSE_BARS) -> list[dict]:
    """Runs of up to `longest` candles in a direction from a displacement on, and the zone of the opposite candles
    right before each. A candle belongs to one run at most."""
    sign, out, taken = (1 if direction == "up" else -1), [], -1
    for i, b in enumerate(bars):
        if b.direction != direction or i <= taken:
            continue
        end = i
        while end + 1 < len(bars) and end - i + 1 < longest and (bars[end + 1].close - bars[end + 1].open) * sign > 0:
            end += 1
        taken, first = end, i
        while first > 0 and (bars[first - 1].close - bars[first - 1].open) * sign < 0:
            first -= 1
        zone = bars[first:i]
        if zone and max(z.high for z in zone) > min(z.low for z in zone):
            out.append({"start": i, "end": end, "origin": first, "bottom": min(z.low for z in zone), "top": max(z.high for z in zone), "used": False})
    return out


def order_blocks(rows: DataFrame, events: DataFrame, gaps: DataFrame, levels: DataFrame, age: int = ZONE_AGE, within: int = MATCH_BARS, lookback: int = SWEEP_BARS) -> DataFrame:
    """Zones that a break of structure confirms, and their later life. rows: prepared; events: structure_events of the
    layer; gaps: structure.gaps; levels: liquidity_levels.

    A break (BOS only) takes the nearest unused impulse of its direction that ended at most `within` bars before it,
    and after the change of character if it completes a reversal. The impulse is used up even if the zone then turns
    out to have been closed through."""
    marks = displacements(rows).select(*SERIES, "open_ms", "direction")
    before = F.lag(F.struct("type", "dir", "event_ms")).over(W.partitionBy(*SERIES).orderBy("event_ms"))
    breaks = events.withColumn("b", before).where("type = 'BOS'").select(*SERIES, "dir", F.col("event_ms").alias("open_ms"), "confirmed_ms", "level_ms", F.when((F.col("b.type") == "CHOCH") & (F.col("b.dir") == F.col("dir")), F.col("b.event_ms")).alias("reversal_ms"))
    bars = rows.select(*SERIES, "i", "open_ms", "open", "high", "low", "close").join(marks, [*SERIES, "open_ms"], "left").join(breaks, [*SERIES, "open_ms"], "left")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        bars = list(pdf.sort_values("i").itertuples(index=False))
        runs = {d: impulses(bars, d) for d in ("up", "down")}
        found = []
        for i, b in enumerate(bars):
            if b.dir not in runs:
                continue
            since = next((k for k, x in enumerate(bars) if x.open_ms == b.reversal_ms), 0) if b.reversal_ms == b.reversal_ms and b.reversal_ms is not None else 0
            fit = [r for r in runs[b.dir] if not r["used"] and since <= r["end"] <= i and i - r["end"] <= within]
            if fit:
                r = max(fit, key=lambda r: r["end"])
                r["used"] = True
                found.append((b.dir, r["start"], r["end"], r["origin"], r["bottom"], r["top"], i, b.open_ms, int(b.confirmed_ms), bars[r["origin"]].open_ms, int(b.level_ms)))
        out = pd.DataFrame(found, columns=[f.split()[0] for f in BLOCK.split(", ")])
        return of_series(out, pdf)

    zones = bars.groupBy(*SERIES).applyInPandas(kernel, SERIES_TYPES + BLOCK)
    key = [*SERIES, "event_i"]
    candles = rows.select(*SERIES, F.col("i").alias("j"), F.col("close_ms").alias("at_ms"), "high", "low", "close")
    up = F.col("dir") == "up"
    touch = F.when(up, F.col("low") <= F.col("top")).otherwise(F.col("high") >= F.col("bottom"))
    through = F.when(up, F.col("close") < F.col("bottom")).otherwise(F.col("close") > F.col("top"))
    pairs = zones.join(candles, SERIES).where(F.col("j") > F.col("end_i")).withColumn("touch", touch).withColumn("through", through)
    early = pairs.where(F.col("j") < F.col("event_i")).groupBy(*key).agg(F.count_if("touch").alias("early_touches"), F.max("through").alias("spoilt"))
    later = pairs.where(F.col("j") > F.col("event_i"))
    per = W.partitionBy(*key).orderBy("j")
    aged = F.lit(age > 0) & (F.col("j") - F.col("event_i") >= age)
    later = later.withColumn("stop", F.min(F.when(F.col("through") | aged, F.col("j"))).over(W.partitionBy(*key))).where("stop is null or j <= stop")
    later = later.withColumn("entered", F.col("touch") & ~F.coalesce(F.lag("touch").over(per), F.lit(False)))
    depth = F.when(up, F.col("top") - F.col("low")).otherwise(F.col("high") - F.col("bottom")) / (F.col("top") - F.col("bottom"))
    lives = later.groupBy(*key).agg(
        F.min(F.when(F.col("touch"), F.col("at_ms"))).alias("touched_ms"), F.count_if("entered").alias("retests"), F.max(F.when(F.col("touch"), depth)).alias("depth"),
        F.min(F.when(F.col("through"), F.col("at_ms"))).alias("invalidated_ms"), F.min(F.when(aged, F.col("at_ms"))).alias("aged_ms"),
    )
    third = gaps.select(*SERIES, F.col("direction").alias("dir"), F.col("i").alias("gap_i"))
    with_gap = zones.join(third, [*SERIES, "dir"]).where("gap_i between origin_i and end_i").select(*key).distinct().withColumn("has_gap", F.lit(True))
    swept = levels.where("state = 'SWEPT'").select(*SERIES, F.when(F.col("side") == "SELL_SIDE", "up").otherwise("down").alias("dir"), "resolved_i")
    with_sweep = zones.join(swept, [*SERIES, "dir"]).where(f"start_i - resolved_i between 1 and {lookback}").select(*key).distinct().withColumn("has_sweep", F.lit(True))
    out = zones.join(early, key, "left").where("coalesce(spoilt, false) = false").join(lives, key, "left").join(with_gap, key, "left").join(with_sweep, key, "left")
    expired = F.when(F.col("invalidated_ms").isNull(), F.col("aged_ms"))
    state = F.when(F.col("invalidated_ms").isNotNull(), "INVALIDATED").when(F.col("expired_ms").isNotNull(), "EXPIRED").when(F.col("touched_ms").isNotNull(), "MITIGATED").otherwise("OPEN")
    no = F.lit(False)
    return out.withColumn("expired_ms", expired).select(
        *SERIES, "dir", "bottom", "top", "event_ms", "confirmed_ms", F.coalesce("early_touches", F.lit(0)).alias("early_touches"), "touched_ms", F.coalesce("retests", F.lit(0)).alias("retests"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("depth", F.lit(0.0)))).alias("depth"), "invalidated_ms", "expired_ms", F.coalesce("has_gap", no).alias("has_gap"), F.coalesce("has_sweep", no).alias("has_sweep"), state.alias("state"), "origin_ms", "level_ms",
    )
