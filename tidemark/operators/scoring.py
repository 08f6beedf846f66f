"""One verdict per series from its structure: nine components, their weights, and the direction they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import SERIES
from tidemark.operators import facts as known
from tidemark.operators import structure, zones
from tidemark.sources.tables import settled

# Weights (their sum is 100), bars up to which facts are fresh, and the score that gives a direction.
WEIGHTS = {"swing": 20, "bos": 15, "internal": 10, "sweep": 10, "swing_block": 15, "internal_block": 5, "gap": 10, "range": 10, "overlap": 5}
FRESH = {"bos": 10, "sweep": 5, "block": 20, "gap": 20}
MINIMUM, SWING, INTERNAL, BAND = 72, 20, 3, 0.02
# Codes of the components' reasons.
CODES = {"swing": "SWING_TREND", "bos": "RECENT_SWING_BOS", "internal": "INTERNAL_TREND", "sweep": "LIQUIDITY_SWEEP", "swing_block": "SWING_ORDER_BLOCK", "internal_block": "INTERNAL_ORDER_BLOCK", "gap": "FVG", "range": "RANGE_POSITION", "overlap": "OB_FVG_CONFLUENCE"}

# What reasons say, by code: for the long side, for the short side, otherwise, and what a reader adds in some cases.
LABELS = {
    "swing": ("Установленная swing-структура: восходящий тренд", "Установленная swing-структура: нисходящий тренд", "Swing-структура не определена", "Swing-структура в переходе (reversal pending)"),
    "bos": ("Свежий swing BOS подтверждает направление", "Свежий swing BOS подтверждает направление", "Свежего swing BOS по текущей фазе нет"),
    "internal": ("Установленная internal-структура: восходящий тренд", "Установленная internal-структура: нисходящий тренд", "Internal-структура не установлена"),
    "sweep": ("Свежий sweep ликвидности", "Свежий sweep ликвидности", "Свежего resolved SWEPT нет"),
    "swing_block": ("Свежий активный bullish swing order block", "Свежий активный bearish swing order block", "Свежего активного swing order block нет"),
    "internal_block": ("Свежий активный bullish internal order block", "Свежий активный bearish internal order block", "Свежего активного internal order block нет"),
    "gap": ("Свежий активный bullish FVG", "Свежий активный bearish FVG", "Свежего активного FVG нет"),
    "range": ("Цена в discount активного диапазона", "Цена в premium активного диапазона", "Цена в equilibrium активного диапазона", "Активный dealing range отсутствует"),
    "overlap": ("Confluence: bullish OB и FVG перекрываются", "Confluence: bearish OB и FVG перекрываются", "OB+FVG confluence отсутствует"),
    "conflict": ("Обе стороны достигли порога — конфликт, направления нет",),
}


def reach(layer: int | tuple[int, int]) -> tuple[int, int]:
    """Candles to the left and right of a layer's pivots; one number stands for both."""
    return (layer, layer) if isinstance(layer, int) else (layer[0], layer[1])


def minimum_history(swing: int | tuple[int, int] = SWING) -> int:
    """Four legs of the wider side of a swing."""
    return 4 * (max(reach(swing)) + 1)


def phase(events: DataFrame, name: str) -> DataFrame:
    """The trend that the last event of a series leaves: a BOS or an invalidation sets it, a change of character leaves
    it pending."""
    last = events.groupBy(*SERIES).agg(F.max_by(F.struct("type", "dir"), "event_ms").alias("e"))
    up = F.col("e.dir") == "up"
    trend = F.when(F.col("e.type") == "CHOCH", F.when(up, "REVERSAL_PENDING_UP").otherwise("REVERSAL_PENDING_DOWN")).otherwise(F.when(up, "TREND_UP").otherwise("TREND_DOWN"))
    return last.select(*SERIES, trend.alias(name))


def latest(facts: DataFrame, at: str, fresh: int, last: DataFrame, fields: list[str], name: str) -> DataFrame:
    """The newest fact of each series that is at most `fresh` bars old, counted in bars and not by the clock; ties go
    to the later event."""
    aged = facts.join(last, SERIES).join(last.select(*SERIES, F.explode("closes").alias("c")).select(*SERIES, F.col("c.close_ms").alias(at), F.col("c.i").alias("_i")), [*SERIES, at])
    aged = aged.where(F.col("last_i") - F.col("_i") <= fresh)
    return aged.groupBy(*SERIES).agg(F.max_by(F.struct(*fields), F.struct(at, "event_ms")).alias(name))


def score_series(rows: DataFrame, swing: int | tuple[int, int] = SWING, internal: int | tuple[int, int] = INTERNAL, weights: dict = WEIGHTS, minimum: int = MINIMUM, fresh: dict = FRESH, band: float = BAND) -> DataFrame:
    """rows: structure.prepared. A series that cannot be evaluated has a status and no scores, which is not NEUTRAL.
    soft_codes say what an evaluated one lacks.

    Facts that several components rest on are settled first: five hundred candles a series and what is found in them."""
    rows = settled(rows)
    closes = F.array_sort(F.collect_list(F.struct("close_ms", "i")))  # the cut of a series at most
    last = rows.groupBy(*SERIES).agg(F.count("*").alias("bars"), F.max("i").alias("last_i"), F.max_by("close", "i").alias("price"), F.max_by("atr14", "i").alias("atr"), closes.alias("closes"))
    pivots = structure.both_pivots(rows, *reach(swing))
    have = pivots.groupBy(*SERIES).agg(F.count_if(F.col("kind") == "high").alias("highs"), F.count_if(F.col("kind") == "low").alias("lows"))
    swing_events, inner_events = (settled(structure.structure_events(rows, *reach(n))) for n in (swing, internal))
    gaps = settled(structure.gaps(rows))
    levels, inner_levels = (settled(zones.liquidity_levels(rows, *reach(n), age=0)) for n in (swing, internal))
    lives = structure.gap_lives(rows, gaps, 0).where("state in ('OPEN', 'TOUCHED', 'CE')")
    active = "state in ('OPEN', 'MITIGATED')"
    blocks = settled(zones.order_blocks(rows, swing_events, gaps, levels).where(active))
    inner_blocks = settled(zones.order_blocks(rows, inner_events, gaps, inner_levels).where(active))
    ranges = structure.dealing_ranges(swing_events).where("closed_ms is null").select(*SERIES, "low", "high")
    zone = ["dir", "bottom", "top", "key"]
    out = last.join(have, SERIES, "left").join(phase(swing_events, "swing_phase"), SERIES, "left").join(phase(inner_events, "internal_phase"), SERIES, "left").join(ranges, SERIES, "left")
    bos = swing_events.where("type = 'BOS'").select(*SERIES, "dir", "event_ms", "confirmed_ms")
    broken = swing_events.unionByName(inner_events).where("type = 'AMBIGUOUS'").select(*SERIES).distinct().withColumn("ambiguous", F.lit(True))
    out = out.join(broken, SERIES, "left")
    for facts, at, bars, fields, name in (
        (bos, "confirmed_ms", fresh["bos"], ["dir"], "bos"),
        (levels.where("state = 'SWEPT'"), "resolved_ms", fresh["sweep"], ["side", "resolved_ms"], "sweep"),
        (blocks.withColumn("key", known.block_key("swing")), "confirmed_ms", fresh["block"], zone, "swing_block"),
        (inner_blocks.withColumn("key", known.block_key("internal")), "confirmed_ms", fresh["block"], zone, "internal_block"),
        (lives.withColumn("key", known.gap_key()).withColumnRenamed("direction", "dir"), "confirmed_ms", fresh["gap"], zone, "gap"),
    ):
        out = out.join(latest(facts, at, bars, last, fields, name), SERIES, "left")
    position = (F.col("price") - F.col("low")) / (F.col("high") - F.col("low"))
    block = F.coalesce("swing_block", "internal_block")
    meets = (block["dir"] == F.col("gap.dir")) & (block["bottom"] <= F.col("gap.top")) & (F.col("gap.bottom") <= block["top"])

    def sides(side: str) -> dict[str, Column]:
        up = side == "up"
        trend = "TREND_UP" if up else "TREND_DOWN"
        return {
            "swing": F.col("swing_phase") == trend,
            "bos": (F.col("swing_phase") == trend) & (F.col("bos.dir") == side),
            "internal": F.col("internal_phase") == trend,
            "sweep": F.col("sweep.side") == ("SELL_SIDE" if up else "BUY_SIDE"),
            "swing_block": F.col("swing_block.dir") == side,
            "internal_block": F.col("internal_block.dir") == side,
            "gap": F.col("gap.dir") == side,
            "range": position < 0.5 - band if up else position > 0.5 + band,
            "overlap": meets & (block["dir"] == side),
        }

    status = (
        F.when(F.col("bars") < minimum_history(swing), "INSUFFICIENT_HISTORY").when(F.col("atr").isNull(), "ATR_UNAVAILABLE")
        .when(F.coalesce("highs", F.lit(0)) == 0, "NO_SWING_HIGH").when(F.coalesce("lows", F.lit(0)) == 0, "NO_SWING_LOW").when(F.col("ambiguous"), "AMBIGUOUS_BREAK").otherwise("evaluated")
    )
    out = out.withColumn("status", status)
    for side, name in (("up", "long"), ("down", "short")):
        points = {k: F.when(F.coalesce(v, F.lit(False)), weights[k]).otherwise(0) for k, v in sides(side).items()}
        out = out.withColumn(f"{name}_parts", F.struct(*[p.alias(k) for k, p in points.items()])).withColumn(f"{name}_score", F.when(F.col("status") == "evaluated", sum(points.values(), F.lit(0))))
    up, down = F.col("long_score") >= minimum, F.col("short_score") >= minimum
    direction = F.when(F.col("status") == "evaluated", F.when(up & ~down, "LONG").when(down & ~up, "SHORT").otherwise("NEUTRAL"))
    phase_known = F.col("swing_phase").isNotNull()
    missing = {"STRUCTURE_UNDEFINED": ~phase_known, "STRUCTURE_TRANSITION": F.col("swing_phase").startswith("REVERSAL"), "NO_RECENT_LIQUIDITY_SWEEP": F.col("sweep").isNull(), "NO_SWING_ORDER_BLOCK": F.col("swing_block").isNull(), "NO_INTERNAL_ORDER_BLOCK": F.col("internal_block").isNull(), "NO_ACTIVE_FVG": F.col("gap").isNull(), "NO_ACTIVE_DEALING_RANGE": F.col("low").isNull()}
    codes = F.array_compact(F.array(*[F.when(test, code) for code, test in missing.items()]))
    out = out.withColumn("soft_codes", F.when(F.col("status") == "evaluated", codes))
    time = F.date_format(F.timestamp_millis("sweep.resolved_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    undefined = lambda c: F.coalesce(c, F.lit("UNDEFINED"))
    evidence = {
        "swing": undefined("swing_phase"), "bos": F.concat(F.lit("BOS:"), F.col("bos.dir")), "internal": undefined("internal_phase"), "sweep": F.concat(F.col("sweep.side"), F.lit(" @"), time),
        "swing_block": F.col("swing_block.key"), "internal_block": F.col("internal_block.key"), "gap": F.col("gap.key"), "range": F.when(position.isNotNull(), F.format_string("pos=%.6f", position)), "overlap": F.lit(None).cast("string"),
    }
    out = out.withColumn("evidence", F.when(F.col("status") == "evaluated", F.struct(*[v.alias(k) for k, v in evidence.items()])))
    return out.select(*SERIES, "bars", "status", "swing_phase", "internal_phase", "long_score", "short_score", "long_parts", "short_parts", direction.alias("direction"), F.coalesce(up & down, F.lit(False)).alias("conflict"), "soft_codes", "evidence")


def reasons(scores: DataFrame, weights: dict = WEIGHTS) -> DataFrame:
    """A row for each component of each scored series: its code and label, which sides have its points, its weight, the
    evidence with the points, and the keys of the facts behind it. A conflict of both sides is one more, without points."""
    points = lambda k: F.concat(F.col(f"long_parts.{k}").cast("string"), F.lit("/"), F.col(f"short_parts.{k}").cast("string"))

    def entry(k: str, w: int) -> Column:
        up, down, seen = F.col(f"long_parts.{k}") > 0, F.col(f"short_parts.{k}") > 0, F.col(f"evidence.{k}")
        long, short, none, *other = LABELS[k]
        rest = F.lit(none)
        if k == "swing":
            rest = F.when(seen.startswith("REVERSAL"), other[0]).otherwise(none)
        elif k == "range":
            rest = F.when(seen.isNull(), other[0]).otherwise(none)
        label = F.concat(F.lit(f"[{CODES[k]}] "), F.when(up, long).when(down, short).otherwise(rest))
        value = F.when(seen.isNull(), points(k)).otherwise(F.concat(seen, F.lit(" ("), points(k), F.lit(")")))
        return F.struct(F.lit(CODES[k]).alias("code"), label.alias("label"), up.alias("long"), down.alias("short"), F.lit(w).cast("double").alias("weight"), value.alias("value"), known.fact_ids(F.lit(CODES[k]), seen).alias("fact_ids"))

    listed = F.array(*[entry(k, w) for k, w in weights.items()])
    both = F.concat(F.lit("long="), F.col("long_score").cast("string"), F.lit(";short="), F.col("short_score").cast("string"), F.lit(" (0/0)"))
    no = F.lit(False)
    conflict = F.struct(F.lit("DIRECTION_CONFLICT").alias("code"), F.lit(f"[DIRECTION_CONFLICT] {LABELS['conflict'][0]}").alias("label"), no.alias("long"), no.alias("short"), F.lit(0.0).alias("weight"), both.alias("value"), F.array().cast("array<string>").alias("fact_ids"))
    every = F.when(F.col("conflict"), F.concat(listed, F.array(conflict))).otherwise(listed)
    return scores.where("status = 'evaluated'").select(*SERIES, F.explode(every).alias("r")).select(*SERIES, "r.*")
