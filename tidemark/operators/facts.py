"""Facts of structure as they were known at any time, and documents made of them.

A fact is a row as long as nothing about it changes: known from the close that showed it until the close that changed it. What
comes later (a touch, a break, an expiry) ends one row and begins the next, so a row shows nothing from after its own
time. The facts at a time are those whose rows hold it; for many times each row is given out once a time, without another
evaluation and without a join.

Keys are made of times and kinds alone, never of prices, so a fact keeps its key whatever is known of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import SERIES
from tidemark.functions.timeframes import duration
from tidemark.operators import structure, zones
from tidemark.sources.tables import settled

# The prefix of keys, and the codes of reasons whose value is the key of the fact behind them.
PREFIX = "SMC1"
BLOCK_CODES, GAP_CODES = ("SWING_ORDER_BLOCK", "INTERNAL_ORDER_BLOCK"), ("FVG",)
COMMON = [*SERIES, "kind", "layer", "key", "state", "event_ms", "known_from_ms", "known_until_ms", "fields"]


def key_of(kind: str, *parts: str | Column) -> Column:
    return F.concat_ws("|", F.lit(PREFIX), F.lit(kind), "timeframe", *[p if isinstance(p, Column) else F.col(p) for p in parts])


def fact_ids(code: Column, value: Column) -> Column:
    """Keys of the facts that a reason rests on: only where its value is itself such a key, whole and of the right kind."""
    block = code.isin(*BLOCK_CODES) & value.startswith(f"{PREFIX}|OB|")
    gap = code.isin(*GAP_CODES) & value.startswith(f"{PREFIX}|FVG|")
    return F.when(F.coalesce(block | gap, F.lit(False)), F.array(value)).otherwise(F.array().cast("array<string>"))


def versions(found: DataFrame, kind: str, layer: str, key: Column, born: str, steps: list[tuple[str, str | None]], fields: list[str], base: str = "CONFIRMED") -> DataFrame:
    """COMMON for facts that are born and change at the times of steps (column, state from then on, None: as before), in
    rising rank: the state is that of the highest step so far. fields: what stays as it is."""
    names = [c for c, _ in steps]
    times = F.array_sort(F.array_distinct(F.filter(F.array(born, *names), lambda t: t.isNotNull() & (t >= F.col(born)))))
    rows = found.withColumn("key", key).withColumn("_times", times)
    rows = rows.withColumn("_v", F.explode(F.transform("_times", lambda t, i: F.struct(t.alias("from_"), F.get("_times", i + 1).alias("until_")))))
    known = {c: F.when(F.col(c) <= F.col("_v.from_"), F.col(c)) for c in names}
    state = F.coalesce(*[F.when(known[c].isNotNull(), s) for c, s in reversed(steps) if s], F.lit(base))
    shown = F.struct(*fields, *[known[c].alias(c) for c in names])
    return rows.select(*SERIES, F.lit(kind).alias("kind"), F.lit(layer).alias("layer"), "key", state.alias("state"), "event_ms", F.col("_v.from_").alias("known_from_ms"), F.col("_v.until_").alias("known_until_ms"), F.to_json(shown, {"ignoreNullFields": "false"}).alias("fields"))


def pivot_versions(pivots: DataFrame, layer: str) -> DataFrame:
    return versions(pivots, "pivot", layer, key_of("P", F.lit(layer), "kind", "event_ms"), "confirmed_ms", [], ["kind", "price", "confirmed_ms"])


def level_versions(levels: DataFrame, layer: str) -> DataFrame:
    """levels: structure_levels."""
    return versions(levels, "level", layer, key_of("P", F.lit(layer), "kind", "event_ms"), "confirmed_ms", [("consumed_ms", "CONSUMED")], ["kind", "price", "confirmed_ms"], "ACTIVE")


def event_key(layer: str, kind: Column | None = None) -> Column:
    """Of rows with dir, level_ms and event_ms; kind: their type, where they have no such column."""
    side = F.when(F.col("dir") == "up", "high").otherwise("low")
    return key_of("E", F.lit(layer), F.col("type") if kind is None else kind, "dir", key_of("P", F.lit(layer), side, "level_ms"), "event_ms")


def block_key(layer: str) -> Column:
    """By the break that confirmed it and the first candle of its zone."""
    return key_of("OB", "dir", F.lit(layer), event_key(layer, F.lit("BOS")), "origin_ms")


def gap_key() -> Column:
    return key_of("FVG", "direction", "event_ms")


def event_versions(events: DataFrame, layer: str) -> DataFrame:
    rows = events.where("type <> 'AMBIGUOUS'")
    return versions(rows, "event", layer, event_key(layer), "confirmed_ms", [], ["type", "dir", "level", "level_ms", "confirmed_ms", "anchor_price", "anchor_ms"])


def gap_versions(lives: DataFrame) -> DataFrame:
    """lives: structure.gap_lives. An expiry shows until a close beyond the gap, which undoes it."""
    steps = [("touched_ms", "TOUCHED"), ("half_ms", "CE"), ("filled_ms", "FILLED"), ("due_ms", "EXPIRED"), ("invalidated_ms", "INVALIDATED")]
    return versions(lives, "gap", "", gap_key(), "confirmed_ms", steps, ["direction", "bottom", "top", "size_atr", "confirmed_ms"], "OPEN")


def liquidity_versions(levels: DataFrame) -> DataFrame:
    origin = F.when(F.col("origin") == "EQUAL", "EQH_EQL").otherwise(F.col("origin"))
    ends = levels.withColumns({f"{s.lower()}_ms": F.when(F.col("state") == s, F.col("resolved_ms")) for s in ("SWEPT", "BROKEN", "EXPIRED")}).drop("state")
    steps = [("swept_ms", "SWEPT"), ("broken_ms", "BROKEN"), ("expired_ms", "EXPIRED")]
    return versions(ends, "liquidity", "swing", key_of("LQ", "side", origin, "trigger_ms"), "created_ms", steps, ["side", "origin", "price", "created_ms"], "OPEN")


def range_versions(ranges: DataFrame) -> DataFrame:
    return versions(ranges, "range", "swing", key_of("RANGE", "dir", event_key("swing", F.lit("BOS"))), "opened_ms", [("closed_ms", "CLOSED")], ["dir", "low", "high", "opened_ms"], "OPEN")


def block_versions(blocks: DataFrame, layer: str) -> DataFrame:
    steps = [("touched_ms", "MITIGATED"), ("expired_ms", "EXPIRED"), ("invalidated_ms", "INVALIDATED")]
    return versions(blocks, "block", layer, block_key(layer), "confirmed_ms", steps, ["dir", "bottom", "top", "confirmed_ms", "early_touches", "has_gap", "has_sweep"], "OPEN")


def displacement_versions(found: DataFrame) -> DataFrame:
    rows = found.withColumn("event_ms", F.col("open_ms")).withColumn("confirmed_ms", F.col("open_ms") + duration(F.col("timeframe")))
    return versions(rows, "displacement", "", key_of("D", "direction", "event_ms"), "confirmed_ms", [], ["direction", "body_atr", "range_atr", "close_location", "confirmed_ms"])


def all_versions(rows: DataFrame, swing: int = 20, internal: int = 3) -> DataFrame:
    """Every fact of the series, in both layers. rows: prepared and settled."""
    gaps = settled(structure.gaps(rows))
    out = [gap_versions(structure.gap_lives(rows, gaps)), displacement_versions(structure.displacements(rows))]
    for layer, n in (("swing", swing), ("internal", internal)):
        pivots, events = settled(structure.both_pivots(rows, n, n)), settled(structure.structure_events(rows, n, n))
        liquidity = settled(zones.liquidity_levels(rows, n, n))
        out += [pivot_versions(pivots, layer), event_versions(events, layer), level_versions(structure.structure_levels(pivots, events), layer), block_versions(zones.order_blocks(rows, events, gaps, liquidity), layer)]
        if layer == "swing":
            out += [liquidity_versions(liquidity), range_versions(structure.dealing_ranges(events))]
    whole = out[0]
    for v in out[1:]:
        whole = whole.unionByName(v)
    return whole


def as_of(facts: DataFrame, times: list[int]) -> DataFrame:
    """facts once for each time at which they are known in this form. times: a list that a caller names."""
    asked = F.array(*[F.lit(t).cast("long") for t in sorted(set(times))])
    holds = lambda t: (t >= F.col("known_from_ms")) & (F.col("known_until_ms").isNull() | (t < F.col("known_until_ms")))
    return facts.withColumn("as_of_ms", F.explode(F.filter(asked, holds)))


def documents(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each series (and as-of time, or whatever `by` names) with its facts as JSON: an array for each kind,
    in order of event and key. A document holds the facts of one series' cut."""
    by = by or [*SERIES, *(["as_of_ms"] if "as_of_ms" in facts.columns else [])]
    kinds = {"pivot": "pivots", "event": "events", "level": "levels", "liquidity": "liquidity", "range": "ranges", "gap": "gaps", "block": "blocks", "displacement": "displacements"}
    fact = F.struct("event_ms", "key", "layer", "state", "fields")
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, fact))).alias(k) for k in kinds]
    made = facts.groupBy(*by).agg(*lists)

    def text(x: Column) -> Column:
        own = F.to_json(F.struct(x["key"].alias("key"), x["layer"].alias("layer"), x["state"].alias("state"), x["event_ms"].alias("event_ms")))
        return F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.when(x["fields"] == "{}", F.lit("}")).otherwise(F.concat(F.lit(","), F.substring(x["fields"], F.lit(2), F.length(x["fields"])))))

    parts = [F.concat(F.lit(f'"{name}":['), F.array_join(F.transform(k, text), ","), F.lit("]")) for k, name in kinds.items()]
    return made.select(*by, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("document"))


def write_documents(found: DataFrame, path: str) -> None:
    """JSON lines, a document a line."""
    found.select("document").write.mode("overwrite").text(path)
