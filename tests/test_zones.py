"""Liquidity, order blocks and scores: boundaries by hand, no look-ahead, mirror symmetry, sums of parts."""

import numpy as np
import pytest

from tests.test_series import H, bars, from_closes, walk
from tidemark.operators import scoring, structure, zones


@pytest.fixture(scope="module")
def wave():
    n = np.arange(260)
    return 100 + 6 * np.sin(n / 4) + 3 * np.sin(n / 11) + (walk(260) - 100) / 8


def mirrored(rows):
    return [(-o, -low, -h, -c) for o, h, low, c in rows]


def facts(spark, rows, layer=3):
    ready = structure.prepared(bars(spark, rows)).persist()
    levels = zones.liquidity_levels(ready, layer, layer)
    blocks = zones.order_blocks(ready, structure.structure_events(ready, layer, layer), structure.gaps(ready), levels)
    return levels.collect(), blocks.collect()


def test_level_is_swept_broken_or_left(spark):
    flat = [(10.0, 11.0, 9.0, 10.0)] * 20
    peak = flat + [(10.0, 15.0, 9.0, 10.0)] + [(10.0, 11.0 - 0.01 * i, 9.0 + 0.01 * i, 10.0) for i in range(1, 4)]
    for last, want in (((10, 15.5, 9, 14), "SWEPT"), ((10, 15.5, 9, 15), "OPEN"), ((10, 15.5, 9, 15.1), "BROKEN"), ((10, 15.0001, 9, 14), "OPEN")):
        levels = zones.liquidity_levels(structure.prepared(bars(spark, peak + [last])), 3, 3).collect()
        top = [r for r in levels if r.side == "BUY_SIDE" and r.event_ms == 20 * H]
        assert [(r.price, r.state) for r in top] == [(15.0, want)]


def test_equal_highs_make_one_cluster(spark):
    rows = []
    for top in (15.0, 15.05, 13.0):
        rows += [(10.0, 11.0 + 0.1 * i, 9.0 + 0.1 * i, 10.0 + 0.1 * i) for i in range(8)] + [(10.5, top, 9.5, 10.5)] + [(10.0, 11.0 - 0.1 * i, 9.0 - 0.1 * i, 10.0 - 0.1 * i) for i in range(8)]
    levels = zones.liquidity_levels(structure.prepared(bars(spark, rows)), 3, 3).collect()
    equal = [r for r in levels if r.origin == "EQUAL" and r.side == "BUY_SIDE"]
    assert [(r.price, r.event_ms // H) for r in equal] == [(15.05, 25)] and equal[0].created_ms // H == 25 + 3 + 2 + 1


def test_no_look_ahead(spark, wave):
    rows = from_closes(wave)
    whole, blocks = facts(spark, rows)
    assert {"STRUCTURAL", "EQUAL"} <= {r.origin for r in whole}
    for n in (150, 210):
        part, some = facts(spark, rows[:n])
        born = lambda rs: {(r.side, r.origin, r.event_ms): (r.price, r.created_ms) for r in rs if r.created_ms <= n * H}
        assert born(part).items() <= born(whole).items() and len(born(part)) == len(born(whole))
        done = lambda rs: {(r.side, r.origin, r.event_ms, r.state, r.resolved_ms) for r in rs if r.resolved_ms and r.resolved_ms <= n * H}
        assert done(part) == done(whole)
        known = lambda rs: {(r.dir, r.bottom, r.top, r.event_ms, r.has_gap, r.has_sweep, r.early_touches) for r in rs if r.confirmed_ms <= n * H}
        assert known(some) == known(blocks)


def test_mirror(spark, wave):
    rows = from_closes(wave)
    (a, ab), (b, bb) = facts(spark, rows), facts(spark, mirrored(rows))
    side = {"BUY_SIDE": "SELL_SIDE", "SELL_SIDE": "BUY_SIDE"}
    assert sorted((side[r.side], r.origin, -r.price, r.event_ms, r.state) for r in a) == sorted((r.side, r.origin, r.price, r.event_ms, r.state) for r in b)
    turn = {"up": "down", "down": "up"}
    assert sorted((turn[r.dir], -r.top, -r.bottom, r.event_ms, r.state) for r in ab) == sorted((r.dir, r.bottom, r.top, r.event_ms, r.state) for r in bb)


def test_block_by_hand(spark):
    """A quiet rise with one peak, a fall back, a strong candle through the peak: the candle before it is the zone."""
    quiet = [(86 + 0.01 * i, 90 + 0.01 * i, 84 + 0.01 * i, 87 + 0.01 * i) for i in range(16)]
    rows = quiet + [(87, 100, 86, 88), (88, 89, 80, 85), (85, 90, 84, 86), (88, 90, 83.5, 86), (86, 104, 85.9, 103), (103, 104.5, 101, 102.5), (102, 103.5, 89, 95), (95, 96, 82, 83)]
    ready = structure.prepared(bars(spark, rows)).persist()
    events = structure.structure_events(ready, 1, 1)
    levels = zones.liquidity_levels(ready, 1, 1)
    got = zones.order_blocks(ready, events, structure.gaps(ready), levels).collect()
    assert [(r.dir, r.bottom, r.top, r.event_ms // H, r.state, r.retests, r.depth) for r in got] == [("up", 83.5, 90.0, 20, "INVALIDATED", 1, 1.0)]
    assert got[0].touched_ms // H == 23 and got[0].invalidated_ms // H == 24


def test_scores_are_sums_and_mirror(spark, wave):
    rows = from_closes(wave)
    scored = scoring.score_series(structure.prepared(bars(spark, rows)), swing=5)
    a, a_schema = scored.first(), scored.schema
    b = scoring.score_series(structure.prepared(bars(spark, mirrored(rows))), swing=5).first()
    assert a.status == b.status == "evaluated"
    assert (a.long_score, a.short_score) == (sum(a.long_parts), sum(a.short_parts)) == (b.short_score, b.long_score)
    assert set(a.soft_codes) <= {"STRUCTURE_UNDEFINED", "STRUCTURE_TRANSITION", "NO_RECENT_LIQUIDITY_SWEEP", "NO_SWING_ORDER_BLOCK", "NO_INTERNAL_ORDER_BLOCK", "NO_ACTIVE_FVG", "NO_ACTIVE_DEALING_RANGE"} and set(a.soft_codes) == set(b.soft_codes)
    assert ("NO_SWING_ORDER_BLOCK" in a.soft_codes) <= (a.long_parts.swing_block == a.short_parts.swing_block == 0)
    why = scoring.reasons(spark.createDataFrame([a], a_schema)).collect()
    assert [r.code for r in why[:9]] == list(scoring.CODES.values()) and all(r.label.startswith(f"[{r.code}] ") and r.value.endswith(f"{p}/{q})" if "(" in r.value else f"{p}/{q}") for r, p, q in zip(why, a.long_parts, a.short_parts)) and sum(r.weight for r in why if r.long) == a.long_score and sum(r.weight for r in why if r.short) == a.short_score
    assert sum(scoring.WEIGHTS.values()) == 100 and a.long_score + a.short_score <= 100


def test_too_little_history_is_not_neutral(spark, wave):
    got = scoring.score_series(structure.prepared(bars(spark, from_closes(wave)[:60]))).first()
    assert (got.status, got.direction, got.long_score) == ("INSUFFICIENT_HISTORY", None, None)


def test_filtered_markets_take_no_part_in_the_horizon(spark, wave):
    from pyspark.sql import functions as F

    from tidemark.operators import evaluation

    rows = from_closes(wave)
    candles = bars(spark, rows).unionByName(bars(spark, rows, "Y")).unionByName(bars(spark, rows[:100], "Z"))
    out = spark.createDataFrame([("Z", "S")], "exchange string, symbol string")
    whole = evaluation.structure_at_horizon(candles, "1h", 260 * H, ["symbol"]).first()
    assert (whole.horizon_status, whole.usable) == ("relative_lag_stale", False)
    part = evaluation.structure_at_horizon(candles, "1h", 260 * H, ["symbol"], filtered=out).first()
    assert (part.horizon_status, part.common_ms, part.evaluated, part.skipped, part.usable) == ("ok", 259 * H, 2, 1, True)
    facts = evaluation.overlay(structure.prepared(candles.where("exchange = 'X'"))).collect()
    assert {"swing pivot", "internal pivot", "internal event", "liquidity"} <= {r.kind for r in facts}
    assert all(r.confirmed_ms <= 260 * H and (r.ended_ms is None or r.ended_ms > r.event_ms) for r in facts)
    assert candles.where(F.col("exchange") == "Z").count() == 100
