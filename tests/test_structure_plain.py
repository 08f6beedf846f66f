"""Liquidity, order blocks and scores against a second, plain walk over each series, on the given tables and on made
series in which blocks stay open and both sides win."""

import numpy as np
import pytest

from tidemark.functions.indicators import SERIES
from tidemark.operators import scoring, structure, zones
from tidemark.plans import registry
from tidemark.sources.tables import settled

H = 3_600_000
KIND = "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, closed boolean"


def levels_of(bars, pivots, age, tolerance=0.10, least=0.05, wait=2):
    """One pass over the candles. A group of equal pivots waits `wait` candles for no close beyond it, then is a level."""
    singles, groups, known = [], [], []
    for t, b in enumerate(bars):
        atr = b["atr14"]
        for g in groups:
            if g["stage"] == "waits" and t > g["since"]:
                beyond = b["close"] > g["price"] if g["kind"] == "high" else b["close"] < g["price"]
                if beyond:
                    g["stage"] = "gone"
                elif t == g["since"] + wait:
                    g.update(stage="level", born=t, state="OPEN", end=None)
        for p in sorted((p for p in pivots if p["confirmed_ms"] == b["close_ms"]), key=lambda p: (p["kind"] == "low", p["event_ms"])):
            p = dict(p, spent=False)
            known.append(p)
            singles.append({"kind": p["kind"], "origin": "STRUCTURAL", "price": p["price"], "event_ms": p["event_ms"], "born": t, "state": "OPEN", "end": None, "members": []})
            if atr is None:
                continue
            close_to = lambda x: abs(p["price"] - x) <= tolerance * atr  # noqa: B023, E731
            extreme = max if p["kind"] == "high" else min
            homes = [g for g in groups if g["kind"] == p["kind"] and (g["stage"] == "waits" or (g["stage"] == "level" and g["state"] == "OPEN")) and close_to(g["price"])]
            if homes:
                g = sorted(homes, key=lambda g: (g["joined"], g["nth"]))[-1]
                g["members"].append(p)
                g["joined"] = p["confirmed_ms"]
                if g["stage"] == "waits":
                    g.update(price=extreme(g["price"], p["price"]), event_ms=p["event_ms"], since=t)
                continue
            older = [q for q in known if q["kind"] == p["kind"] and not q["spent"] and q["confirmed_ms"] < p["confirmed_ms"] and q["event_ms"] < p["event_ms"] and close_to(q["price"])]
            if older:
                groups.append({"nth": len(groups), "kind": p["kind"], "origin": "EQUAL", "members": [older[-1], p], "price": extreme(older[-1]["price"], p["price"]), "event_ms": p["event_ms"], "since": t, "joined": p["confirmed_ms"], "stage": "waits"})
        for x in singles + [g for g in groups if g["stage"] == "level"]:
            if x["state"] != "OPEN" or x["born"] >= t:
                continue
            top = x["kind"] == "high"
            if (b["close"] > x["price"]) if top else (b["close"] < x["price"]):
                x["state"] = "BROKEN"
            elif atr is not None and ((b["high"] >= x["price"] + least * atr and b["close"] < x["price"]) if top else (b["low"] <= x["price"] - least * atr and b["close"] > x["price"])):
                x["state"] = "SWEPT"
            elif age and t - x["born"] >= age:
                x["state"] = "EXPIRED"
            if x["state"] != "OPEN":
                x["end"] = t
                for m in x["members"]:
                    m["spent"] = True
    return singles + [g for g in groups if g["stage"] == "level"]


def blocks_of(bars, marks, events, gaps, levels, age=750, most=3, within=10, lookback=5):
    place = {b["open_ms"]: k for k, b in enumerate(bars)}
    rising = lambda k, d: (bars[k]["close"] - bars[k]["open"]) * (1 if d == "up" else -1) > 0
    runs = []
    for d in ("up", "down"):
        free = 0
        for k in range(len(bars)):
            if marks.get(bars[k]["open_ms"]) != d or k < free:
                continue
            end = k
            while end - k + 1 < most and end + 1 < len(bars) and rising(end + 1, d):
                end += 1
            free, first = end + 1, k
            while first > 0 and rising(first - 1, "down" if d == "up" else "up"):
                first -= 1
            low, high = min((b["low"] for b in bars[first:k]), default=0), max((b["high"] for b in bars[first:k]), default=0)
            if first < k and high > low:
                runs.append({"dir": d, "start": k, "end": end, "first": first, "bottom": low, "top": high})
    out = []
    for before, e in zip([None, *events], events):
        if e["type"] != "BOS":
            continue
        at = place[e["event_ms"]]
        turned = place[before["event_ms"]] if before and before["type"] == "CHOCH" and before["dir"] == e["dir"] else 0
        fit = [r for r in runs if r["dir"] == e["dir"] and not r.get("used") and turned <= r["end"] <= at and at - r["end"] <= within]
        if not fit:
            continue
        r = max(fit, key=lambda r: r["end"])
        r["used"] = True
        up = e["dir"] == "up"
        inside = lambda b: b["low"] <= r["top"] if up else b["high"] >= r["bottom"]  # noqa: B023, E731
        through = lambda b: b["close"] < r["bottom"] if up else b["close"] > r["top"]  # noqa: B023, E731
        between = bars[r["end"] + 1 : at]
        if any(through(b) for b in between):
            continue
        x = {"dir": e["dir"], "bottom": r["bottom"], "top": r["top"], "event_ms": e["event_ms"], "confirmed_ms": e["confirmed_ms"], "early": sum(map(inside, between)), "touched": None, "retests": 0, "depth": 0.0, "state": "OPEN", "gone": None}
        was = False
        for n, b in enumerate(bars[at + 1 :], 1):
            now = inside(b)
            x["retests"] += now and not was
            was = now
            if now:
                x["touched"] = x["touched"] or b["close_ms"]
                x["state"] = "MITIGATED"
                x["depth"] = max(x["depth"], min(1.0, ((r["top"] - b["low"]) if up else (b["high"] - r["bottom"])) / (r["top"] - r["bottom"])))
            if through(b) or (age and n >= age):
                x["state"], x["gone"] = "INVALIDATED" if through(b) else "EXPIRED", b["close_ms"]
                break
        x["gap"] = any(g["direction"] == e["dir"] and r["first"] <= g["i"] <= r["end"] for g in gaps)
        against = "low" if up else "high"
        x["sweep"] = any(v["state"] == "SWEPT" and v["kind"] == against and 1 <= r["start"] - v["end"] <= lookback for v in levels)
        out.append(x)
    return out


def score_of(bars, pivots, events, inner_events, levels, blocks, inner_blocks, lives, swing):
    """(status, long, short, direction, phases) from facts."""
    w, fresh, last = scoring.WEIGHTS, scoring.FRESH, bars[-1]["i"]
    close_at = {b["close_ms"]: b["i"] for b in bars}
    if len(bars) < 4 * (swing + 1):
        return ("INSUFFICIENT_HISTORY", None, None, None)
    if bars[-1]["atr14"] is None:
        return ("ATR_UNAVAILABLE", None, None, None)
    for kind, code in (("high", "NO_SWING_HIGH"), ("low", "NO_SWING_LOW")):
        if not any(p["kind"] == kind for p in pivots):
            return (code, None, None, None)
    if any(e["type"] == "AMBIGUOUS" for e in events + inner_events):
        return ("AMBIGUOUS_BREAK", None, None, None)

    def trend(found):
        e = max(found, key=lambda e: e["event_ms"], default=None)
        return None if e is None or e["type"] == "CHOCH" else e["dir"]

    def newest(found, bars_, at, born="event_ms"):
        some = [f for f in found if last - close_at[at(f)] <= bars_]
        return max(some, key=lambda f: (at(f), f[born]), default=None)

    points = {"up": 0, "down": 0}
    main, inner = trend(events), trend(inner_events)
    if main:
        points[main] += w["swing"]
    bos = newest([e for e in events if e["type"] == "BOS"], fresh["bos"], lambda e: e["confirmed_ms"])
    if bos and bos["dir"] == main:
        points[main] += w["bos"]
    if inner:
        points[inner] += w["internal"]
    swept = newest([v for v in levels if v["state"] == "SWEPT"], fresh["sweep"], lambda v: bars[v["end"]]["close_ms"])
    if swept:
        points["up" if swept["kind"] == "low" else "down"] += w["sweep"]
    alive = lambda xs: newest([x for x in xs if x["state"] in ("OPEN", "MITIGATED")], fresh["block"], lambda x: x["confirmed_ms"])
    big, small = alive(blocks), alive(inner_blocks)
    for x, name in ((big, "swing_block"), (small, "internal_block")):
        if x:
            points[x["dir"]] += w[name]
    gap = newest([g for g in lives if g["state"] in ("OPEN", "TOUCHED", "CE")], fresh["gap"], lambda g: g["confirmed_ms"])
    if gap:
        points[gap["direction"]] += w["gap"]
    turns = [e for e in events if (e["type"] == "BOS" and e["anchor_price"] is not None) or e["type"] == "CHOCH"]
    if turns and turns[-1]["type"] == "BOS":
        low, high = sorted((turns[-1]["level"], turns[-1]["anchor_price"]))
        at = (bars[-1]["close"] - low) / (high - low)
        if at < 0.5 - scoring.BAND:
            points["up"] += w["range"]
        elif at > 0.5 + scoring.BAND:
            points["down"] += w["range"]
    x = big or small
    if x and gap and x["dir"] == gap["direction"] and x["bottom"] <= gap["top"] and gap["bottom"] <= x["top"]:
        points[x["dir"]] += w["overlap"]
    up, down = points["up"] >= scoring.MINIMUM, points["down"] >= scoring.MINIMUM
    return ("evaluated", points["up"], points["down"], "LONG" if up and not down else "SHORT" if down and not up else "NEUTRAL")


def by_series(df, order):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[c] for c in SERIES), []).append(r.asDict())
    return {k: sorted(v, key=lambda r: r[order]) for k, v in out.items()}


def made(spark, n=240):
    """Series of trends and turns with strong candles."""
    rows = []
    for seed in range(24):
        draw = np.random.default_rng(seed)
        before, drift = 100.0, float(draw.choice([-0.25, 0.25]))
        for k in range(n):
            if k % 60 == 59 and seed % 3:
                drift = -drift
            close = before + drift + float(draw.standard_normal()) * (3.0 if draw.random() < 0.12 else 0.6)
            rows.append(("x", f"S{seed:02}", "1h", k * H, before, max(before, close) + 0.3 * float(draw.random()), min(before, close) - 0.3 * float(draw.random()), close, 1.0, True))
            before = close
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module", params=["tables", "made"])
def series(request, spark):
    candles = registry.hourly(spark, "/root/testdata/sf0.01") if request.param == "tables" else made(spark)
    return request.param, settled(structure.prepared(candles))


def plain_facts(rows, layer, age):
    bars = by_series(rows, "i")
    pivots, events = by_series(structure.both_pivots(rows, layer, layer), "event_ms"), by_series(structure.structure_events(rows, layer, layer), "event_ms")
    marks = {k: {r["open_ms"]: r["direction"] for r in v} for k, v in by_series(structure.displacements(rows), "open_ms").items()}
    gaps = by_series(structure.gaps(rows), "i")
    levels = {k: levels_of(b, pivots.get(k, []), age) for k, b in bars.items()}
    blocks = {k: blocks_of(b, marks.get(k, {}), events.get(k, []), gaps.get(k, []), levels[k]) for k, b in bars.items()}
    return bars, pivots, events, levels, blocks


@pytest.mark.parametrize("layer", [3])
def test_liquidity_and_blocks(series, layer):
    name, rows = series
    bars, _, _, levels, blocks = plain_facts(rows, layer, 60)
    side = {"high": "BUY_SIDE", "low": "SELL_SIDE"}
    found = zones.liquidity_levels(rows, layer, layer, age=60)
    got = sorted((*[r[c] for c in SERIES], r.side, r.origin, r.price, r.event_ms, r.created_ms, r.state, r.resolved_ms or 0) for r in found.collect())
    want = sorted((*k, side[v["kind"]], v["origin"], v["price"], v["event_ms"], bars[k][v["born"]]["close_ms"], v["state"], bars[k][v["end"]]["close_ms"] if v["end"] else 0) for k, vs in levels.items() for v in vs)
    assert got == want
    assert {w[4] for w in want} == {"STRUCTURAL", "EQUAL"} and {w[-2] for w in want} == {"OPEN", "BROKEN", "SWEPT", "EXPIRED"}
    given = settled(found)
    got = zones.order_blocks(rows, structure.structure_events(rows, layer, layer), structure.gaps(rows), given).collect()
    got = sorted((*[r[c] for c in SERIES], r.dir, r.bottom, r.top, r.event_ms, r.early_touches, r.touched_ms or 0, r.retests, round(r.depth, 9), r.invalidated_ms or r.expired_ms or 0, r.has_gap, r.has_sweep, r.state) for r in got)
    want = sorted((*k, x["dir"], x["bottom"], x["top"], x["event_ms"], x["early"], x["touched"] or 0, x["retests"], round(x["depth"], 9), x["gone"] or 0, x["gap"], x["sweep"], x["state"]) for k, xs in blocks.items() for x in xs)
    assert got == want
    if name == "made" and layer == 3:
        assert {w[-1] for w in want} == {"OPEN", "MITIGATED", "INVALIDATED"} and any(w[-2] for w in want) and any(w[-3] for w in want)


def test_scores(series):
    name, rows = series
    swing, inner = (20, 3) if name == "tables" else (5, 2)
    bars, pivots, events, levels, blocks = plain_facts(rows, swing, 0)
    _, _, inner_events, _, inner_blocks = plain_facts(rows, inner, 0)
    lives = by_series(structure.gap_lives(rows, structure.gaps(rows), 0), "confirmed_ms")
    of = lambda d, k: d.get(k, [])
    want = {k: score_of(b, of(pivots, k), of(events, k), of(inner_events, k), of(levels, k), of(blocks, k), of(inner_blocks, k), of(lives, k), swing) for k, b in bars.items()}
    got = {tuple(r[c] for c in SERIES): (r.status, r.long_score, r.short_score, r.direction) for r in scoring.score_series(rows, swing, inner).collect()}
    assert got == want
    if name == "made":
        assert {w[3] for w in want.values()} >= {"LONG", "SHORT", "NEUTRAL"}


def test_reasons_name_facts(series):
    """Blocks and gaps behind a reason are facts by their keys; other reasons name none."""
    from tidemark.operators import facts

    name, rows = series
    if name == "tables":
        pytest.skip("no series is fresh enough")
    scores = settled(scoring.score_series(rows, 5, 2))
    why = scoring.reasons(scores).collect()
    keys = {r.key for r in facts.all_versions(rows, 5, 2).select("key").distinct().collect()}
    named = [r for r in why if r.fact_ids]
    assert {r.code for r in named} == {"SWING_ORDER_BLOCK", "INTERNAL_ORDER_BLOCK", "FVG"} and all(k in keys for r in named for k in r.fact_ids)
    assert all(r.value.startswith(r.fact_ids[0] + " (") for r in named)
    one = scores.where("status = 'evaluated'").limit(1).collect()[0]
    both = rows.sparkSession.createDataFrame([one], scores.schema).selectExpr("* except (conflict)", "true as conflict")
    last = scoring.reasons(both).collect()[-1]
    assert (last.code, last.long, last.short, last.weight, last.value) == ("DIRECTION_CONFLICT", False, False, 0.0, f"long={one.long_score};short={one.short_score} (0/0)")
