"""Indicators and structure on hand-made series: independent formulas, boundaries, no look-ahead, mirror symmetry."""

import math

import numpy as np
import pytest

from tidemark.functions import indicators as ind
from tidemark.operators import structure

H = 3_600_000


def walk(n, seed=42):
    """A linear congruential walk in cents."""
    state, price, out = seed, 100.0, []
    for _ in range(n):
        state = state * 16807 % 2147483647
        price *= 1 + (state / 2147483647 - 0.5) / 40
        out.append(round(price, 2))
    return np.array(out)


def test_ema_is_its_closed_form():
    x, p = walk(60), 10
    k, got = 2 / (p + 1), ind.ema(x, p)
    assert np.isnan(got[: p - 1]).all() and got[p - 1] == pytest.approx(x[:p].mean())
    i = 40
    want = x[:p].mean() * (1 - k) ** (i - p + 1) + sum(k * (1 - k) ** (i - j) * x[j] for j in range(p, i + 1))
    assert got[i] == pytest.approx(want)


def test_pieces_are_as_good_as_the_whole():
    x = walk(150)
    for first, period in ((0, 1), (0, 10), (1, 14), (25, 9), (0, 200)):
        whole = ind.smoothed(x, first, period, 0.2)
        for size in (1, 7, 60):
            s = ind.Smoother(first, period, 0.2)
            pieces = np.concatenate([s.feed(x[i : i + size]) for i in range(0, len(x), size)])
            np.testing.assert_allclose(pieces, whole, rtol=1e-12)


def test_long_series_in_small_batches(spark):
    """Several series in one task, cut into batches anywhere, against the whole arrays."""
    rows = from_closes(walk(700))
    df = bars(spark, rows).unionByName(bars(spark, rows[:300], "Y")).unionByName(bars(spark, rows[:20], "Z"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "37")
    got = ind.with_indicators(df).toPandas().sort_values(["exchange", "open_ms"])
    spark.conf.set(name, before)
    o, h, low, c = (np.array(v) for v in zip(*rows))
    for exchange, n in (("X", 700), ("Y", 300), ("Z", 20)):
        own = got[got.exchange == exchange]
        line, signal = ind.macd(c[:n], 12, 26, 9)
        for column, want in (("ema200", ind.ema(c[:n], 200)), ("rsi14", ind.rsi(c[:n])), ("macd", line), ("macd_signal", signal), ("atr14", ind.atr(h[:n], low[:n], c[:n]))):
            np.testing.assert_allclose(own[column].to_numpy(float), want, rtol=1e-9)


def test_rsi_bounds_and_flat_series():
    assert np.nanmax(ind.rsi(walk(200))) <= 100
    flat = ind.rsi(np.full(30, 5.0))
    assert np.isnan(flat[:14]).all() and (flat[14:] == 100).all()


def test_macd_starts_where_it_should():
    line, signal = ind.macd(walk(34), 12, 26, 9)
    assert np.isnan(line).all() and np.isnan(signal).all()
    line, signal = ind.macd(walk(35), 12, 26, 9)
    assert np.isnan(line[24]) and not np.isnan(line[25]) and np.isnan(signal[32]) and not np.isnan(signal[33])
    assert signal[33] == pytest.approx(line[25:34].mean())


def bars(spark, rows, exchange="X"):
    data = [(exchange, "S", "1h", i * H, float(o), float(h), float(low), float(c), 1.0, True) for i, (o, h, low, c) in enumerate(rows)]
    return spark.createDataFrame(data, "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, closed boolean")


def from_closes(closes, wick=1.0):
    before = np.concatenate([closes[:1], closes[:-1]])
    return [(o, max(o, c) + wick, min(o, c) - wick, c) for o, c in zip(before, closes)]


def test_pivot_plateau_and_confirmation(spark):
    highs = [1, 2, 5, 5, 2, 1, 1, 3]
    rows = structure.horizon(bars(spark, [(h - 0.5, h, h - 1, h - 0.5) for h in highs]))
    got = structure.pivots(rows, 2, 2, "high").collect()
    assert [(r.price, r.event_ms // H, r.confirmed_ms // H) for r in got] == [(5.0, 2, 6)]


def test_pivot_waits_for_right_context(spark):
    highs = [1, 2, 5, 5, 2]
    rows = structure.horizon(bars(spark, [(h - 0.5, h, h - 1, h - 0.5) for h in highs]))
    assert structure.pivots(rows, 2, 2, "high").count() == 0


@pytest.fixture(scope="module")
def wave():
    return 100 + 6 * np.sin(np.arange(220) / 4) + np.cumsum(np.where(np.arange(220) < 110, 0.15, -0.2)) + (walk(220) - 100) / 10


def test_no_look_ahead(spark, wave):
    whole = structure.structure_events(structure.horizon(bars(spark, from_closes(wave))), 3, 3).collect()
    assert len(whole) > 5
    for n in (80, 140, 190):
        part = structure.structure_events(structure.horizon(bars(spark, from_closes(wave)[:n])), 3, 3).collect()
        assert sorted(map(tuple, part), key=repr) == sorted((tuple(r) for r in whole if r.confirmed_ms <= n * H), key=repr)


def test_mirror(spark, wave):
    shape = lambda rs, up: [(r.type, (r.dir == "up") == up, r.event_ms) for r in sorted(rs, key=lambda r: r.event_ms)]
    plain = structure.structure_events(structure.horizon(bars(spark, from_closes(wave))), 3, 3).collect()
    turned = structure.structure_events(structure.horizon(bars(spark, [(-o, -low, -h, -c) for o, h, low, c in from_closes(wave)])), 3, 3).collect()
    assert shape(plain, True) == shape(turned, False)


def test_gap_life(spark):
    rows = [(10, 11, 9, 10)] * 16 + [(10, 11, 9, 11), (11, 15, 11, 15), (15, 16, 13, 15), (15, 15, 12, 14), (14, 14, 10.5, 10.8)]
    ready = structure.prepared(bars(spark, rows))
    lives = structure.gap_lives(ready, structure.gaps(ready), 500).collect()
    assert len(lives) == 1
    g = lives[0]
    assert (g.direction, g.bottom, g.top, g.event_ms // H) == ("up", 11.0, 13.0, 17)
    assert (g.touched_ms // H, g.half_ms // H, g.filled_ms // H, g.invalidated_ms // H) == (20, 20, 21, 21)
    assert g.state == "INVALIDATED" and g.fill == 1.0 and g.expired_ms is None


def test_equal_edges_make_no_gap(spark):
    rows = [(10, 11, 9, 10)] * 17 + [(11, 15, 11, 15), (15, 16, 11, 15)]
    assert structure.gaps(structure.prepared(bars(spark, rows))).count() == 0


def test_math_of_empty_series(spark):
    empty = bars(spark, [])
    assert ind.with_indicators(empty).count() == 0
    assert structure.structure_events(structure.horizon(empty), 3, 3).count() == 0
    assert math.isnan(ind.ema(np.array([1.0]), 2)[0])
