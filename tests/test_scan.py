"""Indicators by a parallel scan against one pass over each series."""

import numpy as np
import pytest

from tidemark.functions import indicators as ind
from tidemark.functions import scan

H = 3_600_000
KIND = "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, closed boolean"


def series(seed, n, name="A", gaps=0.1, timeframe="1h"):
    draw = np.random.default_rng(seed)
    at = np.cumsum(1 + (draw.random(n) < gaps) * draw.integers(1, 40, n))
    close = 100 + np.cumsum(draw.standard_normal(n))
    high, low = close + draw.random(n), close - draw.random(n)
    return [("x", name, timeframe, int(t) * H, float(c), float(h), float(lo), float(c), float(v), bool(t % 97)) for t, c, h, lo, v in zip(at, close, high, low, draw.integers(0, 9, n))]


def same(spark, rows, periods, size):
    candles = spark.createDataFrame(rows, KIND).repartition(5)
    key = lambda r: (r.exchange, r.symbol, r.timeframe, r.open_ms)
    want = sorted(ind.with_indicators(candles, periods).collect(), key=key)
    got = sorted(scan.indicators_in_chunks(candles, periods, size).collect(), key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    for c in want[0].asDict() if want else ():
        a, b = [r[c] for r in got], [r[c] for r in want]
        assert [x is None for x in a] == [x is None for x in b], c
        if c not in (*ind.SERIES, "open_ms"):
            assert np.allclose([x for x in a if x is not None], [x for x in b if x is not None], rtol=1e-9, atol=1e-9), c
    return got


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 100_000])
def test_chunks_of_any_size(spark, size):
    """Means begin within a chunk, across several, or the series is shorter than they are."""
    rows = [*series(1, 600), *series(2, 230, "B"), *series(3, 34, "C"), *series(4, 1, "D"), *series(5, 90, timeframe="4h")]
    same(spark, rows, ind.PERIODS, size)


@pytest.mark.parametrize("periods", [{"ema": (2, 3, 4), "rsi": 2, "macd": (2, 3, 2), "atr": 2, "volume": 1}, {"ema": (9, 1, 120), "rsi": 7, "macd": (5, 8, 40), "atr": 30, "volume": 50}])
def test_other_periods(spark, periods):
    same(spark, [*series(6, 400), *series(7, 60, "B")], periods, 25)


def test_no_candles(spark):
    assert same(spark, [], ind.PERIODS, 10) == []


def test_geometric_sums():
    for ratio, weight, n in [(0.9, 0.2, 5), (0.8, 0.2, 7), (0.5, 0.9, 1), (11 / 13, 0.2, 100_000)]:
        state = 0.0
        for k in range(1, min(n, 5000) + 1):
            state += (ratio**k - state) * weight
        assert abs(scan.geometric(ratio, weight, n) - (state if n <= 5000 else 0.0)) < 1e-12


def test_one_long_series(spark):
    """Two hundred thousand candles of one series, over some twenty tasks."""
    rows = series(8, 200_000, gaps=0.0)
    got = same(spark, rows, ind.PERIODS, 10_000)
    assert len(got) > 190_000


@pytest.mark.parametrize("batch", [50, 200])
def test_batches_that_end_where_the_head_does(spark, batch):
    """The head of a series has 200 candles, and a batch of 50 or 200 rows ends with it, amid a chunk."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, batch)
    try:
        same(spark, series(9, 420, gaps=0.0), ind.PERIODS, 300)
    finally:
        spark.conf.set(name, before)
