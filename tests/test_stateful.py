"""Streams with state against the whole series in one piece."""

import numpy as np
import pytest

from tidemark.functions import indicators as ind
from tidemark.operators import structure
from tidemark.streaming import series as st

H = 3_600_000
KIND = "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, closed boolean"


def candles(seed, n, name):
    draw = np.random.default_rng(seed)
    close = np.round(100 + np.cumsum(draw.standard_normal(n)) + 6 * np.sin(np.arange(n) / 7), 1)
    spread = np.round(draw.random((2, n)), 1)
    return [("x", name, "1h", k * H, float(c), float(c + u), float(c - d), float(c), float(v), True) for k, (c, u, d, v) in enumerate(zip(close, *spread, draw.integers(0, 9, n)))]


@pytest.fixture(scope="module")
def rows():
    return sorted(candles(1, 260, "A") + candles(2, 110, "B") + candles(3, 20, "C"), key=lambda r: r[3])


def streamed(spark, tmp_path, rows, cuts, make):
    """The sink's rows; the query is stopped after each file and started from its checkpoint."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for a, z in zip([0, *cuts], [*cuts, len(rows)]):
        spark.createDataFrame(rows[a:z], KIND).coalesce(1).write.mode("append").parquet(folder)
        stream = make(spark.readStream.schema(KIND).parquet(folder))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(240)
    return spark.read.parquet(out)


def test_indicators(spark, tmp_path, rows):
    late = [(*rows[5][:7], 1.0, *rows[5][8:])]  # an old candle in a later batch
    got = streamed(spark, tmp_path, rows[:200] + late + rows[200:], [7, 90, 150], st.indicator_stream).collect()
    want = ind.with_indicators(spark.createDataFrame(rows, KIND)).collect()
    key = lambda r: (r.symbol, r.open_ms)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    early = ("macd", "macd_signal", "macd_hist")
    nth = {s: 0 for s in "ABC"}
    for a, b in zip(got, want):
        nth[a.symbol] += 1
        for c in b.asDict():
            x, y = a[c], b[c]
            if c in early and nth[a.symbol] < 35:
                assert x is None
            elif isinstance(y, float):
                assert x is not None and abs(x - y) <= 1e-9 * max(1, abs(y)), (key(a), c)
            else:
                assert x == y


@pytest.mark.parametrize(("left", "right"), [(3, 3), (2, 4)])
def test_structure(spark, tmp_path, rows, left, right):
    got = streamed(spark, tmp_path, rows, [40, 41, 230], lambda s: st.structure_stream(s, left, right)).collect()
    want = structure.structure_events(structure.horizon(spark.createDataFrame(rows, KIND)), left, right).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 12
    assert {r.type for r in want} >= {"BOS", "CHOCH"}


def test_the_bars_that_are_kept():
    """A state holds the bars of two sides and of open plateaus, not the series."""
    p = st.Structure(5, 5)
    bars = []
    for k in range(500):
        bars = p.trimmed([*bars, {"i": k, "open_ms": k, "high": float(k % 13), "low": float(-(k % 11))}])
        assert len(bars) <= 12
