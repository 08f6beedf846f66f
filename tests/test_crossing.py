"""First crossings against a walk, in chunks of any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import crossing

H = 3_600_000
ROWS = "exchange string, symbol string, timeframe string, i long, close_ms long, high double, low double"


def walk(rows, start, value, above, strict, price):
    for k in range(start + 1, len(rows)):
        v = rows[k][value]
        if not math.isnan(v) and ((v > price or (v == price and not strict)) if above else (v < price or (v == price and not strict))):
            return k
    return None


@pytest.mark.parametrize("size", [1, 3, 16, 1 << 16])
def test_probes(spark, size):
    draw = np.random.default_rng(size)
    made, asked = [], []
    for s in ("A", "B"):
        v = np.round(np.cumsum(draw.standard_normal(90)), 1)
        rows = [{"high": float(x + draw.integers(0, 2)), "low": float(x) if draw.random() > 0.05 else math.nan} for x in v]
        made += [("x", s, "1h", k, k * H, r["high"], r["low"]) for k, r in enumerate(rows)]
        for n in range(120):
            start, value = int(draw.integers(-1, 90)), ("high", "low")[n % 2]
            above, strict = bool(draw.integers(2)), bool(draw.integers(2))
            price = float(draw.choice(v)) + float(draw.integers(-3, 4))
            rest = [r[value] for r in rows[start + 1 :] if not math.isnan(r[value])]
            asked.append(((s, n), start, value, above, strict, price, walk(rows, start, value, above, strict, price), (max if above else min)(rest, default=None)))
    candles = spark.createDataFrame(made, ROWS).repartition(3)
    probes = spark.createDataFrame([("x", k[0], "1h", k[1], start, value, above, strict, price) for k, start, value, above, strict, price, _, _ in asked], "exchange string, symbol string, timeframe string, n int, from_i long, value string, above boolean, strict boolean, price double")
    probes = probes.select("exchange", "symbol", "timeframe", "n", "from_i", F.struct(F.lit("p").alias("name"), "value", "above", "strict", "price").alias("probe"))
    got = {(r.symbol, r.n): r for r in crossing.first_crossings(candles, probes, ["n"], ["high", "low"], size).collect()}
    assert len(got) == len(asked)
    for k, *_, want, extreme in asked:
        assert got[k].found_i == want and got[k].found_ms == (None if want is None else want * H), k
        if want is None:
            assert got[k].extreme == extreme, k
    assert 20 < sum(a[-2] is None for a in asked) < 200


def test_highest_of_nothing():
    none = crossing.Highest(np.empty(0))
    assert none.first(np.array([0, 5]), np.array([1.0, 2.0]), np.array([True, False])).tolist() == [0, 0]
