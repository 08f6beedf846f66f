"""Joins by time and global ranks against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_last_at_or_before(spark, width):
    draw = np.random.default_rng(width)
    left = [(["a", "b", None][int(draw.integers(3))], int(t), n) for n, t in enumerate(draw.integers(-5, 120, 200))] + [("a", None, 999), ("c", 5, 1000)]
    right = [(["a", "b", None][int(draw.integers(3))], int(t), float(n), "x") for n, t in enumerate(draw.integers(0, 100, 60))] + [("a", None, 1.0, "y"), ("a", 7, 1.0, "p"), ("a", 7, 2.0, "q")]
    got = asof.last_at_or_before(spark.createDataFrame(left, "k string, at long, n long").repartition(3), spark.createDataFrame(right, "k string, t long, v double, w string"), ["k"], "at", "t", ["v", "w"], width)
    assert got.columns == ["k", "at", "n", "v", "w"]
    rows = {r.n: (r.v, r.w) for r in got.collect()}
    assert len(rows) == len(left)
    for k, at, n in left:
        known = [r[1:] for r in right if k is not None and r[0] == k and at is not None and r[1] is not None and r[1] <= at]
        assert rows[n] == (max(known)[1:] if known else (None, None)), (k, at)


def test_ranks(spark):
    draw = np.random.default_rng(1)
    rows = [(f"s{n}", float(v)) for n, v in enumerate(draw.integers(0, 40, 500))]
    got = asof.ranked(spark.createDataFrame(rows, "symbol string, score double").repartition(7), [F.col("score").desc(), F.col("symbol")])
    want = {s: k for k, (s, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r.symbol: r["rank"] for r in got.collect()} == want
    assert asof.ranked(spark.createDataFrame([], "symbol string, score double"), [F.col("symbol")]).count() == 0
    assert not [n for n in got._jdf.queryExecution().executedPlan().toString().split() if n == "SinglePartition"]
