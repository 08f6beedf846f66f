"""Whitening against numpy's own eigenvectors and whole numbers of any size."""

import math

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "x int, vec_id long, embedding array<float>, n long, component int"


def brute(rows):
    """{(id as text, component): (n, deviation, |whitened|, explained)}"""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    ints = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in good]
    fit = sorted({tuple(x) for _, x in ints})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    c = np.array([[(n * x[k] - sums[k]) / n for k in range(d)] for x in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:16]
    trace = values.sum()
    out = []
    for i, x in ints:
        y = np.array([(n * x[k] - sums[k]) / n for k in range(d)])
        for m, k in enumerate(order, 1):
            if values[k] > 1e-9 * trace:
                out.append((str(i), m, n, sum((n * x[k] - sums[k]) ** 2 for k in range(d)), y @ vectors[:, k] / math.sqrt(values[k]), values[k] / trace))
    return sorted(out, key=lambda r: (r[0], r[1], r[3], abs(r[4])))


def check(spark, rows):
    df = spark.createDataFrame([(1, i, v, 0, 3) for i, v in rows], SCHEMA).repartition(4)
    got = whitening.whiten(df).collect()
    want = brute(rows)
    got.sort(key=lambda r: (str(r.vec_id), r.component, r.deviation, abs(r.whitened)))
    assert [(str(r.vec_id), r.component, r.n, int(r.deviation)) for r in got] == [w[:4] for w in want]
    for k in range(1, 17):  # either sign, the same for all rows
        a, b = np.array([r.whitened for r in got if r.component == k]), np.array([w[4] for w in want if w[1] == k])
        if len(a):
            sign = np.sign(a @ b)
            assert np.allclose(a * sign, b, rtol=1e-9, atol=1e-9) if sign else np.allclose(a, b)
    assert all(abs(r.explained - w[5]) <= 1e-9 * w[5] for r, w in zip(got, want))
    assert len({r.identity_error for r in got}) <= 1 and all(0 <= r.identity_error < 1e-9 for r in got)
    return got


def vectors(seed, n, d):
    draw = np.random.default_rng(seed)
    return (draw.standard_normal((n, d)) * np.linspace(3, 0.5, d) + draw.standard_normal(d) * 4) @ np.linalg.qr(draw.standard_normal((d, d)))[0]


def test_against_numpy(spark):
    """Null, empty, non-finite and ragged vectors, null and shared ids, repeated rows."""
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors(1, 400, 24))]
    odd = [(1000, None), (1001, []), (1002, [None] * 24), (1003, [float("nan")] + [0.0] * 23), (1004, [0.0] * 23 + [float("-inf")])]
    rows += [(None, rows[3][1]), (None, rows[4][1]), (5, rows[9][1]), (5, rows[5][1]), *odd]
    got = check(spark, rows)
    assert len(got) == 404 * 16
    df = spark.createDataFrame([*rows, (77, [1.0] * 5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(df).count() == 404 * 16


def test_a_third_of_all_rows_alike(spark):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors(2, 60, 5))]
    got = check(spark, rows + [(100 + k, rows[0][1]) for k in range(90)])
    assert {r.n for r in got} == {60} and {r.component for r in got} == {1, 2, 3, 4, 5}


def test_fewer_components_than_dimensions(spark):
    """Vectors of a plane, and of no extent."""
    plane = np.random.default_rng(3).integers(-50, 50, (80, 2)) @ np.array([[1, 2, 3, 4], [2, -1, 0, 5]])
    got = check(spark, [(i, [float(c) for c in v / 4]) for i, v in enumerate(plane)])
    assert {r.component for r in got} == {1, 2}
    for rows in ([], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])], [(1, None)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert whitening.whiten(df).collect() == []


def test_large_entries_do_not_crash(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df, components=1).collect()
    assert len(got) == 3 and got[0].n == 3


@pytest.mark.parametrize(("n", "high"), [(3, 50), (1 << 20, 1 << 20), (1 << 40, 1 << 30)])
def test_deviation_is_exact(n, high):
    draw = np.random.default_rng(4)
    x = draw.integers(0, high, (50, 8))
    sums = tuple(int(v) for v in draw.integers(0, min(n * high, 1 << 62), 8))
    want = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert whitening.Centre(n, sums).deviation(x) == want


@pytest.mark.parametrize(("n", "rank"), [(1, 1), (2, 2), (9, 9), (64, 64), (40, 7)])
def test_eigen(n, rank):
    """Values over twelve orders of magnitude keep their digits."""
    draw = np.random.default_rng(n)
    q = np.linalg.qr(draw.standard_normal((n, n)))[0][:, :rank]
    want = np.logspace(6, -1 if rank == n else 3, rank)
    values, found = whitening.eigen((q * want) @ q.T)
    assert len(values) == rank
    assert np.allclose(values, want, rtol=1e-7 if rank == n else 1e-9)
    assert np.allclose(found.T @ found, np.eye(rank), atol=1e-12)
    assert np.allclose(np.abs((found * q).sum(axis=0)), 1, atol=1e-7)
