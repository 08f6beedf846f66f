"""The manifest against trees built node by node."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle

SCHEMA = "hash string, doc_id long, text string, lang string, source string, n_chars long, pos int, g string"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(*fields):
    return H("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(leaves):
    """(root, siblings of each leaf as (left, right) level by level)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([H("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
    proofs = []
    for p in range(len(leaves)):
        steps = []
        for level in levels[:-1]:
            r = p // 3 * 3
            steps.append(("".join(level[r:p]), "".join(level[p + 1 : r + 3])))
            p //= 3
        proofs.append(steps)
    return levels[-1][0], proofs


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by = {}
    for i, text, lang, source, n in rows:
        own = leaf(i, source, lang, n, text)
        odd = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        other = leaf(i, source, lang, n, None if text is None else text.replace("\n", "")) if odd else own
        by.setdefault(source, []).append((i is not None, i or 0, own, other, i))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in by[s]])
    root, above = tree([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for s, up in zip(order, above):
        for (_, _, own, other, i), steps in zip(by[s], trees[s][1]):
            node = other
            for left, right in steps + up:
                node = H(left + node + right)
            out.append((str(i), own, trees[s][0], root, H("".join(a + b for a, b in steps + up)), node, node == root))
    return sorted(out)


def run(spark, rows, parts=5):
    df = spark.createDataFrame([("x", i, t, lang, s, n, 3, "y") for i, t, lang, s, n in rows], SCHEMA).repartition(parts)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")
    got = merkle.verified_rows(df, tampered)
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())


def corpus(seed, sizes):
    draw = np.random.default_rng(seed)
    rows = [(int(i), f"text {i}\nmore é {draw.integers(9)}" + "\n" * int(draw.integers(2)), ["en", None][i % 2], s, int(i)) for s, n in sizes.items() for i in draw.choice(10_000, n, replace=False)]
    return rows


def test_against_trees_node_by_node(spark):
    rows = corpus(1, {"a": 800, "b": 1, "é": 3, "Z": 243, "c": 244, "d": 30, "": 2})
    rows += [(None, None, None, None, None), (None, "x\n", None, None, 2), (5, None, None, None, None), (5, "", "en", "a", 0), (5, "", "en", "a", 0), (7, "one\ntwo", "en", "a", 7), (7, "one\nthree", "en", "a", 7)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert 0 < sum(w[6] for w in want) < len(want)


def test_many_sources(spark):
    """More sources than a block has leaves, so that subroots take two rounds."""
    rows = [(i, f"t\n{i}", "en", f"s{i % 300}", i) for i in range(700)]
    assert run(spark, rows) == brute(rows)


def test_a_block_of_blocks(spark, monkeypatch):
    """Three rounds, with blocks of nine leaves."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = corpus(2, {"a": 300, "b": 82, "c": 81, "d": 9, "e": 10, **{f"s{k}": 1 for k in range(90)}})
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 4])
def test_small_tables(spark, n):
    rows = [(i, f"a\nb{i}", "en", "s", i) for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_long_texts(spark):
    rows = [(1, "same\n", "en", "s", 5)] * 600 + [(2, "long \n" * 400_000, "en", "s", 5)]
    assert run(spark, rows) == brute(rows)
