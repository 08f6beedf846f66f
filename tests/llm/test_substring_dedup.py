"""Substring dedup against counting all windows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import substring_dedup as sd

SCHEMA = "extra int, doc_id long, text string, pieces string, th long"


def brute(rows, window):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k for s in range(len(w) - window + 1) if count[tuple(w[s : s + window])] > 1 for k in range(s, s + window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows, window, **sizes):
    df = spark.createDataFrame([(7, i, t, "x", 0) for i, t in rows], SCHEMA).repartition(3)
    got = sd.remove_repeats(df, window=window, **sizes)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect())


def corpus(seed, n=60, vocabulary=400):
    """Documents with passages in common, near copies, periodic stretches, copies, null, empty and shared ids."""
    draw = np.random.default_rng(seed)
    word = lambda: f"w{draw.integers(vocabulary)}"
    text = lambda n: [word() for _ in range(n)]
    passage, base = text(50), text(120)
    rows = []
    for k in range(n):
        t = text(int(draw.integers(0, 90)))
        if k % 3 == 0:
            at, a = int(draw.integers(0, len(t) + 1)), int(draw.integers(0, 20))
            t[at:at] = passage[a : a + int(draw.integers(5, 50))]
        if k % 7 == 0:
            t = list(base)
            for _ in range(3):
                t[int(draw.integers(0, len(t)))] = word()
        if k % 11 == 0:
            t += ["a", "b"] * int(draw.integers(1, 40)) + ["a"] * int(draw.integers(0, 60))
        rows.append((k, ["\x0b", " ", "\t ", "\r\n"][k % 4].join(t)))
    rows += [(0, rows[0][1]), (3, rows[3][1]), (3, rows[6][1]), (None, rows[9][1]), (None, None), (None, None), (900, ""), (901, " \t\x0c"), (902, "é ü\x1c " * 30), (None, rows[9][1])]
    return rows


@pytest.mark.parametrize(("seed", "window", "sizes"), [(1, 35, {}), (2, 12, {"gram": 5}), (3, 12, {"gram": 5, "crowd": 2, "shard_words": 50}), (4, 7, {"gram": 7, "shard_words": 300}), (5, 10, {"gram": 1, "crowd": 0})])
def test_against_all_windows(spark, seed, window, sizes):
    rows = corpus(seed)
    want = brute(rows, window)
    assert run(spark, rows, window, **sizes) == want
    assert sum(w[2] > 0 for w in want) > 10 and sum(w[2] == 0 for w in want) > 10


def test_long_texts_and_kept_text(spark):
    """A document of some megabytes that holds a passage of another and one of its own twice."""
    draw = np.random.default_rng(9)
    long = [f"x{v}" for v in draw.integers(0, 1 << 40, 300_000)]
    long[200_000:200_040] = long[100:140]
    rows = [(1, " ".join(long)), (2, "head " + " ".join(long[5_000:5_035]) + " tail"), (3, "head " + " ".join(long[7_000:7_034]) + " tail")]
    assert run(spark, rows, 35) == brute(rows, 35)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in sd.remove_repeats(df, with_text=True).collect()}
    assert kept[2] == "head tail" and kept[3] == rows[2][1] and len(kept[1].split(" ")) == 300_000 - 115


def test_empty_tables(spark):
    assert run(spark, [], 35) == []
    assert run(spark, [(1, None)], 35) == brute([(1, None)], 35)


def test_slices_of_a_batch(monkeypatch):
    """However words are cut into slices, pieces hold each window once."""
    words = pa.array([f"w{v}" for v in np.random.default_rng(0).integers(0, 5, 500)])
    h, ends = sd.hashed(words), np.repeat([200, 210, 500], [200, 10, 290])
    at, n, _, _ = sd.pieces_of(h, ends, 12, 4)
    starts = [s for a, m in zip(at, n) for s in range(a, a + m - 11)]
    assert starts == [s for s in range(500) if s + 12 <= ends[s]]
    one = [(w, g, x) for w, g, x in zip(n, *sd.pieces_of(h, ends, 12, 4)[2:])]
    again = [(w, g, x) for w, g, x in zip(n[:3], *sd.pieces_of(h[:200], ends[:200], 12, 4)[2:])]
    assert one[:3] == again


def test_automaton_against_counting():
    draw = np.random.default_rng(4)
    rows = [(draw.integers(0, 3, draw.integers(1, 30)).tolist(), int(draw.integers(1, 3))) for _ in range(40)]
    shard, count = sd.SuffixAutomaton(), Counter()
    for tokens, copies in rows:
        shard.add(tokens, copies)
        for i in range(len(tokens)):
            for j in range(i, len(tokens)):
                count[tuple(tokens[i : j + 1])] += copies
    shard.settle()
    for tokens in [r[0] for r in rows] + [draw.integers(0, 4, 60).tolist() for _ in range(20)]:
        for least in (1, 2, 5):
            want = [max([e - s for s in range(e) if count[tuple(tokens[s:e])] >= least], default=0) for e in range(1, len(tokens) + 1)]
            assert list(shard.matching(tokens, least)) == want


def test_words_are_cut_at_ascii_white_space():
    every = "".join(f"a{chr(c)}" for c in [*range(1, 0x250), 0x2003, 0x2028, 0x3000, 0xFEFF])
    texts = [every, "", "  ", None, " a", "b "]
    offsets, words = sd.words_of(pa.array(texts))
    want = [(t or "").encode().split() for t in texts]
    assert [[w.encode() for w in words[a:b].to_pylist()] for a, b in zip(offsets, offsets[1:])] == want
