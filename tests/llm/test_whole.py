"""Whole operators and the pipeline against plain Python that shares none of their code but the n-gram buckets."""

import hashlib
import math
import struct
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tests.llm.test_llm import BENCH, DOCS, brute_lines, frame  # noqa: E402
from tidemark.llm import decontamination, language, line_dedup, pieces, quality, sharding, simhash, token_counts, token_files  # noqa: E402


def xx(*values, seed=42):
    """Spark's xxhash64 of longs, ints (as (4, value)) and strings, signed; a null changes nothing."""
    import xxhash

    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<i", v[1]) if isinstance(v, tuple) else struct.pack("<q", v)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_quality(rows, labels):
    """rows: (id, text); labels: {id: quality}. (log weight, noisy, kept) of each row."""
    found = [Counter(quality.features(t).tolist()) for _, t in rows]
    raw, target = Counter(), Counter()
    for (i, _), c in zip(rows, found):
        raw.update(c)
        if labels.get(i) == 1:
            target.update(c)
    n = quality.BUCKETS
    share = [raw[k] + 0.5 for k in range(n)]
    total = sum(share)
    share = [s / total for s in share]
    pulled = [target[k] + 2.0 * n * share[k] for k in range(n)]
    total = sum(pulled)
    log = [math.log(p / total / s) for p, s in zip(pulled, share)]
    weight = [sum(log[k] * m for k, m in c.items()) for c in found]
    noisy = []
    for (i, t), w in zip(rows, weight):
        u = ((xx(i, xx(t), (4, 7)) % (1 << 64) >> 11) + 0.5) / (1 << 53)
        noisy.append(w - math.log(-math.log(u)))
    least = {}
    for (i, _), w in zip(rows, weight):
        if i in labels:
            least[i] = min(w, least.get(i, w))
    known = sorted((w, labels[i]) for i, w in least.items())
    good, bad = sum(q == 1 for _, q in known), sum(q != 1 for _, q in known)
    if not good or not bad:
        return [(w, x, True) for w, x in zip(weight, noisy)]
    cuts = []
    for (a, _), (b, _) in zip(known, known[1:]):
        if b > a:
            right = sum(w <= a and q != 1 for w, q in known) / bad - sum(w <= a and q == 1 for w, q in known) / good
            cuts.append((right, b - a, (a + b) / 2))
    best = max(c[0] for c in cuts)
    cut = max((c for c in cuts if c[0] >= best - 0.02), key=lambda c: c[1])[2]
    k = sum(w >= cut for w in weight)
    edge = sorted(noisy, reverse=True)[k - 1] if k else math.inf
    return [(w, x, x >= edge) for w, x in zip(weight, noisy)]


def prose(draw, n, words):
    return " ".join(draw.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def documents():
    """Good and bad prose with copies, near copies, shared lines, benchmark passages, null and shared ids, null texts."""
    draw = np.random.default_rng(3)
    fine = ["".join(draw.choice(list("aeionrstl")) for _ in range(draw.integers(2, 8))) for _ in range(150)]
    junk = ["BUY", "NOW!!", "CHEAP$$", "CLICK", "WIN##"]
    line = lambda n, words: " ".join(draw.choice(words) for _ in range(n))
    rows = [(i, "\n".join(line(int(draw.integers(8, 40)), fine) for _ in range(3))) for i in range(40)]
    rows += [(100 + i, line(30, junk)) for i in range(15)]
    rows += [(200, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (None, line(20, fine)), (None, None), (None, None), (3, line(25, fine)), (3, None), (4, ""), (5, " \n ")]
    rows += [(300, line(12, fine) + " " + BENCH[0]), (301, rows[2][1].replace(rows[2][1].split(" ")[4], "changed", 1)), (302, rows[7][1] + "\n" + line(15, fine))]
    labels = {i: 1 for i in range(0, 40, 2)} | {100 + i: 0 for i in range(0, 15, 2)}
    return rows, labels


def test_quality_against_brute_force(spark, documents):
    rows, labels = documents
    df = spark.createDataFrame([(i, t, "z", 0, "w") for i, t in rows], DOCS).repartition(3)
    got = quality.classify(df, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()
    want = brute_quality(rows, labels)
    form = lambda i, w, x, k: (str(i), round(w, 6), round(x, 6), k)
    assert sorted(form(r.doc_id, r.log_weight, r.noisy, r.kept) for r in got) == sorted(form(i, *v) for (i, _), v in zip(rows, want))
    assert 0 < sum(v[2] for v in want) < len(want)


def test_ring_against_a_walk(spark, documents):
    """Shards of every row by walking the ring place by place."""
    rows, shards = documents[0] * 5, 5
    df = spark.createDataFrame([(i, t, "z", 0, "w") for i, t in rows], DOCS).repartition(4)
    got = sharding.shard_rows(df, shards, ranked=3).collect()
    import zlib

    nodes = {}
    for s in range(shards):
        for n in range(128):
            nodes.setdefault(int.from_bytes(hashlib.blake2b(f"{s}/{n}".encode(), digest_size=8).digest(), "big") % 4096, s)

    def clockwise(place):
        seen = []
        for step in range(4096):
            s = nodes.get((place + step) % 4096)
            if s is not None and s not in seen:
                seen.append(s)
        return seen

    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    waiting = []
    for i, t in rows:
        size, crc = len((t or "").encode()) + 1, zlib.crc32((t or "").encode())
        waiting.append(((xx(i) % (1 << 64)) >> 52, xx(i, size, crc) % (1 << 64), (str(i), size, crc)))
    order = sorted(waiting, key=lambda w: (w[0], w[1] >> 33, w[1] if w[1] < 1 << 63 else w[1] - (1 << 64), w[2]))
    want = Counter()
    for hop in range(shards):
        rest = []
        for w in order:
            s = clockwise(w[0])[hop]
            if room[s]:
                room[s] -= 1
                want[(*w[2], s)] += 1
            else:
                rest.append(w)
        order = rest
    assert Counter((str(r.doc_id), r.size, r.text_crc32, r.shard) for r in got) == want
    for s in range(shards):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_language_of_held_out_documents(spark):
    """Held-out accuracy on the test table, whose labels the classifier has not seen."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def brute_pipeline(rows, labels):
    import re

    import sentencepiece
    import xxhash

    rows = [r for r, v in zip(rows, brute_quality([(i, t) for i, t in rows], labels)) if v[2]]
    gone, left = brute_lines(rows), []
    for i, t in rows:
        drop = gone.get((i, t), [])
        text = t if not drop else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in drop)
        if not drop or text.replace("\n", " ").strip(" "):
            left.append((i, text))

    def bits(text):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [bits(t) for _, t in left]
    label = list(range(len(left)))
    for _ in left:
        for a in range(len(left)):
            label[a] = min(label[b] for b in range(len(left)) if (prints[a] ^ prints[b]).bit_count() <= 5)
    groups = {}
    for g, (i, t) in zip(label, left):
        groups.setdefault(g, []).append((i is None, i or 0, xx(t), i, t))
    left = [min(g, key=lambda r: r[:3])[3:] for g in groups.values()]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))
    windows = set()
    for b in map(cut, BENCH):
        n = min(10, len(b))
        windows |= {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
    clean = [(i, t) for i, t in left if not any(tuple(w[k : k + n]) in windows for w in [cut(t)] for n in range(1, 11) for k in range(len(w) - n + 1))]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return sorted((str(i), sp.encode(t or "", add_bos=True, add_eos=True)) for i, t in clean)


def test_pipeline_against_brute_force(spark, documents, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    rows, labels = documents
    kind = "doc_id long, text string, lang string, source string, n_chars long, _id string, _th long, key string"
    spark.createDataFrame([(i, t, "en", "s", 0, "a", 1, "b") for i, t in rows], kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels.items()), "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == brute_pipeline(rows, labels)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


ODD_ROWS = [(None, "a b c d e f"), (None, "a b c d e f"), (None, None), (1, None), (1, "x y z"), (1, "x y z"), (2, ""), (2, "x y\n\nz " * 30)]
OPERATORS = {
    "simhash": lambda s, d: simhash.near_duplicates(d), "wide simhash": lambda s, d: simhash.near_duplicates(d, words=5, radius=4), "sharding": lambda s, d: sharding.shard_rows(d, 3),
    "files": lambda s, d: token_files.read_token_files(s, token_files.write_token_files(d, public_tokenizers.path("word_bpe_49k.json"), 2)[0]), "pieces": lambda s, d: pieces.encode_pieces(d, public_tokenizers.path("piece_bpe_32k.model")),
    "lines": lambda s, d: line_dedup.line_report(d), "quality": lambda s, d: quality.classify(d, s.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")), "benchmark": lambda s, d: decontamination.decontaminate(d, s.createDataFrame(list(enumerate(BENCH)), "item_id long, text string")),
    "language": lambda s, d: language.identify(d), "counts": lambda s, d: token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    """Null, shared and repeated ids, null and empty texts, columns with the operators' own names, and no rows at all."""
    kind = "doc_id long, text string, lang string, id string, th long, v string, key string, row long, place int, n long"
    df = spark.createDataFrame([(i, t, "en", "z", 0, "w", "k", 1, 2, 3) for i, t in ODD_ROWS], kind).repartition(2)
    got = OPERATORS[name](spark, df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD_ROWS)
    assert OPERATORS[name](spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("radius, small", [(3, 2), (5, 2), (5, 16)])
def test_wide_fingerprint_links(spark, radius, small):
    from tests.llm.test_llm import brute_components
    from tidemark.llm import components

    draw, fps = np.random.default_rng(5), set()
    for size in (1, 30, 30, 5, 1):
        base = int(draw.integers(0, 1 << 63))
        for _ in range(size):
            x = base
            for _ in range(int(draw.integers(0, radius + 4))):
                x ^= 1 << int(draw.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = components.components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, small, block=8)).collect()
    label = {r.node: r.label for r in found}
    want = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= radius)
    groups = lambda labels: sorted(sorted(i for i in range(len(fps)) if labels[i] == x) for x in set(labels))
    assert groups([label.get(x, x) for x in signed]) == groups(want)


@pytest.mark.parametrize("low, high", [(0.9501, 0.96), (0.96, 0.99)])
def test_recall_of_pairs_at_the_threshold(spark, low, high):
    """Structureless pairs just above 0.95, the hardest there are, are found to nine tenths at least."""
    from tidemark.llm import embedding_dedup

    draw = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(draw.standard_normal((2000, 64)))
    way = draw.standard_normal((1000, 64))
    way = unit(way - (way * base[:1000]).sum(axis=1, keepdims=True) * base[:1000])
    cosine = draw.uniform(low, high, (1000, 1))
    x = np.concatenate([base, cosine * base[:1000] + np.sqrt(1 - cosine**2) * way])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in embedding_dedup.link_vectors(df).collect())
    linked = (x @ x.T >= 0.95).sum() - len(x)
    assert linked >= 2000 and 0.9 * linked <= got <= linked
