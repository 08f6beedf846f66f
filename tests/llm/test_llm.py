"""The operators against plain Python on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import components, decontamination, embedding_dedup, language, line_dedup, pieces, quality, sharding, simhash, token_counts, token_files  # noqa: E402

DOCS = "doc_id long, text string, id string, th long, v string"  # the last three clash with names that operators use
ODD = ["", None, " ", "a", "A b", "a  b\n\n\nc", "x\ty z", "<|endoftext|> a<|endoftext|>b", "it's we'll", "日本語 テキスト", "é ́x", "\n", "İ x ß", "ñá. Ñ, x.. 12,3", "▁a ▁", "wörd " * 40]


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "z", 0, "w") for i, t in enumerate(texts, first)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    words = ["".join(draw.choice("aeionrstl") for _ in range(draw.randint(1, 9))) for _ in range(300)] + ["É", "zwölf", "N°", "it's", "3"]
    out = [" ".join(draw.choice(words) + draw.choice(["", "", ".", ",", "\n"]) for _ in range(draw.randint(1, 120))).replace("\n ", "\n") for _ in range(60)]
    return out + ODD + [out[0], out[1] + " end", out[2].upper()]


def long_text(texts):
    return " ".join(t for t in texts if t) * 8


def test_token_counts(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    all_texts = texts + [long_text(texts), "ab" * 20_000, "\n" * 500 + "x"]
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, all_texts), path).collect()}
    for i, x in enumerate(all_texts):
        want = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((x or "").encode()), want, want > 1024)


@pytest.mark.parametrize("chunk, overlap", [(40, 1), (97, 5), (500, 20)])
def test_resynchronisation(texts, chunk, overlap):
    c = token_counts.PieceCounter(public_tokenizers.path("byte_bpe_50k.json"))
    for x in (long_text(texts)[:20_000], "ab" * 300 + " c " + "\n" * 90 + "d" * 50 + "\t \t" * 30, "日本語" * 400, "x" * 1000 + " y"):
        assert c.count_huge(x, chunk, overlap) == c.whole(x)


def test_splices_stand_where_tokens_begin(texts):
    """A boundary that no token begins at, as an untrustworthy tokenizer gives, is not spliced at but widened over."""
    c = token_counts.PieceCounter(public_tokenizers.path("byte_bpe_50k.json"))
    x = long_text(texts)[:8_000]
    sure = c.offsets(x)
    for at in range(200, 8_000, 400):
        at = c.boundary(x, at)
        assert at == len(x) or at in sure
    c.boundary = lambda text, at: min(at + 7, len(text))  # anywhere
    assert c.count_huge(x, 500, 20) == c.whole(x)


def test_a_million_characters_without_spaces():
    import time

    c = token_counts.PieceCounter(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(2)
    for x in ("".join(draw.choice("abcdefXYZ0123456789+/") for _ in range(1_000_000)), "".join(chr(draw.randrange(0x4E00, 0x4F00)) for _ in range(300_000))):
        t0 = time.process_time()
        want = c.whole(x)
        t1 = time.process_time()
        assert c.count(x) == want
        assert time.process_time() - t1 <= 3 * (t1 - t0) + 1


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, df = Tokenizer.from_file(path), frame(spark, texts)
    out, manifest = token_files.write_token_files(df, path, 2, length=32, batch=3, parts=4)
    got, at = {r.doc_id: r for r in token_files.read_token_files(spark, out).collect()}, 0
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids))
        at += len(ids)
    ids, mask = token_files.SequenceReader(f"{out}/{manifest[0][1]}.arrow").sequence(1)
    assert len(ids) == len(mask) == 32 and all(mask.to_pylist())
    out, manifest = token_files.write_token_files(frame(spark, []), path, 2)
    assert not manifest and token_files.read_token_files(spark, out).count() == 0


def test_pieces(spark, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in pieces.encode_pieces(frame(spark, texts), path).collect()}
    for i, x in enumerate(texts):
        ids = sp.encode(x or "", add_bos=True, add_eos=True)
        r, source = got[i], (x or "").encode()
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert r.begins[1:-1] == [0, *r.ends[1:-2]][: len(ids) - 2] and r.ends[-1] == len(source)
        for k, (a, b) in enumerate(zip(r.begins[1:-1], r.ends[1:-1])):
            piece = sp.id_to_piece(ids[k + 1])
            if not sp.is_byte(ids[k + 1]) and "▁" not in (x or ""):
                assert source[a:b].decode() == piece.replace("▁", " ")[k == 0 and piece[0] == "▁" :]
    back = pieces.decode_ids(spark.createDataFrame([(1, sp.encode("a b")), (2, None)], "doc_id long, ids array<int>"), path).collect()
    assert sorted((r.doc_id, r.text) for r in back) == [(1, "a b"), (2, None)]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normalisation_as_the_library(texts, rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    model = model_pb2.ModelProto()
    model.ParseFromString(lib.serialized_model_proto())
    spec = model.normalizer_spec
    for x in [t for t in texts if t] + ["ｆｕｌｌ ①② ﬁ Å", "  a   b  "]:
        got, where = pieces.normalise(x.encode(), pieces.CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        if "▁" not in x:
            assert got.decode() == lib.normalize(x)
        assert len(where) == len(got) + 1 and (np.diff(where) >= 0).all() and where[-1] <= len(x.encode())


def test_pieces_of_texts_with_the_mark_itself():
    e = pieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    for x in ("x▁ ▁y", "▁ ▁", "a ▁▁ b", "one ▁two three▁ four", "x▁\n▁y", "a▁ b"):
        assert e.encode(x).tolist() == e.sp.encode(x)


def test_sharding(spark, texts):
    df = frame(spark, texts)
    got = sharding.shard_rows(df, 8).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(8)]
    assert len(got) == len(texts) and max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for r in got:
        x = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(x.encode()) + 1, zlib.crc32(x.encode()), "rows", None)
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(df.repartition(7), 8).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (1, None)], "doc_id long, text string")
    assert sorted(r.shard for r in sharding.shard_rows(nulls, 3).collect()) == [0, 1, 2]
    assert sharding.shard_rows(frame(spark, []), 8).count() == 0


def test_few_keys_move(spark):
    ids = spark.range(4000).selectExpr("id as doc_id", "'x' as text")
    a, b = ({r.doc_id: r.shard for r in sharding.shard_rows(ids, n).collect()} for n in (8, 9))
    assert sum(a[k] != b[k] for k in a) < 0.4 * len(a)  # dealing anew would move eight ninths


def fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(n, linked):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(n)]


def test_simhash(spark, texts):
    fps = [fingerprint(t) for t in texts]
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("small", [2, 16])
def test_fingerprint_links(spark, small):
    draw, fps = random.Random(3), set()
    for size in (1, 3, 60, 60, 3, 1):
        base = draw.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(draw.randint(0, 6)):
                x ^= 1 << draw.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = components.components(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), small=small)).collect()
    label = {r.node: r.label for r in found}
    want = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    groups = lambda labels: sorted(sorted(i for i in range(len(fps)) if labels[i] == x) for x in set(labels))
    assert groups([label.get(x, x) for x in signed]) == groups(want)


def test_covering_masks_cover():
    masks = [m % (1 << 64) for m in simhash.covering_masks(2)]
    for i in range(64):
        for j in range(i + 1):
            assert any(not m & (1 << i | 1 << j) for m in masks)


@pytest.mark.parametrize("few", [0, 30, 1000])
def test_components_of_a_chain_and_a_star(spark, few):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5)]
    found = components.components(spark.createDataFrame(links, "u long, v long"), few).collect()
    labels = {r.node: r.label for r in found}
    assert len({labels[i] for i in range(61)}) == 1 and len({labels[1000 + i] for i in range(40)}) == 1 and labels[0] != labels[1000]


def vectors():
    draw = np.random.default_rng(2)
    base = draw.standard_normal((80, 64))
    near = np.repeat(base[:4], [1, 3, 30, 60], axis=0)
    near = near + 0.15 * draw.standard_normal(near.shape)
    rows = [v.tolist() for v in np.concatenate([base, near])]
    return rows + [rows[0], rows[0], (2 * base[1]).tolist(), None, [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0, 2.0], [float("inf")] * 64]


@pytest.mark.parametrize("block", [16, 512])
def test_embeddings(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(rows)], "vec_id long, embedding array<float>, rep string")
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(df, block=block).collect()}
    ok = [i for i, v in enumerate(rows) if v and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([np.array(rows[i], np.float32).astype(float) for i in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    links = sum(got[i].n_links for i in ok)
    assert links >= 0.9 * linked.sum() and all(got[i].n_links <= linked[k].sum() for k, i in enumerate(ok))
    if links == linked.sum():
        want = brute_components(len(ok), lambda i, j: linked[i, j])
        assert [got[i].component_id for i in ok] == [ok[w] for w in want]
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(len(rows)) if i not in ok)
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("common", [0.0, 0.6, 0.8])
def test_embeddings_with_a_common_direction(spark, common):
    draw = np.random.default_rng(9)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(np.sqrt(common) * np.eye(64)[0] + np.sqrt(1 - common) * unit(draw.standard_normal((1500, 64))))
    way = draw.standard_normal(base[:500].shape)
    way = unit(way - (way * base[:500]).sum(axis=1, keepdims=True) * base[:500])
    x = np.concatenate([base, 0.955 * base[:500] + np.sqrt(1 - 0.955**2) * way])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in embedding_dedup.link_vectors(df).collect())
    linked = (x @ x.T >= 0.95).sum() - len(x)
    assert linked >= 1000 and 0.9 * linked <= got <= linked


BENCH = ["one two three four five six seven eight nine ten eleven", "Short item here", None, "...", "alpha"]


def test_decontamination(spark, texts):
    docs = texts + ["x ONE two, three four five six seven eight nine ten! y", "two three four five six seven eight nine ten eleven short item here", "one two three four five six seven eight nine", "alpha alpha beta", "a short ITEM, here. short item here"]
    got = {r.doc_id: r for r in decontamination.decontaminate(frame(spark, docs), spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string")).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    cut = lambda t: word.findall((t or "").translate(low))
    for i, t in enumerate(docs):
        w, hit, items = cut(t), set(), set()
        for k, b in enumerate(BENCH):
            item = cut(b)
            n = min(10, len(item))
            windows = {tuple(item[j : j + n]) for j in range(len(item) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j : j + n]) in windows:
                    hit.update(range(j, j + n))
                    items.add(str(k))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontamination.decontaminate(frame(spark, ["a b"]), none).collect()] == [0]


def words_apart(a, b, reach_a, reach_b):
    """Whether a and b are equal but for one run of at most reach_a and reach_b symbols: every way to cut is tried."""
    for p in range(min(len(a), len(b)) + 1):
        if a[:p] != b[:p]:
            return False
        for n in range(reach_a + 1):
            m = len(b) - len(a) + n
            if 0 <= m <= reach_b and p + n <= len(a) and p + m <= len(b) and a[p + n :] == b[p + m :]:
                return True
    return False


def near_lines(a, b):
    """The rule of the docstring, without any key: equal, or one run apart in words or, if short, in characters."""
    if a == b:
        return True
    wa, wb = a.split(" "), b.split(" ")
    if min(len(wa), len(wb)) >= 5 and words_apart(wa, wb, min(3, len(wa) // 5), min(3, len(wb) // 5)):
        return True
    return all(5 <= len(x) <= 64 for x in (a, b)) and words_apart(a, b, 1, 1)


def brute_lines(docs):
    """Places of the lines that go, by (id, text)."""
    import xxhash

    th = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    rows = sorted({(i, t) for i, t in docs if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0, th(r[1])))
    lines = [(i, t, j, x.strip(" ").lower()) for i, t in rows for j, x in enumerate(t.split("\n")) if x.strip(" ")]
    return {(i, t): sorted({l[2] for n, l in enumerate(lines) if l[:2] == (i, t) and any(near_lines(k[3], l[3]) for k in lines[:n])}) for i, t in rows}


def check_lines(spark, docs):
    df = spark.createDataFrame([(i, t, "z", 0, "w") for i, t in docs], DOCS).repartition(3)
    want = brute_lines(docs)
    got = sorted((str(r.doc_id), r.n_lines, r.dropped) for r in line_dedup.line_report(df).collect())
    assert got == sorted((str(i), 0 if t is None else len(t.split("\n")), ",".join(map(str, want.get((i, t), [])))) for i, t in docs)
    left = sorted((str(r.doc_id), str(r.text), r.th, r.v) for r in line_dedup.dedup_lines(df).collect())
    expected = []
    for i, t in docs:
        gone = want.get((i, t), [])
        text = t if not gone else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)
        if not gone or text.replace("\n", " ").strip(" "):
            expected.append((str(i), str(text), 0, "w"))
    assert left == sorted(expected)


def test_line_dedup_by_cases(spark):
    w = [f"word{i}" for i in range(20)]
    line = " ".join(w)
    clauses = [f"clause {i} here," for i in range(501)]
    many = " ".join(clauses)
    check_lines(spark, list(enumerate([
        line + "\n\nbye now", line.replace("word7", "wort7"), line.replace("word7 ", ""), "x " + line, line + " y z", "A\nnew line", " a \nnew line\nNEW LINE", None, "", "\n \n",
        line.replace("word3", "a").replace("word9", "b"), line.replace("word3 word4 word5", "a b"), line.replace("word3 word4 word5 word6", "a"),
        "abcdefghij klmnop qrstuv wxyzab cdefgh ijklmno", "abcdefghij klmnop qrstuv wxyzab cdefgh ijklmnp", "alpha beta gamma delta epsilon", "alpha beta gammq delta epsilon", "alpha beta gamma delta",
        "hello wrld again", "hello world again", "helo wrld again", "a", "b", "yes sir", "no sir", many, many.replace("clause 301 here,", "other words,"), many.replace("clause 100 here, ", ""), many.replace("clause 7 here, clause 8 here,", "gone"),
    ])))


def test_line_dedup_of_rows_that_share_an_id(spark):
    a, b, c = ("the first line of three that stand here\nsecond", "the first line of three that stand there", "quite another one\nof two lines")
    check_lines(spark, [(9, b), (0, a), (9, c), (9, c), (None, "second"), (None, None), (None, "second")])


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_at_random(spark, seed):
    """True edits of lines of all lengths, among many lines that share their first or last half."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abc") for _ in range(draw.randint(1, 5))) for _ in range(12)]
    lines = []
    for _ in range(60):
        base = [draw.choice(words) for _ in range(draw.randint(1, 24))]
        for _ in range(draw.randint(1, 4)):
            some = list(base)
            for _ in range(draw.choice([0, 1, 1, 2])):
                at = draw.randrange(len(some) + 1)
                some[at : at + draw.randint(0, 3)] = [draw.choice(words) for _ in range(draw.randint(0, 3))]
            lines.append(" ".join(some))
    draw.shuffle(lines)
    check_lines(spark, [(i, "\n".join(lines[i :: 40])) for i in range(40)])


@pytest.mark.parametrize("words", [1, 3, 5, 9, 10, 14])
def test_line_dedup_one_character_apart(spark, words):
    """Lines of 65 characters and over are found whatever their words, if one character is replaced, added or missing."""
    draw = random.Random(words)
    pairs = []
    for size in (64, 65, 66, 200):
        base = list("".join(draw.choice("abcdefghijklmnop") for _ in range(size)))
        for k in range(1, words):
            base[k * size // words] = " "
        for at in (1, size // 2, size // words - 1, size - 2):
            for new in ("", "q", " " + base[at], "q" + base[at]):
                other = "".join([*base[:at], new, *base[at + 1 :]])
                tag = f"{len(pairs):03d}"  # so that pairs are told apart
                pairs.append((f"{tag}{''.join(base)}", f"{tag}{other}"))
    docs = [p[0] for p in pairs] + [p[1] for p in pairs]
    dropped = {r.doc_id: r.n_dropped for r in line_dedup.line_report(frame(spark, docs)).collect()}
    assert [i for i in range(len(pairs)) if docs[i] != docs[i + len(pairs)] and not dropped[i + len(pairs)]] == []


def test_line_dedup_sends_hashes_alone(spark, monkeypatch):
    """What is sent to every executor, and so held by the driver, for near copies: one long a row."""
    sent = []
    monkeypatch.setattr(line_dedup, "sent_if_small", lambda df, *a, **b: sent.append([kind for _, kind in df.dtypes]) or df)
    docs = line_dedup.with_hash(frame(spark, ["alpha beta gamma delta epsilon", "alpha beta gamma delta epsilom", "none"]), "doc_id", "text")
    rows = line_dedup.with_halves(line_dedup.numbered_lines(docs))
    distinct = rows.selectExpr("xxhash64(key) a", "struct(id, th, line) first", "n0", "n1", "halves")
    assert line_dedup.near_copies(docs, distinct).count() == 1
    assert sent and all(kinds == ["bigint"] for kinds in sent)


def test_line_dedup_of_a_line_of_a_megabyte(spark):
    big = [f"q{i % 7919}x{i}" for i in range(90_000)]
    docs = [" ".join(x) for x in (big, big[:60_000] + ["zz"] + big[60_001:], big[3:], big[5:40_000] + big[40_001:])]
    assert [r.n_dropped for r in line_dedup.line_report(frame(spark, docs)).orderBy("doc_id").collect()] == [0, 1, 1, 0]
    assert line_dedup.line_report(frame(spark, [])).count() == 0


def test_quality(spark):
    draw = random.Random(8)
    good = [" ".join(draw.choice("the of and to in a is that for it as was".split()) + draw.choice(["", "", "."]) for _ in range(40)) for _ in range(120)]
    bad = [" ".join(draw.choice("BUY NOW CHEAP CLICK WIN".split()) + "!!" for _ in range(30)) for _ in range(40)]
    docs = good + bad + [None, ""]
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 160, 2)] + [(0, 0), (None, 1), (1, None)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.classify(frame(spark, docs), labels).collect()}
    assert all(got[i] for i in range(120)) and not any(got[i] for i in range(120, 160)) and got[160] and got[161]
    assert quality.keep_good(frame(spark, docs), labels).count() == 122
    assert quality.classify(frame(spark, docs), labels.limit(0)).where("kept").count() == len(docs)
    assert quality.classify(frame(spark, []), labels).count() == 0


def test_kth_highest(spark):
    draw = random.Random(1)
    values = [round(draw.gauss(0, 100), 1) for _ in range(3000)] + [5.0] * 2500 + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    order = sorted(values, reverse=True)
    for k in (1, 2, 700, 2000, 4000, len(values)):
        assert quality.kth_highest(df, "x", k) == order[k - 1]


def test_language(spark):
    draw = random.Random(6)
    stock = {"en": "the and that with from have this".split(), "de": "der und das nicht eine mit für".split(), "fr": "les des une dans être pour où".split()}
    rows = [(i, " ".join(draw.choice(stock[lang]) for _ in range(25)), lang) for i in range(300) for lang in [draw.choice(list(stock))]]
    rows += [(300, None, "en"), (301, "12 34 !", "en"), (302, "der und das nicht", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(300))
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    assert (got[300].lang_pred, got[300].score, got[301].lang_pred, got[302].lang_pred) == ("und", 0.0, "und", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify(df.where("doc_id > 301")).collect()} == {"und"}


def test_codewords_are_apart():
    code = language.codewords(4)
    assert min(int((code[i] != code[j]).sum()) for i in range(4) for j in range(i)) >= 7


def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 100
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontamination.decontaminate(docs, items).where("contaminated").count() == 0
    assert simhash.near_duplicates(docs).where("doc_id <> component_id").count() == 0
    assert corpus_pipeline.run(spark, folder).count() == kept[-1]


def test_pipeline_removes_by_id_and_text(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    draw = random.Random(12)
    a, b, c = (" ".join("".join(draw.choice("aeionrstl") for _ in range(6)) for _ in range(60)) for _ in range(3))
    item = BENCH[0]
    rows = [(None, a), (None, a), (1, b), (1, b), (1, c), (2, c), (None, item), (3, item + " x"), (3, "clean"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = lambda stage: sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)
    clean = [x for x in rows if item not in (x[1] or "")]
    assert left(corpus_pipeline.without_benchmark) == sorted(clean, key=str)
    assert left(corpus_pipeline.one_of_each) == sorted([(None, a), (1, b), (1, c), (None, item), (3, item + " x"), (3, "clean"), (None, None)], key=str)
