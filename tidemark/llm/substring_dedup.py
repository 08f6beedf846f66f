"""Repeated passages, found by the matching statistics of documents in suffix automata of reference shards.

A window is `window` consecutive words of one document. Words go that a window covers whose words start anywhere else
too, in the same document or another; windows are judged on the input, not on what is left.

What must be held against what follows from the windows themselves. Of the hashed runs of GRAM words in a window the
least (the first of equal ones) is its anchor, so equal windows have equal anchors. Consecutive windows with one anchor
form a piece; every window of the corpus lies in just one. Anchors that occur once are done with, and equal pieces
are one piece with a number of copies, all of whose windows repeat if there are several. Left are anchors with different pieces:
those are the reference. It is dealt into shards by anchor, SHARD_WORDS words each; a shard's pieces make a suffix
automaton over words, with the number of places that each of its strings ends at, and stretches of documents that
occur once are streamed through it: for each of their words the longest suffix that ends at another place as well. Of
that length from `window` on, it is a span to be removed. An automaton goes to the stretches that could match in it, not to
all documents: those would be as many passes over the corpus as there are shards.

An anchor with over CROWD different pieces (the end of a passage that very many documents hold) would make a shard
as large as it likes. Its windows are counted by two hashes of all their words instead, which is exact too.

Memory: arrays over at most SLICE words, one shard's automaton, a document's words. Executors may be lost: all tables
between stages are written, and tasks depend on their input alone.

Defined results: a null text has no words; a document shorter than a window keeps all; repeated rows, and rows that
share an id and text, are documents each, so that their windows repeat; rows that share an id alone have their own
results; null ids are ids; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import sorted_groups
from tidemark.llm.common import map_texts, need, sent_if_small, written

#: Words of a window, of a hashed run, of a slice that is worked on at once, of a shard, and different pieces of one anchor at most.
WINDOW, GRAM, SLICE, SHARD_WORDS, CROWD = 35, 16, 1 << 20, 200_000, 1_000
BASE, OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
LOW = np.uint64((1 << 28) - 1)


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words) of texts: those of text k are words[offsets[k] : offsets[k + 1]]."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    there = pc.not_equal(flat, "")
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return before[offsets - offsets[0]], flat.filter(there)


def hashed(words: pa.Array) -> np.ndarray:
    d = words.dictionary_encode()
    d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in d.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(d.dictionary))
    return each[d.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def runs(h: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of each run of `length` values, from hashes of runs of powers of two."""
    if len(h) < length:
        return np.empty(0, np.uint64)
    out, have, part, size, power = None, 0, h, 1, np.array([base])
    while True:
        if length & size:
            n = len(part) - have
            out = part if out is None else out[:n] * power + part[have:]
            have += size
        if size * 2 > length:
            return mixed(out[: len(h) - length + 1])
        part, power, size = part[:-size] * power + part[size:], power * power, size * 2


def least_of(x: np.ndarray, length: int) -> np.ndarray:
    """The least of each run of `length` values."""
    size = 1
    while size * 2 <= length:
        x, size = np.minimum(x[:-size], x[size:]), size * 2
    rest = length - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def pieces_of(h: np.ndarray, ends: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(at, n, anchor, piece hash) of the pieces of hashed words; ends: for each word the end of its document."""
    grams = runs(h, gram)
    order = (mixed(grams ^ OTHER_BASE) & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    first = (least_of(order, window - gram + 1) & LOW).astype(np.int64)
    starts = np.flatnonzero(np.arange(len(first)) + window <= ends[: len(first)])
    first = first[starts]
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (starts[1:] != starts[:-1] + 1)])[: len(first)])
    at, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]])[: len(new)] - 1]
    # Hash of a stretch by prefix sums: an odd base has an inverse, which takes the place out again.
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(h), BASE))])
    back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(h), np.uint64(pow(int(BASE), -1, 1 << 64))))])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h ^ OTHER_BASE) * powers[:-1])])
    end = last + window
    found = mixed((sums[end] - sums[at]) * back[at] + (end - at).astype(np.uint64))
    return at, end - at, grams[first[new]], found


def fingerprints(window: int, gram: int):
    """Of each document: words, digest of all of them, and its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            offsets, words = words_of(b.column(2))
            h, found = hashed(words), []
            ends = np.repeat(offsets[1:], np.diff(offsets))
            for s in range(0, len(h), SLICE):
                z = min(s + SLICE + window - 1, len(h))
                if z - s >= window:
                    at, n, anchor, piece = pieces_of(h[s:z], ends[s:z] - s, window, gram)
                    found.append((at + s, n, anchor, piece))
            at, n, anchor, piece = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4
            cuts = np.searchsorted(at, offsets).astype(np.int32)
            place = at - np.repeat(offsets[:-1], np.diff(cuts))
            items = pa.StructArray.from_arrays([pa.array(anchor.astype(np.uint64).view(np.int64)), pa.array(piece.astype(np.uint64).view(np.int64)), pa.array(place, pa.int32()), pa.array(n, pa.int32())], ["anchor", "piece", "at", "n"])
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), pa.scalar(" ", pa.large_string()))
            digest = [hashlib.sha256(t.as_buffer()).hexdigest() for t in joined.cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(offsets), pa.int64()), pa.array(digest), pa.ListArray.from_arrays(pa.array(cuts), items)], ["id", "th", "n_words", "digest", "pieces"])

    return run


def stretches(window: int):
    """The words of the places to read again; of crowded ones two hashes of each window instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "th", "anchor", "copies", "at", "words", "windows"]
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for b in batches:
            for k in range(b.num_rows):
                words, rows = (b.column(2)[k].as_py() or "").encode().split(), {n: [] for n in names}
                h = None
                for x in b.column(3)[k].as_py():
                    at, n = x["at"], x["n"]
                    text = wins = None
                    if x["crowded"]:
                        h = hashed(pa.array(words, pa.large_binary())) if h is None else h
                        own = h[at : at + n]
                        wins = [{"a": int(u), "b": int(v)} for u, v in zip(runs(own, window).view(np.int64), runs(mixed(own), window, OTHER_BASE).view(np.int64))]
                    else:
                        text = b" ".join(words[at : at + n]).decode()
                    for name, v in zip(names[2:], (x["anchor"], x["copies"], at, text, wins)):
                        rows[name].append(v)
                n = len(rows["at"])
                take = pa.array(np.full(n, k))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(rows["anchor"], pa.int64()), pa.array(rows["copies"], pa.int64()), pa.array(rows["at"], pa.int32()), pa.array(rows["words"], pa.string()), pa.array(rows["windows"], kind)], names)

    return run


class SuffixAutomaton:
    """All strings of the sequences that were added, with the places that each ends at, a sequence's copies included."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.places = [-1], [0], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.len.append(length)
        self.places.append(0)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of p's longest string and c, where q has longer ones too."""
        nexts, link = self.next, self.link
        short = self._state(self.len[p] + 1, link[q], dict(nexts[q]))
        while p != -1 and nexts[p].get(c) == q:
            nexts[p][c] = short
            p = link[p]
        link[q] = short
        return short

    def _extend(self, last: int, c: int) -> int:
        nexts, link, lens = self.next, self.link, self.len
        q = nexts[last].get(c)
        if q is not None:
            return q if lens[q] == lens[last] + 1 else self._split(last, c, q)
        new, p = self._state(lens[last] + 1, 0, {}), last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            link[new] = q if lens[q] == lens[p] + 1 else self._split(p, c, q)
        return new

    def add(self, tokens: list[int], copies: int) -> None:
        last = 0
        for c in tokens:
            last = self._extend(last, c)
            self.places[last] += copies

    def settle(self) -> None:
        """After the last add: the places of a string are those of all that end in it."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.places[self.link[v]] += self.places[v]

    def matching(self, tokens: list[int], least: int) -> Iterator[int]:
        """For each token the length of the longest suffix up to it that ends at `least` places or more."""
        nexts, link, lens, places = self.next, self.link, self.len, self.places
        v = n = 0
        for c in tokens:
            while v and c not in nexts[v]:
                v = link[v]
                n = lens[v]
            if c in nexts[v]:
                v = nexts[v][c]
                n += 1
            u, m = v, n
            while u and places[u] < least:
                u = link[u]
                m = lens[u]
            yield m


def spans_of(tokens: list[int], shard: SuffixAutomaton, window: int) -> list[tuple[int, int]]:
    """(start, length) of the maximal spans of windows that stand elsewhere too."""
    spans: list[tuple[int, int]] = []
    for end, n in enumerate(shard.matching(tokens, 2), 1):
        if n >= window:
            start = end - n
            if spans and start <= sum(spans[-1]):
                start = spans.pop()[0]
            spans.append((start, end - start))
    return spans


def streamed(window: int):
    """Spans of the stretches without copies, by the automaton of their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ("shard",)):
            shard, codes, single = SuffixAutomaton(), {}, []
            for k, (words, copies) in enumerate(zip(t["words"].to_pylist(), t["copies"].to_pylist())):
                tokens = [codes.setdefault(w, len(codes)) for w in words.split(" ")]
                shard.add(tokens, copies)
                if copies == 1:
                    single.append((k, tokens))
            shard.settle()
            found = [(k, s, n) for k, tokens in single for s, n in spans_of(tokens, shard, window)]
            if found:
                rows, starts, lengths = (np.array(x) for x in zip(*found))
                own = t.select(["id", "th"]).take(pa.array(rows)).combine_chunks().to_batches()[0]
                at = t["at"].to_numpy()[rows] + starts
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(at, pa.int32()), pa.array(lengths, pa.int32())], ["id", "th", "at", "n"])

    return run


def grows(df: DataFrame) -> DataFrame:
    """df, which grows with the corpus: it is shuffled at every size, as it must be at the large ones."""
    return df.hint("merge")


def repeated_spans(docs: DataFrame, prints: DataFrame, window: int, shard_words: int = SHARD_WORDS, crowd: int = CROWD) -> DataFrame:
    """(id, th, at, n): stretches of words that repeated windows cover; they may overlap. docs: (id, th, text)."""
    kind = dict(docs.dtypes)["id"]
    each = prints.select("id", "th", F.explode("pieces").alias("p")).select("id", "th", "p.*")
    anchors = each.groupBy("anchor").agg(F.count("*").alias("c"), F.min("piece").alias("low"), F.max("piece").alias("high")).where("c > 1")
    anchors = grows(written(anchors.select("anchor", (F.col("low") != F.col("high")).alias("open")), "anchors"))
    met = written(each.join(anchors, "anchor"), "met")
    whole = met.where("not open").select("id", "th", "at", "n")
    # Anchors with different pieces: each distinct one, where it stands first, and its copies.
    place = F.struct(F.col("id").isNotNull().alias("named"), "id", "th", "at", "n")
    distinct = written(met.where("open").groupBy("anchor", "piece").agg(F.count("*").alias("copies"), F.min(place).alias("first")), "pieces")
    copied = grows(distinct.where("copies > 1").select("anchor", "piece"))
    whole = whole.union(met.where("open").join(copied, ["anchor", "piece"], "left_semi").select("id", "th", "at", "n"))
    crowded = distinct.groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > crowd)
    crowded = sent_if_small(written(crowded.select("anchor", F.lit(True).alias("crowded")), "crowded"))
    reference = distinct.join(crowded, "anchor", "left").select("anchor", "copies", "first.*", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    total = reference.where("not crowded").agg(F.sum("n")).first()[0] or 0
    # Documents with such pieces are read again.
    holders = reference.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "copies", "at", "n", "crowded")).alias("places"))
    again = docs.alias("d").join(grows(holders).alias("h"), F.expr("d.id <=> h.id and d.th = h.th")).select("d.id", "d.th", "d.text", "h.places")
    found = map_texts(again, stretches(window), f"id {kind}, th long, anchor long, copies long, at int, words string, windows array<struct<a:long,b:long>>")
    if not prints.groupBy("id", "th").count().where("count > 1").isEmpty():  # repeated rows are references once
        found = found.dropDuplicates(["id", "th", "at", "anchor"])
    found = written(found, "stretches")
    shards = max(1, -(-total // shard_words))
    dealt = found.where("words is not null").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    dealt = dealt.select("shard", "id", "th", "at", "copies", "words").repartition(F.col("shard")).sortWithinPartitions("shard")
    single = dealt.mapInArrow(streamed(window), f"id {kind}, th long, at int, n int")
    wins = found.where("windows is not null").select("id", "th", "at", "copies", F.posexplode("windows").alias("pos", "w")).select("id", "th", (F.col("at") + F.col("pos")).alias("at"), "copies", "w.*")
    twice = wins.groupBy("a", "b").agg(F.sum("copies").alias("c")).where("c > 1").select("a", "b")
    by_hash = wins.where("copies = 1").join(grows(twice), ["a", "b"], "left_semi").select("id", "th", "at", F.lit(window).alias("n"))
    return whole.union(single).union(by_hash)


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, gone, texts = [], [], []
        for text, spans in zip(b.column(1), b.column(2)):
            words = (text.as_py() or "").encode().split()
            edge = np.zeros(len(words) + 1, np.int64)
            places = np.array([(s["at"], s["at"] + s["n"]) for s in spans.as_py()], np.int64).reshape(-1, 2)
            np.add.at(edge, places[:, 0], 1)
            np.add.at(edge, places[:, 1], -1)
            keep = np.cumsum(edge)[:-1] == 0
            counts.append(len(words))
            gone.append(int((~keep).sum()))
            texts.append(b" ".join(w for w, k in zip(words, keep.tolist()) if k).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int | None = None, with_text: bool = False, **sizes: int) -> DataFrame:
    """Words and removed words of every document and the digest of what is left; with_text: that text too (words joined
    by one space)."""
    rows = need(docs, id_col, text_col).toDF("id", "text").withColumn("th", F.xxhash64("text"))
    rows = rows.select("id", "th", "text")
    kind = dict(rows.dtypes)["id"]
    prints = map_texts(rows, fingerprints(window, min(gram or GRAM, window)), f"id {kind}, th long, n_words long, digest string, pieces array<struct<anchor:long,piece:long,at:int,n:int>>")
    prints = written(prints, "prints")
    spans = repeated_spans(rows, prints, window, **sizes)
    spans = written(spans.groupBy("id", "th").agg(F.collect_set(F.struct("at", "n")).alias("spans")), "spans")
    # Without texts asked for, documents that lose nothing are not read again.
    hit = rows.alias("d").join(grows(spans).alias("s"), F.expr("d.id <=> s.id and d.th = s.th"), "left" if with_text else "inner")
    hit = hit.select("d.id", "d.text", F.coalesce("s.spans", F.array().cast("array<struct<at:int,n:int>>")).alias("spans"))
    found = map_texts(hit, cut, f"id {kind}, n_words long, n_removed long, kept string")
    found = found.select("id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), *(["kept"] if with_text else []))
    if not with_text:
        keys = grows(spans.select(F.col("id").alias("_id"), F.col("th").alias("_th")))
        rest = prints.drop("pieces").join(keys, F.expr("id <=> _id and th = _th"), "left_anti")
        found = found.union(rest.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256")))
    return found.withColumnRenamed("id", id_col)
