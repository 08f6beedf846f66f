"""Quality classifier by importance resampling.

Two bag-of-hashed-n-grams models are estimated: one of the target (labelled documents of good quality), one of the raw
corpus (all documents). A document's log importance weight is the sum over its n-grams of the log of the ratio of
their two probabilities. The n-grams are words, pairs of words, and runs of three word shapes (case, script, closing
marks, repetition of the word before). Of the corpus, k documents are drawn without replacement in proportion to
their weights: those with the k highest sums of log weight and Gumbel noise, which a hash of the id gives. k is the
number of documents whose log weight is at or above the cut that separates the labelled documents best.

Labels are used for at most `labelled` documents, those with the least hashes of their ids (a documented bound);
the raw counts, the weights, k and the draw cover every document. The k-th highest sum is found by counting in
ranges that narrow down, so the driver only ever sees range counts.

Defined results: a null text has no n-grams and log weight 0; documents without labels are treated alike; if labels
of either kind are missing every document is kept; of rows that share a labelled id the least log weight speaks for it; equal sums at the edge are all kept; several labels of a document
count as the highest; repeated rows each get their row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, map_texts, need, sent_if_small, written
from tidemark.llm.segments import Remembered

#: Buckets of words and pairs, buckets of shapes, labelled documents used, and the raw corpus's weight in the target model, in counts a bucket.
WORD_BUCKETS, SHAPE_BUCKETS, LABELLED, SMOOTHING = 12_288, 4_096, 20_000, 2.0
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
#: Ranges of one counting step, and documents in a range from which it need not be narrowed further.
RANGES, FEW = 1024, 2_000
_MARKS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+$")


def describe(word: bytes) -> int:
    """Hash of a word, and below it that of its shape: case, script and closing marks."""
    marks = _MARKS.search(word)
    body = word[: marks.start()] if marks else word
    closing = marks.group()[:3] if marks else b""
    case = (2 if body.isupper() and len(body) > 1 else 1) if body[:1].isupper() else 3 if not body else 4 if body.isdigit() else 0
    return crc32(word) << 32 | crc32(b"%d/%d/%s" % (case, not body.isascii(), closing))


_words = Remembered(describe, 50_000)


def features(text: str | None) -> np.ndarray:
    """Bucket numbers of all n-grams of a text, repeats included."""
    words = text.encode().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    both = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    repeated = np.concatenate([[False], word[1:] == word[:-1]])
    shape = shape ^ np.where(repeated, np.uint64(0x5BD1E995), np.uint64(0))
    pairs = word[:-1] * np.uint64(0x9E3779B1) + word[1:] * np.uint64(0x85EBCA77)
    edge = np.concatenate([[0, 0], shape]).astype(np.uint64)
    runs = edge[:-2] * np.uint64(0xC2B2AE3D) + edge[1:-1] * np.uint64(0x27D4EB2F) + edge[2:] * np.uint64(0x165667B1)
    spread = lambda h, n: ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(n)
    return np.concatenate([spread(word, WORD_BUCKETS), spread(pairs, WORD_BUCKETS), WORD_BUCKETS + spread(runs, SHAPE_BUCKETS)]).astype(np.int64)


def with_labels(docs: DataFrame, labels: DataFrame, labelled: int, id_col: str) -> DataFrame:
    """docs (id, text) and the label of those whose labels are used."""
    used = need(labels, id_col, "quality").toDF("id", "quality").where("id is not null and quality is not null")
    used = used.groupBy("id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("id"), "id").limit(labelled)
    return docs.join(F.broadcast(used), "id", "left").select("id", "text", F.col("quality").cast("int").alias("quality"))  # `labelled` rows


def log_ratio(rows: DataFrame) -> np.ndarray:
    """Log of target over raw probability for each bucket. What is shuffled is a count per bucket and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for text, quality in zip(b.column(0), b.column(1).to_pylist()):
                one = np.bincount(features(text.as_py()), minlength=BUCKETS)
                raw += one
                if quality == 1:
                    target += one
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (some, raw[some], target[some])], ["bucket", "raw", "target"])

    counts = map_texts(rows.select("text", "quality"), count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # BUCKETS rows at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    share = (raw + 0.5) / (raw + 0.5).sum()
    pulled = target + SMOOTHING * BUCKETS * share  # where little is known, the target is taken to be like the raw corpus
    return np.log(pulled / pulled.sum()) - np.log(share)


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """Of the cuts whose mean of the two shares that are right is within a hundredth of the best, the one in the widest
    gap between scores; halfway in it."""
    if not good.any() or good.all():
        return -math.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    below_bad, below_good = np.cumsum(~g) / (~g).sum(), np.cumsum(g) / g.sum()
    ends = np.flatnonzero(np.concatenate([s[1:] > s[:-1], [False]]))
    if not len(ends):
        return -math.inf
    worth = below_bad[ends] - below_good[ends]
    ends = ends[worth >= worth.max() - 0.02]
    k = ends[np.argmax(s[ends + 1] - s[ends])]
    return float((s[k] + s[k + 1]) / 2)


def kth_highest(rows: DataFrame, name: str, k: int) -> float:
    """The k-th highest value of a column without nulls or NaNs, exactly."""
    low, high, above = *rows.agg(F.min(name), F.max(name)).first(), 0
    while True:
        width = (high - low) / RANGES
        part = rows.where(F.col(name).between(low, high))
        if width <= 0 or low + width <= low:
            return high if k - above <= part.where(F.col(name) == high).count() else low
        at = F.least(F.floor((F.col(name) - low) / width), F.lit(RANGES - 1)).cast("int")
        found = part.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect()  # RANGES rows
        for r in sorted(found, key=lambda r: -r["at"]):
            if above + r.n >= k:
                low, high, n = r.low, r.high, r.n
                break
            above += r.n
        if low == high:
            return low
        if n <= FEW:
            values = sorted((r[0] for r in rows.where(F.col(name).between(low, high)).select(name).collect()), reverse=True)  # FEW at most
            return values[k - above - 1]


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, seed: int = 7) -> DataFrame:
    """(id, th, log_weight, noisy, kept) of every document; th is a hash of its text."""
    rows = with_labels(need(docs, id_col, text_col).toDF("id", "text"), labels, labelled, id_col)
    weights = log_ratio(rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [float(weights[features(t.as_py())].sum()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(s, pa.float64())], ["id", "th", "quality", "log_weight"])

    kind = dict(rows.dtypes)["id"]
    scored = map_texts(rows.select("id", "text", F.xxhash64("text").alias("th"), "quality"), score, f"id {kind}, th long, quality int, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64("id", "th", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    scored = written(scored.withColumn("noisy", F.col("log_weight") - F.log(-F.log(u))), "weights")
    # A row for each used label, whose own is the least of the rows that share its id.
    known = scored.where("quality is not null").groupBy("id").agg(F.min(F.struct("log_weight", "quality")).alias("one")).select("one.*").toPandas()
    cut = best_cut(known.log_weight.to_numpy(), known.quality.to_numpy() == 1)
    k = scored.where(F.col("log_weight") >= cut).count() if cut > -math.inf else 0
    kept = F.col("noisy") >= kth_highest(scored, "noisy", k) if k else F.lit(cut == -math.inf)
    return scored.select("id", "th", "log_weight", "noisy", kept.alias("kept"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> DataFrame:
    """Log weight, noisy log weight, and whether the document is kept, for every document."""
    return score_quality(docs, labels, id_col, text_col, labelled).drop("th").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED) -> DataFrame:
    """docs without those that the classifier rejects."""
    key, hashed = free_name(docs, "_id"), free_name(docs, "_th")
    out = sent_if_small(score_quality(docs, labels, id_col, text_col, labelled).where("not kept").select("id", "th").distinct()).toDF(key, hashed)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(hashed))
    return docs.join(out, same, "left_anti")
