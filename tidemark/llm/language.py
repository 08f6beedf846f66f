"""Language identification with error-correcting output codes.

Each language has a codeword. For each bit a binary classifier (ridge regression to +1 and -1) on hashed byte
trigrams of the whole lower-cased text predicts it. A text is decoded to the language whose codeword has the least
loss: over the bits, a logistic loss of the margin in the codeword's direction, weighted by how reliable that bit's
classifier is. The score is the softmax share of the winner; a text is ambiguous if the runner-up comes close.

The classifiers are fitted to at most `per_language` documents of each language, those with the least hashes of their ids
(a documented bound), of which the held-out fifth never are. Prediction sees the text alone.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if there is nothing to
learn from; one language alone is predicted with score 1; null ids count as held out; repeated rows each get their
row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import need

#: Hashed features, documents learned from per language, codeword bits, and the score gap under which a text is ambiguous.
FEATURES, PER_LANGUAGE, BITS, CLOSE = 2048, 1000, 15, 0.2
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    found = _LETTER.search(text)
    return bool(found) and (found.group().isalpha() or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    b = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    counts = np.sqrt(np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(21), minlength=FEATURES))
    return (counts / max(np.linalg.norm(counts), 1e-9)).astype(np.float32)


def codewords(languages: int, bits: int = BITS, tries: int = 500) -> np.ndarray:
    """The best of many random codes: largest least distance, no bit the same for all."""
    draw, best, most = np.random.default_rng(17), None, (-1, 0)
    bits = max(bits, 4 * int(np.ceil(np.log2(max(languages, 2)))))
    for _ in range(tries):
        code = draw.choice([-1.0, 1.0], (languages, bits))
        if languages > 1:
            constant = np.abs(code.sum(axis=0)) == languages
            code[draw.integers(languages), constant] *= -1
        apart = (bits - code @ code.T) / 2 + bits * np.eye(languages)
        if (key := (apart.min(), apart.sum())) > most:
            best, most = code, key
    return best


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, codewords, weights (features x bits), and how reliable each bit is."""
    rows = need(docs, id_col, text_col, lang_col).toDF("id", "text", "lang")
    rows = rows.where(~held_out(F.col("id")) & F.col("lang").isNotNull())
    # A hash share of each language that holds about 1.5 times as many as wanted, so that no language's ids meet in one
    # task; the ranking then works on what is left of them.
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), 1.5 * per_language / F.col("n"))
    drawn = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < share * (1 << 30)
    few = rows.select("id", "lang").join(F.broadcast(counts), "lang").where(drawn)  # a row per language
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    chosen = few.withColumn("nth", nth).where(F.col("nth") <= per_language).select("id").distinct()
    sample = rows.where("text is not null").join(F.broadcast(chosen), "id", "left_semi")  # per_language ids a language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [(x, lang) for t, lang in zip(b.column(0), b.column(1).to_pylist()) if has_letter(x := t.as_py())]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([lang for _, lang in some]), pa.array([features(x).astype("f2").tobytes() for x, _ in some], pa.binary())], ["lang", "x"])

    got = sample.select("text", "lang").mapInArrow(run, "lang string, x binary").toPandas()
    languages = sorted(got.lang.unique())
    if not languages:
        return [], np.zeros((0, 1)), np.zeros((FEATURES, 1)), np.ones(1)
    x = np.frombuffer(b"".join(got.x), "f2").reshape(-1, FEATURES).astype(np.float32)
    code = codewords(len(languages))
    which = np.array([languages.index(v) for v in got.lang])
    y, share = code[which].astype(np.float32), 1 / np.bincount(which)[which]  # every language weighs alike
    xs = x * np.sqrt(share * len(which) / len(languages))[:, None].astype(np.float32)
    ys = y * np.sqrt(share * len(which) / len(languages))[:, None].astype(np.float32)
    weights = np.linalg.solve((xs.T @ xs).astype(np.float64) + 0.1 * np.eye(FEATURES), (xs.T @ ys).astype(np.float64))
    right = ((x @ weights) * y > 0).mean(axis=0)
    return languages, code, weights.astype(np.float32), np.clip(2 * right - 1, 0.05, 1)


def decode(margins: np.ndarray, code: np.ndarray, reliable: np.ndarray, sharpness: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the language with the least weighted loss, its share, and the gap to the next."""
    loss = (np.logaddexp(0, -sharpness * margins[:, None, :] * code[None]) * reliable).sum(axis=2)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    share /= share.sum(axis=1, keepdims=True)
    ranked = np.sort(share, axis=1)
    return share.argmax(axis=1), ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if code.shape[0] > 1 else 0)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predicted language, score and ambiguity of every text. No shuffle of texts: one pass to gather the sample, one to
    predict."""
    languages, code, weights, reliable = fit(docs, per_language, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = b.column(1).to_pylist()
                some = [i for i, t in enumerate(texts) if t and languages and has_letter(t)]
                lang, score, close = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
                if some:
                    best, share, gap = decode(np.stack([features(texts[i]) for i in some]) @ weights, code, reliable)
                    for i, k in zip(some, best):
                        lang[i] = languages[k]
                    score[some], close[some] = np.clip(share, 0, 1), gap < CLOSE
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score), pa.array(close)], ["id", "lang_pred", "score", "ambiguous"])

    rows = need(docs, id_col, text_col).toDF("id", "text")
    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "ambiguous")
