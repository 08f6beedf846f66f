"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit of a fingerprint gets a non-zero vector of radius + 1 bits; each of the 2^(radius+1) - 1 non-zero vectors v
keeps the bits whose vector has an odd product with v. The at most `radius` bits in which two fingerprints differ
span fewer dimensions than there are, so some v is orthogonal to all of them and its mask hides every difference: the
pair meets in that table. Nothing within the radius is missed.

Equal fingerprints are merged first. Tables' buckets of up to SMALL fingerprints are compared pair by pair. Larger ones
have an exact way of their own. Up to a radius of 2: two fingerprints differ in at most 2 bits if and only if some value
is at most one bit from both, so each is joined to all 65 values around it, and whoever meets at a value (65 at most)
is linked to the least of them. Beyond: the bucket is dealt into blocks of BLOCK, each pair of blocks is compared by
itself, and gives back for each fingerprint one link to the first of those that its links lead to, never the pairs.

Defined results: a null or blank text has the fingerprint zero and links like any other; a text of fewer words than a
shingle is one shingle; repeated rows, and rows that share an id, each get their row; a null id is never the least of
its component unless all are null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import dealt_in_blocks, first_linked, sorted_groups
from tidemark.llm.common import map_texts, need, written
from tidemark.llm.components import components

#: Fingerprints of a bucket up to which its pairs are compared; those of a block of a larger one.
SMALL, BLOCK = 16, 512


def fingerprint(text: str | None, words: int = 3, block: int = 1 << 15) -> int:
    """Majority of the bits of the shingles' XXH64, unsigned. Only A-Z are lower-cased; words end at white space."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    if len(found) < words:
        shingles = iter([b" ".join(found)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
        n = len(found) - words + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, block):
        size = min(block, n - at)
        h = np.fromiter((xxh64_intdigest(s, 42) for s, _ in zip(shingles, range(size))), "<u8", size)
        ones += np.unpackbits(h.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): fp as a signed long of the same 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    rows = need(docs, id_col, text_col).toDF("id", "text")
    return map_texts(rows, run, f"id {dict(rows.dtypes)['id']}, fp long")


def covering_masks(radius: int = 2, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector, as signed longs."""
    size = 1 << radius + 1
    vector = [i % (size - 1) + 1 for i in range(bits)]
    masks = [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links_in_blocks(many: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between the fingerprints of large buckets. many: (bucket, fp, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, ("bucket", "i", "j")):
            fp, side = t.column("fp").to_numpy(), t.column("side").to_numpy()
            x = fp.view(np.uint64)
            near = (np.bitwise_count(x[:, None] ^ x[None, :]) <= radius) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
            first = first_linked(near)
            some = np.flatnonzero(first != np.arange(len(fp)))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(fp[first[some]], pa.int64()), pa.array(fp[some], pa.int64())], ["u", "v"])

    return dealt_in_blocks(many, ["bucket"], "fp", block).mapInArrow(run, "u long, v long")


def fingerprint_links(distinct: DataFrame, radius: int = 2, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """Links (u, v) whose components are those of all pairs of fingerprints within the radius. distinct: (fp)."""
    # A bucket is known by a hash of its table and the bits that are left; should two ever share one, they are compared together.
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(covering_masks(radius))])
    placed = distinct.select("fp", F.explode(tables).alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    placed = written(placed.join(sizes, "bucket"), "buckets")
    few, many = placed.where(F.col("n") <= small), placed.where(F.col("n") > small)
    pairs = few.alias("a").join(few.alias("b"), "bucket").where("a.fp < b.fp").where(F.bit_count(F.expr("a.fp ^ b.fp")) <= radius)
    pairs = pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    if radius > 2:
        return pairs.union(links_in_blocks(many, radius, block))
    around = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)) for i in range(64)])
    met = many.select("fp").distinct().select("fp", F.explode(around).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    met = met.groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = met.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    if radius == 1:
        stars = stars.where(F.bit_count(F.expr("u ^ v")) <= 1)
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """Fingerprint (16 hex digits) and component (its least id) of every row."""
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    groups = rows.groupBy("fp").agg(F.min("id").alias("first"))
    labels = components(fingerprint_links(groups.select("fp"), radius))
    labelled = groups.join(labels, groups.fp == labels.node, "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = labelled.join(least, "label").select("fp", "component_id")
    out = rows.join(by_fp, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
