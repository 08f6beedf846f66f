"""Near-duplicate vectors by iterative quantisation.

A rotation is learned that makes the signs of the rotated principal components balanced codes close to the vectors
(alternating between codes and the orthogonal Procrustes solution). Codes are retrieved through multi-index Hamming
tables: their bits are dealt to m disjoint substrings, and two codes meet if they differ in at most `probe` bits of one
of them, for which each substring is looked up without each choice of `probe` of its bits. By the pigeonhole principle
all codes that differ in fewer than m * (probe + 1) bits meet. Which bits two vectors at the threshold differ in is seen
on sample vectors moved that far, with the codes in use: codes are of centred vectors, whose angle is larger where all
share a direction. m and probe follow from it: those of least cost with which the share FOUND of such pairs meets.
Vectors that meet are compared by cosine in double precision.

Equal vectors are merged first (by two independent hashes) and counted. A bucket larger than BLOCK is dealt into blocks,
and each pair of blocks is compared by itself. A task gives back, for each vector, the weight of the vectors it found
and one link to the first vector of its piece, never the pairs. A pair that several tables find counts in the first of
them only, which its two codes tell.

The rotation is fitted to at most `sample` vectors (a documented bound); every vector is indexed and compared.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors of another length
than most, link with nothing; repeated rows and rows that share an id each get their row; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import dealt_in_blocks, first_linked, sorted_groups
from tidemark.llm.common import need, written
from tidemark.llm.components import components

#: Vectors of a block, vectors that the rotation is fitted to, and the share of pairs at the threshold to be found.
BLOCK, SAMPLE, FOUND = 512, 20_000, 0.98
#: Vectors that the differing bits are seen on, bits of a substring that may differ at most, tables at most, and the cost
#: of a vector's place in a table in comparisons of two vectors.
DRAWN, MOST_PROBED, MOST_TABLES, PLACED = 4_000, 2, 1 << 11, 64


def fit_rotation(x: np.ndarray, rounds: int = 40, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) of unit vectors x."""
    bits = min(bits, x.shape[1])
    mean = x.mean(axis=0)
    _, _, axes = np.linalg.svd(np.cov((x - mean).T) if len(x) > 1 else np.eye(x.shape[1]))
    main = axes[:bits].T
    v = (x - mean) @ main
    turn, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((bits, bits)))
    for _ in range(rounds):
        left, _, right = np.linalg.svd(v.T @ np.where(v @ turn >= 0, 1.0, -1.0))
        turn = left @ right
    return mean, main @ turn


def differing(x: np.ndarray, mean: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which code bits differ (a row a pair) in pairs at the threshold, and in pairs drawn from the unit vectors x. Each
    vector is moved to the threshold in two directions: any, and that of the difference of two other vectors."""
    draw = np.random.default_rng(7)
    x = x[:DRAWN]
    code = (x - mean) @ turn >= 0
    a, b = x[draw.permutation(len(x))], x[draw.permutation(len(x))]
    found = []
    for way in (draw.standard_normal(x.shape), a - b):
        way = way - (way * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(way, axis=1)
        some = size > 1e-9
        moved = threshold * x[some] + math.sqrt(max(0.0, 1 - threshold**2)) * way[some] / size[some, None]
        found.append(code[some] != ((moved - mean) @ turn >= 0))
    # The harder of the two directions counts.
    near = max((d for d in found if len(d)), key=np.mean, default=np.zeros((1, turn.shape[1]), bool))
    return near, code != np.roll(code, 1, axis=0) if len(x) > 1 else np.zeros((1, turn.shape[1]), bool)


def tables_for(n: int, near: np.ndarray, far: np.ndarray, found: float = FOUND) -> list[list[int]]:
    """The code bits that each table looks up: of all numbers of substrings and of probed bits with which the share
    `found` of the pairs `near` meet, those of least cost. near, far: which bits differ in pairs at the threshold and
    in any two vectors."""
    bits, best = near.shape[1], None
    apart = far.sum(axis=1)
    for m in range(1, bits + 1):
        parts = [list(range(j, bits, m)) for j in range(m)]
        least = np.stack([near[:, p].sum(axis=1) for p in parts], axis=1).min(axis=1)
        for probe in range(min(MOST_PROBED, bits // m) + 1):
            tables = sum(math.comb(len(p), probe) for p in parts)
            if (least <= probe).mean() < found or tables > MOST_TABLES:
                continue
            # Of d differing bits none is among those looked up.
            width = bits // m - probe
            meets = np.array([math.comb(bits - d, width) / math.comb(bits, width) for d in range(bits + 1)])
            cost = tables * (PLACED + n * meets[apart].mean())
            if best is None or cost < best[0]:
                best = cost, [sorted(set(p) - set(out)) for p in parts for out in combinations(p, probe)]
    # Where no tables do, all vectors share one bucket.
    return best[1] if best else [[]]


def as_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.asarray(c.flatten(), dtype=np.float64).reshape(len(c), dim) for c in parts]) if parts else np.empty((0, dim))


def compare(codes: np.ndarray, weights: np.ndarray, x: np.ndarray, sides: np.ndarray, table: int, masks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the links that each vector of a block pair finds here first, and the first vector that they lead to."""
    differ = codes[:, None] ^ codes[None, :]
    near = (sides[:, None] != sides[None, :]) | (sides[:, None] == 2)
    for mask in masks[:table]:
        near &= (differ & mask) != 0
    np.fill_diagonal(near, False)
    if near.any():
        near &= x @ x.T >= threshold
    return near @ weights, first_linked(near)


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Number of links, component (its least id), and whether the row is its component's least, for every row."""
    rows = need(vectors, id_col, vector_col).toDF("id", "vector").withColumn("vector", F.col("vector").cast("array<double>"))
    length = rows.where("size(vector) > 0").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    dim = length.d
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = F.coalesce((F.size("vector") == dim) & finite & F.exists("vector", lambda c: c != 0), F.lit(False))
    same = {"a": F.xxhash64("vector"), "b": F.xxhash64(F.lit(1), "vector")}
    reps = rows.where(good).withColumns(same).groupBy("a", "b").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    n = reps.count()
    drawn = reps.orderBy("a", "b").limit(sample).select("vector").toArrow()  # `sample` rows at most
    x = as_matrix(drawn.column(0), dim)
    scale = np.abs(x).max(axis=1, keepdims=True) if len(x) else 1
    x = x / scale
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
    mean, turn = fit_rotation(x) if len(x) else (np.zeros(dim), np.eye(dim)[:, : min(64, dim)])
    bits = turn.shape[1]
    chosen = tables_for(n, *differing(x, mean, turn, threshold)) if len(x) else [[]]
    masks = np.array([sum(1 << b for b in t) for t in chosen], np.uint64)
    powers = (1 << np.arange(bits, dtype=np.uint64)).astype(np.uint64)

    def unit(column: pa.Array) -> np.ndarray:
        x = as_matrix(column, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = ((unit(b.column(1)) - mean) @ turn >= 0).astype(np.uint64) @ powers
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code.view(np.int64), pa.int64())], ["rep", "code"])

    codes = written(reps.select("rep", "vector").mapInArrow(encode, "rep long, code long"), "codes")
    signed = [int(m) for m in masks.view(np.int64)]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("code").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)])
    placed = codes.select("rep", "code", F.explode(keys).alias("x")).select("rep", "code", "x.t", "x.key")
    shared = placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    placed = placed.join(shared, ["t", "key"]).join(reps.select("rep", "copies", "vector"), "rep")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        size = 0
        for t in sorted_groups(batches, ("t", "key", "i", "j")):
            if t.num_rows < 2:
                continue
            rep, code, copies, side = (t.column(c).to_numpy() for c in ("rep", "code", "copies", "side"))
            weight, first = compare(code.view(np.uint64), copies, unit(t.column("vector").combine_chunks()), side, t.column("t")[0].as_py(), masks, threshold)
            hit = np.flatnonzero(weight)
            found.append((rep[hit], weight[hit], rep[first[hit]]))
            size += len(hit)
            if size > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], ["rep", "weight", "lead"])
                found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found)], ["rep", "weight", "lead"])

    hits = written(dealt_in_blocks(placed, ["t", "key"], "rep", block).mapInArrow(find, "rep long, weight long, lead long"), "hits")
    weight = hits.groupBy("rep").agg(F.sum("weight").alias("weight"))
    labels = components(hits.select(F.col("rep").alias("u"), F.col("lead").alias("v")))
    known = reps.join(weight, "rep", "left").join(labels, reps.rep == labels.node, "left")
    known = known.select("a", "b", "first", (F.coalesce("weight", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "rep").alias("label"))
    least = known.groupBy("label").agg(F.min("first").alias("component"))
    known = known.join(least, "label").select("a", "b", "n_links", "component")
    linked = rows.where(good).select("id", *[c.alias(n) for n, c in same.items()]).join(known, ["a", "b"]).select("id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
