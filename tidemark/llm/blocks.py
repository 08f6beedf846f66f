"""Comparing all members of a bucket without a task that holds it whole: it is dealt into blocks by a hash, and each pair
of blocks is compared by itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt_in_blocks(rows: DataFrame, bucket: list[str], member: str, block: int) -> DataFrame:
    """rows (bucket, member, n: members of the bucket) once for each pair of blocks (i, j) that its own is in, sorted so
    that a pair's rows follow each other. side: 0 and 1 for two different blocks, whose inner pairs belong to other
    block pairs; 2 for a block by itself."""
    blocks = rows.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64(member), F.col("blocks")))
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    out = pairs.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn("side", side).drop("blocks", "own", "other", "n")
    return out.repartition(*bucket, "i", "j").sortWithinPartitions(*bucket, "i", "j")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys (longs), one run at a time."""
    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        found = np.column_stack([rest.column(c).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((found[1:] != found[:-1]).any(axis=1)) + 1)]
        for a, z in zip(cuts, cuts[1:]):
            yield rest.slice(a, z - a)
        rest = rest.slice(cuts[-1])
    if rest is not None:
        yield rest


def first_linked(near: np.ndarray) -> np.ndarray:
    """Of each member the first one that links lead to. near: which members are linked, both ways."""
    label = np.arange(len(near))
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], len(near)).min(axis=1, initial=len(near)))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower
