"""Connected components of links that live in tables.

Each round every node picks the neighbour (or itself) that is first by that round's hash, and the links are redrawn
between the picks. As the order is drawn anew each round, a constant share of the nodes goes in each, whatever the
shape: long chains and stars alike. All tables stay distributed; each round's are written to the shared folder. Once
FEW links at most are left, which is counted, one task joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_written, written


#: Links that one task may hold: some 10 MB.
FEW = 100_000


def join_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, p) of each node of the links: p is the least node that links lead to."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        above.setdefault(x, x)
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = sorted((top(u), top(v)))
            above[c] = a
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["u", "p"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """links (u, v): any direction, repeats and loops allowed. Returns (node, label) of each node with a link to
    another; nodes that links join, directly or not, have one label, which is one of them."""
    ends = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    left = written(links.where("u <> v").select(*ends).distinct(), "links")
    picks: list[DataFrame] = []
    while n := left.count():
        if n <= few:
            picks.append(written(left.coalesce(1).mapInArrow(join_few, "u long, p long"), "picks"))
            break
        k = len(picks)
        both = left.union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(k)).alias("h"), F.col("v").alias("p"))).alias("best"))
        own = F.struct(F.xxhash64("u", F.lit(k)).alias("h"), F.col("u").alias("p"))
        pick = written(best.select("u", F.least("best", own)["p"].alias("p")), "picks")
        picks.append(pick)
        a, b = pick.select("u", F.col("p").alias("pu")), pick.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        fewer = left.join(a, "u").join(b, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        fewer = written(fewer, "links")
        drop_written(left)
        left = fewer
    if not picks:
        return left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    found = picks[0].select(F.col("u").alias("node"), F.col("p").alias("label"))
    for pick in picks[1:]:
        found = found.join(pick, F.col("label") == F.col("u"), "left").select("node", F.coalesce("p", "label").alias("label"))
    return found
