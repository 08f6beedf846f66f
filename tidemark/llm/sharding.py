"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of places. Each shard owns virtual nodes at places that a hash gives; a place belongs to
the next node clockwise. A row's key hashes to a place. Every shard has room for its even share of the rows and no
more: rows that find it full go on clockwise to the next shard with room. Within a place, rows are let in by the order
of a hash of all they hold, so which rows go on is fixed by the data alone. Equal rows are counted first and dealt out
of their number, and a place that many rows share is ranked in as many cells as its number asks for, so no key, however
frequent, meets in one task.

The loads add up to the rooms, so row counts differ by one at most (law `rows`). The flow between places and shards
is worked out from one count for each place; no key, and nothing that grows with the rows, comes to the driver.

Defined results: a null text has size 1 and the crc of no bytes; a null id hashes like any key; equal rows are
interchangeable and each gets its own slot; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from hashlib import blake2b

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import need, written

#: Places of the ring, virtual nodes of a shard, and rows that one ranking task should hold or give out.
PLACES, NODES, RANKED = 4096, 128, 100_000


def ring_owners(shards: int, nodes: int = NODES, places: int = PLACES) -> list[list[int]]:
    """For each place, the shards in the order in which they follow clockwise."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for node in range(nodes):
            at = int.from_bytes(blake2b(f"{shard}/{node}".encode(), digest_size=8).digest(), "big") % places
            taken.setdefault(at, shard)
    missing = [s for s in range(shards) if s not in taken.values()]
    free = (p for p in range(places) if p not in taken)
    taken.update({next(free): s for s in missing})
    at = sorted(taken)
    out = []
    for place in range(places):
        first = bisect_left(at, place)
        seen: dict[int, None] = {}
        for k in range(len(at)):
            seen.setdefault(taken[at[(first + k) % len(at)]])
            if len(seen) == shards:
                break
        out.append(list(seen))
    return out


def flow(counts: dict[int, int], shards: int, owners: list[list[int]]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (place, first rank, ranks, shard, first slot): which rows of a place, by rank, go to which shard.

    All rows are offered to their own shard first; what finds no room goes on, shard by shard, in ring order."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, left, done, pieces = [0] * shards, dict(counts), dict.fromkeys(counts, 0), []
    for hop in range(shards):
        for place in sorted(left):
            shard = owners[place][hop]
            n = min(left[place], room[shard] - used[shard])
            if n:
                pieces.append((place, done[place], n, shard, used[shard]))
                used[shard] += n
                done[place] += n
                left[place] -= n
    return pieces


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, ranked: int = RANKED) -> DataFrame:
    """Shard and slot of every row. DataFrame functions only; what is shuffled is an id, a size and a checksum a row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = need(docs, id_col, text_col).toDF("id", "text").select("id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"))
    equal = rows.groupBy("id", "size", "crc").agg(F.count("*").alias("n"))
    place = F.shiftrightunsigned(F.xxhash64("id"), 52).cast("int")  # the top 12 bits: one of PLACES
    equal = written(equal.select("*", place.alias("place"), F.xxhash64("id", "size", "crc").alias("hash")), "equal-rows")
    counts = {r.place: r.n for r in equal.groupBy("place").agg(F.sum("n").alias("n")).collect()}  # PLACES at most
    owners = ring_owners(shards, nodes)
    pieces = spark.createDataFrame(flow(counts, shards, owners), "place int, first long, m long, shard int, slot0 long")
    cells = spark.createDataFrame([(p, -(-n // ranked)) for p, n in counts.items()], "place int, cells long")
    # Cells are ranges of the hash, so that ranks go on from cell to cell.
    cell = F.floor(F.shiftrightunsigned("hash", 33) * F.col("cells") / float(1 << 31)).cast("long")
    dealt = equal.join(F.broadcast(cells), "place").withColumn("cell", cell)  # PLACES rows
    before = F.sum("n").over(W.partitionBy("place").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    offsets = dealt.groupBy("place", "cell").agg(F.sum("n").alias("n")).select("place", "cell", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.sum("n").over(W.partitionBy("place", "cell").orderBy("hash", "id", "size", "crc").rowsBetween(W.unboundedPreceding, -1))
    dealt = dealt.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offsets, ["place", "cell"]).withColumn("rank", F.col("inside") + F.col("offset"))
    # At most PLACES pieces and one more for each place and shard that a row was sent on to.
    cut = dealt.join(F.broadcast(pieces), "place").where("rank < first + m and first < rank + n")
    begin, end = F.greatest("rank", "first"), F.least(F.col("rank") + F.col("n"), F.col("first") + F.col("m"))
    home = F.element_at(F.array(*[F.lit(o[0]) for o in owners]), F.col("place") + 1)
    cut = cut.select("id", "size", "crc", "shard", home.alias("home_shard"), (F.col("slot0") + begin - F.col("first")).alias("slot"), (end - begin).alias("n"))
    # Equal rows take slots in a row; those of many are given out by several tasks.
    parts = cut.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / ranked))))
    if (equal.agg(F.max("n")).first()[0] or 0) > ranked:
        parts = parts.repartition("id", "size", "crc", "shard", "part")
    each = F.explode(F.sequence(F.col("part") * ranked, F.least(F.col("n"), (F.col("part") + 1) * ranked) - 1))
    out = parts.select("*", each.alias("k"))
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", (F.col("slot") + F.col("k")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )
