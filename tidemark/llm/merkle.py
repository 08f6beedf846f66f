"""Merkle manifest of a dataset: a digest per row, per source and of the whole, and the proof of each row.

A row's leaf is the SHA-256 of its fields; per source, leaves ascend by id, and every FAN consecutive nodes become
their digest until one is left, the source's subroot. Subroots, by source, become the root in the same way.

Leaves are dealt into aligned blocks of FAN^LEVELS. A block keeps each of its levels as one string, the nodes' hex digests end to
end: parents are digests of substrings of fixed width, and of the run that a node is in the substrings to its left and
right are its siblings. Blocks' top nodes are the leaves of the next round, so that the tables shrink by FAN^LEVELS each time
until a source has one node; subroots then take the same rounds as one group. Positions come from a range partitioning by
source and id: a row's place in its partition, and the counts of the partitions before it, whatever share of rows a
source has. Texts are read once and never shuffled, only their digests. A proof is put together from the top down:
blocks join the path of their top node, and each leaf adds its own segments.

DataFrame functions only. What comes to the driver is the largest number of nodes left in a round and the root. Tables
between rounds are written.

Defined results: a null field is `-`, whatever its type; null ids come first in their source, and rows of one source and
id stand in order of their leaves; repeated rows have a leaf each; null is a source, before all others; a table of one row
has its leaf as root and no siblings; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import need, sent_if_small, written

#: Nodes of a run, characters of a digest, levels of a block and its leaves.
FAN, WIDE, LEVELS = 3, 64, 5
BLOCK = FAN**LEVELS
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def field(x: Column) -> Column:
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(F.concat(*[field(f) for f in fields]))


def placed(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with pos (place in its group, by order) and total (rows of the group). Rows alike in all of it are
    dealt out by where they were read."""
    name = "placed-" + group
    by = [group, *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
    dealt = written(dealt.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33)), name)
    parts = dealt.groupBy(group, "_part").agg(F.count("*").alias("n"), F.min("_m").alias("first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), (before - F.col("first")).alias("_shift"), F.sum("n").over(whole).alias("total"))
    parts = sent_if_small(written(parts, name + "-parts"))
    return dealt.join(parts, F.expr(f"{group} <=> _g and _part = _p")).withColumn("pos", F.col("_m") + F.col("_shift")).drop("_g", "_p", "_shift", "_m", "_part")


def parents(level: Column) -> Column:
    run = FAN * WIDE
    return F.array_join(F.transform(F.sequence(F.lit(0), ((F.length(level) - 1) / run).cast("int")), lambda i: digest(F.substring(level, i * run + 1, run))), "")


def climbed(nodes: DataFrame, *carried: str) -> DataFrame:
    """Blocks of nodes (g, pos, total, hash, carried): (g, pos, total, levels, carried as arrays), where pos and total
    are those of the blocks. A source of one block has as many levels as its nodes need, others LEVELS in each block."""
    items = F.array_sort(F.collect_list(F.struct("pos", "hash", *carried)))
    blocks = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block")).agg(items.alias("items"), F.max("total").alias("nodes"))
    depth = F.lit(LEVELS)
    for d in reversed(range(LEVELS)):
        depth = F.when(F.col("nodes") <= FAN**d, d).otherwise(depth)
    steps = F.slice(F.array(*[F.lit(k) for k in range(LEVELS)]), F.lit(1), depth)
    lowest = F.array(F.array_join(F.col("items.hash"), ""))
    levels = F.aggregate(steps, lowest, lambda known, _: F.concat(known, F.array(parents(F.element_at(known, -1)))))
    return blocks.select("g", F.col("block").alias("pos"), F.ceil(F.col("nodes") / BLOCK).alias("total"), levels.alias("levels"), *[F.col(f"items.{c}").alias(c) for c in carried])


def segments(levels: Column, at: Column) -> Column:
    """Siblings of the leaf at place `at` of a block: (left, right) for each level below its top."""
    powers = F.array(*[F.lit(FAN**k) for k in range(LEVELS)])

    def one(power: Column, k: Column) -> Column:
        i = F.floor(at / power).cast("int")
        nth = i % FAN
        run = F.substring(F.get(levels, k), (i - nth) * WIDE + 1, F.lit(FAN * WIDE))
        return F.struct(F.substring(run, F.lit(1), nth * WIDE).alias("left"), F.substring(run, (nth + 1) * WIDE + 1, F.lit(FAN * WIDE)).alias("right"))

    return F.transform(F.slice(powers, F.lit(1), F.size(levels) - 1), one)


def rounds(blocks: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks above these, and the node that each group ends in: (g, hash)."""
    above: list[DataFrame] = []
    while (blocks.agg(F.max("total")).first()[0] or 1) > 1:
        nodes = blocks.select("g", "pos", "total", F.element_at("levels", -1).alias("hash"))
        blocks = written(climbed(nodes), f"{name}-{len(above) + 1}")
        above.append(blocks)
    return above, blocks.select("g", F.element_at("levels", -1).alias("hash"))


def paths(above: list[DataFrame], ends: DataFrame) -> DataFrame:
    """(g, pos, path, ...) of the nodes that the lowest of these tables is made of. ends: (g, path, ...) of the groups."""
    found = ends.withColumn("pos", F.lit(0).cast("long"))
    for table in reversed(above):
        # As many nodes as the lowest level has digests.
        n = (F.length(F.get("levels", F.lit(0))) / WIDE).cast("int")
        each = table.select(F.col("g").alias("_g"), F.col("pos").alias("_block"), "levels", F.posexplode(F.sequence(F.lit(1), n)).alias("_at", "_"))
        each = each.select("_g", "_block", "_at", segments(F.col("levels"), F.col("_at")).alias("_own"))
        joined = each.join(sent_if_small(found, size=F.size("path") + 2), F.expr("_g <=> g and _block = pos"))
        others = [c for c in ends.columns if c not in ("g", "path")]
        found = written(joined.select("g", (F.col("_block") * BLOCK + F.col("_at")).alias("pos"), F.concat("_own", "path").alias("path"), *others), "paths")
    return found


@dataclass
class Manifest:
    """blocks: (g, pos, levels, items) of the rows; paths: (g, pos, subroot, path) of the blocks' top nodes."""

    blocks: DataFrame
    paths: DataFrame
    root: str | None

    def proofs(self) -> DataFrame:
        """(item, leaf, subroot, root, siblings): siblings are (left, right) level by level, up to the root."""
        blocks = self.blocks.select(F.col("g").alias("_g"), F.col("pos").alias("_pos"), "levels", "item")
        joined = blocks.join(sent_if_small(self.paths, size=F.size("path") + 2), F.expr("_g <=> g and _pos = pos"))
        lowest = F.get("levels", F.lit(0))
        each = lambda x, k: F.struct(x.alias("item"), F.substring(lowest, k * WIDE + 1, F.lit(WIDE)).alias("leaf"), segments(F.col("levels"), k).alias("own"))
        rows = joined.select("subroot", "path", F.explode(F.transform("item", each)).alias("x"))
        return rows.select("x.item", "x.leaf", "subroot", F.lit(self.root).alias("root"), F.concat("x.own", "path").alias("siblings"))


def manifest(rows: DataFrame) -> Manifest:
    """rows: (g, id, hash, item): source, id, leaf and what goes with it."""
    leaves = placed(written(rows, "leaves"), "g", "id", "hash")  # ranges are sampled: texts would be hashed twice
    blocks = written(climbed(leaves, "item"), "blocks")
    above, subroots = rounds(blocks, "rounds")
    tops = placed(subroots.select(F.lit(0).alias("g"), F.col("g").alias("source"), "hash"), "g", "source")
    top_blocks = written(climbed(tops, "source"), "sources")
    higher, root = rounds(top_blocks, "source-rounds")
    found = root.first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    over = paths(higher, root.select("g", none.alias("path"))).select("pos", "path")
    lowest = F.get("levels", F.lit(0))
    mine = lambda s, k: F.struct(s.alias("source"), F.substring(lowest, k * WIDE + 1, F.lit(WIDE)).alias("subroot"), segments(F.col("levels"), k).alias("own"))
    sources = top_blocks.join(over, "pos").select("path", F.explode(F.transform("source", mine)).alias("x"))
    ends = written(sources.select(F.col("x.source").alias("g"), F.concat("x.own", "path").alias("path"), "x.subroot"), "source-paths")
    return Manifest(blocks, paths(above, ends), found.hash if found else None)


def folded(start: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(siblings, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def sibling_digest(siblings: Column) -> Column:
    return digest(F.array_join(F.transform(siblings, lambda s: F.concat(s["left"], s["right"])), ""))


def verified_rows(docs: DataFrame, tampered: tuple[Column, Column], fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> DataFrame:
    """Manifest of docs, and each row held against it after some texts were tampered with. tampered: which rows, and
    the text that they have then."""
    which, text = tampered
    rows = need(docs, *fields)
    own = leaf(*[F.col(f"`{f}`") for f in fields])
    other = F.when(F.coalesce(which, F.lit(False)), leaf(*[text if f == text_col else F.col(f"`{f}`") for f in fields]))
    rows = rows.select(F.col(f"`{group_col}`").alias("g"), F.col(f"`{id_col}`").alias("id"), own.alias("hash"), other.alias("other"))
    made = manifest(rows.select("g", "id", "hash", F.struct("id", F.when(F.col("other") != F.col("hash"), F.col("other")).alias("other")).alias("item")))
    found = made.proofs().withColumn("folded_root", folded(F.coalesce("item.other", "leaf"), F.col("siblings")))
    return found.select(F.col("item.id").alias(id_col), "leaf", "subroot", "root", sibling_digest(F.col("siblings")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
