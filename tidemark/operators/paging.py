"""Pages, cursors and latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keyset_page(candles: DataFrame, before_ms: int | None, limit: int) -> DataFrame:
    """The newest `limit` candles before a cursor in ascending order, with has_more and the next cursor.

    One row more than the page is fetched to know whether there is more; never an offset."""
    rows = candles if before_ms is None else candles.where(F.col("open_ms") < before_ms)
    probe = rows.orderBy(F.col("open_ms").desc()).limit(limit + 1)
    place = F.row_number().over(W.orderBy(F.col("open_ms").desc()))  # limit + 1 rows
    page = probe.withColumn("place", place).withColumn("has_more", F.max("place").over(W.partitionBy()) > limit).where(F.col("place") <= limit)
    return page.withColumn("next_cursor_ms", F.min("open_ms").over(W.partitionBy())).drop("place").orderBy("open_ms")


def offset_page(rows: DataFrame, page: int, order: list[Column], size: int = 50) -> DataFrame:
    return rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def newest_per_group(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest n rows of each group. Spark keeps n rows a group on each task before it shuffles."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))).where(F.col("_nth") <= n).drop("_nth")


def latest_per_group(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the highest `order` of each group: one aggregate, no sort."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("row")).select(*keys, "row.*")


def merge_older(older: DataFrame, shown: DataFrame) -> DataFrame:
    """An older page put before the rows shown: only what is strictly before the first of them."""
    first = shown.agg(F.min("open_ms").alias("_first"))
    kept = older.join(F.broadcast(first), F.col("_first").isNull() | (F.col("open_ms") < F.col("_first"))).drop("_first")  # one row
    return kept.unionByName(shown)


def total_pages(rows: int, size: int = 50) -> int:
    return max(1, -(-rows // size))
