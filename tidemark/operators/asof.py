"""Joins by time and ranks over a whole table, without a task that holds a series or the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import settled

#: Milliseconds of a bucket of time.
WIDTH = 30 * 86_400_000


def last_at_or_before(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """left with the columns of the last row of right at or before left_time, null if there is none.

    Both sides are laid into buckets of time, and a value is carried on from row to row within a bucket. What a bucket
    begins with is carried in the same way over the last rows of the buckets, of which a series has few. Of right rows with one
    time the greatest (by columns, in order) counts; rows with a null key or time join nothing."""
    known = F.struct(F.col(right_time).alias("t"), *columns)
    marks = right.dropna(subset=[*by, right_time]).select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), known.alias("_known"), F.lit(None).cast(left.schema).alias("_row"))
    asks = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(marks.schema["_known"].dataType).alias("_known"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"))
    both = marks.unionByName(asks).withColumn("_bucket", F.floor(F.col("_t") / width))
    ends = marks.groupBy(*by, F.floor(F.col("_t") / width).alias("_bucket")).agg(F.max("_known").alias("_end"))
    # What is known when a bucket begins; buckets without a row of right are asked for as well.
    asked = asks.select(*by, F.floor(F.col("_t") / width).alias("_bucket")).distinct()
    so_far = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    begins = asked.join(ends, [*by, "_bucket"], "full").select(*by, "_bucket", F.last("_end", ignorenulls=True).over(so_far).alias("_begin"))
    inside = W.partitionBy(*by, "_bucket").orderBy("_t", "_side", "_known").rowsBetween(W.unboundedPreceding, 0)
    met = both.withColumn("_known", F.last("_known", ignorenulls=True).over(inside)).where("_side = 1")
    met = met.join(begins, [*by, "_bucket"], "left")
    found = F.coalesce("_known", "_begin")
    return met.select("_row.*", *[found[c].alias(c) for c in columns])


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place by `order` (from 1), which must leave no ties: ranges of rows in order, and the number of
    rows in the ranges before. A row for each range comes to the driver."""
    dealt = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    parts = dealt.groupBy(F.shiftright("_m", 33).alias("_part")).agg(F.count("*").alias("n"), F.min("_m").alias("first")).orderBy("_part").collect()
    before, shifts = 0, []
    for p in parts:
        shifts.append((p["_part"], before - p["first"] + 1))
        before += p["n"]
    shifts = rows.sparkSession.createDataFrame(shifts, "_part long, _shift long")
    out = dealt.join(F.broadcast(shifts), F.shiftright("_m", 33) == F.col("_part"))  # a row a range
    return out.withColumn(name, F.col("_m") + F.col("_shift")).drop("_m", "_part", "_shift")
