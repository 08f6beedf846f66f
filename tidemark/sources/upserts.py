"""Upserts without a table format: latest-wins merges that are written to a new path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import SERIES
from tidemark.operators.predicates import sound_candle

CANDLE_KEY = [*SERIES, "open_ms"]


def latest_wins(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, incoming ones in place of stored ones with the same key. One shuffle on the key; of several rows
    with a key the one that `seq` says is last. If stored rows have a seq as well, an older answer that comes late does not
    replace a newer one; of equal ones the incoming one stays."""
    columns = stored.columns
    kept = F.col("seq").cast("long") if "seq" in columns else F.lit(-1).cast("long")
    order = lambda seq, new: F.struct(seq.alias("seq"), F.lit(new).alias("new")).alias("_seq")
    both = stored.select("*", order(kept, 0)).unionByName(incoming.select(*columns, order(F.col("seq").cast("long"), 1)))
    others = [c for c in columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*others), "_seq").alias("row")).select(*keys, *[F.col("row")[c].alias(c) for c in others]).select(*columns)


def upsert_candles(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Unsound candles are skipped; the open candle is rewritten until it is closed."""
    return latest_wins(stored, incoming.where(sound_candle()), CANDLE_KEY)


def upsert_markets(stored: DataFrame, incoming: DataFrame, keys: list[str], keep: str = "asset_id") -> DataFrame:
    """Incoming values win, but for `keep`, which a stored row never loses."""
    merged = latest_wins(stored, incoming, keys)
    old = stored.select(*keys, F.col(keep).alias("_old"))
    return merged.join(old, keys, "left").withColumn(keep, F.coalesce("_old", keep)).drop("_old").select(*stored.columns)


def rewrite_ranks(assets: DataFrame, ranks: DataFrame) -> DataFrame:
    """All ranks anew; an asset that is not ranked now has none."""
    new = ranks.select("symbol", F.col("rank").alias("_rank"), F.col("top500").alias("_top"))
    out = assets.join(new, "symbol", "left").withColumn("rank", F.col("_rank")).withColumn("top500", F.coalesce("_top", F.lit(False)))
    return out.select(*assets.columns)


def incremental_cut(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming candles from the last stored open time of their series on, that one included; all of a new series."""
    last = stored.groupBy(*SERIES).agg(F.max("open_ms").alias("_last"))
    out = incoming.join(last, SERIES, "left")
    return out.where(F.col("_last").isNull() | (F.col("open_ms") >= F.col("_last"))).drop("_last")
