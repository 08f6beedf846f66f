"""The table of indicator snapshots: one row a market, timeframe and candle, and what is reported of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import SERIES
from tidemark.operators.reports import MARKET, enough_by_timeframe, snapshot_plan
from tidemark.sources.upserts import latest_wins

KEY = [*SERIES, "candle_ms"]


def upsert_snapshots(stored: DataFrame, incoming: DataFrame, now_ms: Column) -> DataFrame:
    """incoming (with seq) in place of stored ones of the same candle; what is written is calculated now."""
    return latest_wins(stored, incoming.withColumn("calculated_ms", now_ms), KEY)


def health(snapshots: DataFrame) -> DataFrame:
    """Snapshots, markets, newest candle and newest calculation of each timeframe."""
    return snapshots.groupBy("timeframe").agg(F.count("*").alias("total"), F.count_distinct(*MARKET).alias("markets"), F.max("candle_ms").alias("last_candle_ms"), F.max("calculated_ms").alias("last_calculated_ms"))


def latest(snapshots: DataFrame, n: int = 20) -> DataFrame:
    """The n snapshots that were calculated last; ties by key."""
    return snapshots.orderBy(F.col("calculated_ms").desc(), *KEY).limit(n)


def with_market(snapshots: DataFrame, markets: DataFrame, *columns: str) -> DataFrame:
    """Snapshots with columns of their market."""
    return snapshots.join(markets.select(*MARKET, *columns), MARKET)


def plan(markets: DataFrame, candles: DataFrame, snapshots: DataFrame, minimum: int) -> DataFrame:
    """Of each timeframe: markets, those with enough closed candles and without, and the snapshots that a run would
    create and update. markets: the ones planned for."""
    own = markets.select(*MARKET).distinct()
    have = enough_by_timeframe(candles.join(own, MARKET, "left_semi"), minimum)
    stored = snapshots.join(own, MARKET, "left_semi").groupBy("timeframe").agg(F.count("*").alias("existing"))
    number = own.agg(F.count("*").alias("markets"))
    rows = have.join(stored, "timeframe", "left").fillna(0, ["existing"]).crossJoin(F.broadcast(number))  # one row
    created = snapshot_plan(F.col("enough"), F.col("existing"), F.col("markets"))
    return rows.select("timeframe", "markets", "enough", "existing", *created)


def run_stats(results: DataFrame) -> DataFrame:
    """Markets, created, updated, skipped and failed ones in all and by exchange. results: (exchange, symbol, outcome)."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return results.rollup("exchange").agg(F.count_distinct(*MARKET).alias("markets"), count("created"), count("updated"), count("skipped"), count("error"))
