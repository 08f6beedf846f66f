"""Coverage, health and plan reports over candles and markets: single-pass conditional aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.indicators import SERIES
from tidemark.operators.asof import ranked
from tidemark.operators.predicates import EXCLUDED_BASES, active_market

MARKET = ["exchange", "symbol"]


def when_closed(value: str) -> Column:
    return F.when(F.col("closed"), F.col(value))


def health_by_timeframe(candles: DataFrame) -> DataFrame:
    """Candles, closed, open, markets, first open, last closed and last open of each timeframe."""
    return candles.groupBy("timeframe").agg(
        F.count("*").alias("total"), F.count_if("closed").alias("closed"), F.count_if(~F.col("closed")).alias("open"),
        F.count_distinct(*MARKET).alias("markets"), F.min("open_ms").alias("first_open_ms"),
        F.max(when_closed("open_ms")).alias("last_closed_ms"), F.max("open_ms").alias("last_open_ms"),
    )


def counts_by_market(candles: DataFrame, closed_last: bool = False) -> DataFrame:
    """Candles and the last open time of each market and timeframe; closed_last: of closed candles only."""
    last = when_closed("open_ms") if closed_last else F.col("open_ms")
    return candles.groupBy(*SERIES).agg(F.count("*").alias("candles"), F.max(last).alias("last_ms"))


def nested_by_market(candles: DataFrame) -> DataFrame:
    """A row per market with its timeframes as a sorted array. At most one entry for each timeframe."""
    per = counts_by_market(candles)
    return per.groupBy(*MARKET).agg(F.array_sort(F.collect_list(F.struct("timeframe", "candles", "last_ms"))).alias("timeframes"))


def duplicate_keys(candles: DataFrame, keys: tuple[str, ...] = (*SERIES, "open_ms")) -> DataFrame:
    """Number of keys that occur more than once."""
    return candles.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("duplicates"))


def coverage_by_exchange(candles: DataFrame) -> DataFrame:
    return candles.groupBy("exchange").agg(F.count_distinct("symbol").alias("markets"), F.count_distinct("timeframe").alias("timeframes"), F.count("*").alias("candles"), F.min("open_ms").alias("first_ms"), F.max("open_ms").alias("last_ms"))


def enough_history(candles: DataFrame, minimum: int) -> DataFrame:
    """Markets and timeframes with at least `minimum` closed candles."""
    per = candles.where("closed").groupBy(*SERIES).agg(F.count("*").alias("candles"))
    return per.where(F.col("candles") >= minimum).groupBy("timeframe").agg(F.count("*").alias("markets"))


def enough_by_timeframe(candles: DataFrame, minimum: int) -> DataFrame:
    """Markets with at least `minimum` closed candles of each timeframe that has candles; 0 is a number too."""
    per = candles.groupBy(*SERIES).agg(F.count_if("closed").alias("closed"))
    return per.groupBy("timeframe").agg(F.count_if(F.col("closed") >= minimum).alias("enough"))


def with_market(candles: DataFrame, markets: DataFrame, *columns: str) -> DataFrame:
    """Candles with columns of their market. Only what is reported of them should be left before: counts by market."""
    return candles.join(markets.select(*MARKET, *columns), MARKET)


def counts_of_asset(candles: DataFrame, markets: DataFrame, base: str, closed_last: bool = False) -> DataFrame:
    """Candles and last open time of each market and timeframe of one asset. Candles of other markets go first."""
    own = markets.where(F.col("base") == base)
    return with_market(counts_by_market(candles.join(own.select(*MARKET), MARKET, "left_semi"), closed_last), own, "base")


def top_coverage(candles: DataFrame, markets: DataFrame, assets: DataFrame, top: int = 10) -> DataFrame:
    """Of the active markets of the first `top` assets: how many there are, and how many have candles, by timeframe."""
    best = assets.where(F.col("rank") <= top).select(F.col("symbol").alias("base"))
    own = markets.where(active_market()).join(best, "base", "left_semi").select(*MARKET)
    number = own.agg(F.count("*").alias("wanted"))
    have = candles.join(own, MARKET, "left_semi").groupBy("timeframe").agg(F.count_distinct(*MARKET).alias("covered"))
    return have.crossJoin(F.broadcast(number))  # one row


def coverage_of_page(candles: DataFrame, page: DataFrame) -> DataFrame:
    """Closed candles and their newest open time of the markets of a page."""
    own = candles.where("closed").join(page.select(*MARKET), MARKET, "left_semi")
    return own.groupBy(*SERIES).agg(F.count("*").alias("candles"), F.max("open_ms").alias("last_ms"))


def markets_with_candles(markets: DataFrame, candles: DataFrame) -> DataFrame:
    return markets.join(candles.select(*MARKET).distinct(), MARKET, "left_semi")


def charted_assets(assets: DataFrame, markets: DataFrame, candles: DataFrame) -> DataFrame:
    """Assets that have an active market that has any candle: two semi joins."""
    own = markets_with_candles(markets.where(active_market()), candles)
    return assets.join(own.select(F.col("base").alias("symbol")).distinct(), "symbol", "left_semi")


def market_overview(assets: DataFrame) -> DataFrame:
    """Sum of the market caps (none is 0) and number of published and enabled ones."""
    return assets.agg(F.sum(F.coalesce("market_cap", F.lit(0.0))).alias("market_cap"), F.count_if(F.col("enabled") & (F.col("status") == "PUBLISHED")).alias("published"))


def published_strategies(strategies: DataFrame) -> DataFrame:
    """Enabled and published ones by name, the newest version first."""
    return strategies.where(F.col("enabled") & (F.col("status") == "PUBLISHED")).orderBy("slug", F.col("version").desc())


def missing_timeframes(candles: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(candles.select("timeframe").distinct(), "timeframe", "left_anti")


def closed_open_totals(candles: DataFrame) -> DataFrame:
    return candles.agg(F.count_if("closed").alias("closed"), F.count_if(~F.col("closed")).alias("open"))


def markets_by_exchange(markets: DataFrame) -> DataFrame:
    return markets.groupBy("exchange").agg(F.count("*").alias("total"), F.count_if(active_market()).alias("active"))


def overview(strategies: DataFrame, assets: DataFrame, markets: DataFrame, candles: DataFrame, signals: DataFrame, top: int = 100) -> DataFrame:
    """The eight figures of the first page, a row each in their order: strategies, assets of the universe, active markets of its
    assets and of all, candles, active signals, venues with an active market, and the last closed hourly candle (null
    if there is none). markets: base is the asset's symbol."""
    chosen = assets.where(F.col("rank").between(1, top))
    active = markets.where(active_market())
    one = lambda n, name, rows, value=F.count("*"): rows.agg(value.cast("long").alias("value")).select(F.lit(n).alias("place"), F.lit(name).alias("figure"), "value")
    figures = [
        one(1, "strategies", strategies), one(2, "assets in the universe", chosen.where("enabled")),
        one(3, "markets in the universe", active.join(chosen.select(F.col("symbol").alias("base")), "base", "left_semi")), one(4, "active markets", active), one(5, "candles", candles),
        one(6, "active signals", signals.where("status = 'ACTIVE'")), one(7, "exchanges", active, F.count_distinct("exchange")),
        one(8, "last closed hour", candles.where("timeframe = '1h'"), F.max(when_closed("open_ms"))),
    ]
    return reduce(DataFrame.unionByName, figures)


def asset_counts(assets: DataFrame, top: int = 100) -> DataFrame:
    """All, enabled, in the universe, in the top 500 and ranked, in one pass."""
    return assets.agg(F.count("*").alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(F.col("rank").between(1, top)).alias("universe"), F.count_if("top500").alias("top500"), F.count("rank").alias("ranked"))


def ingestion_plan(markets: DataFrame, timeframes: int, limit: int) -> DataFrame:
    """Active markets of each exchange, tasks (markets x timeframes) and candles at most."""
    per = markets.where(active_market()).groupBy("exchange").agg(F.count("*").alias("markets"))
    return per.select("exchange", "markets", (F.col("markets") * timeframes).alias("tasks"), (F.col("markets") * timeframes * limit).alias("max_candles"))


def run_allowed(tasks: Column, confirmed: bool = False, most: int = 500) -> Column:
    return (tasks <= most) | F.lit(confirmed)


def snapshot_plan(enough: Column, existing: Column, markets: Column) -> list[Column]:
    """Snapshots that a run creates and updates, and markets without enough history."""
    zero = F.lit(0).cast("long")
    return [F.greatest(enough - existing, zero).alias("created"), F.least(existing, enough).alias("updated"), (markets - enough).alias("without")]


def liquidity(markets: DataFrame) -> DataFrame:
    """Per asset that is not an excluded base: sum, maximum and number of positive quote volumes, and the score made of
    them."""
    volume = F.when(F.col("quote_volume") > 0, F.col("quote_volume"))
    markets = markets.where(~F.col("base").isin(*EXCLUDED_BASES))
    per = markets.groupBy(F.col("base").alias("symbol")).agg(F.coalesce(F.sum(volume), F.lit(0.0)).alias("total"), F.coalesce(F.max(volume), F.lit(0.0)).alias("highest"), F.count(volume).alias("markets"))
    rest = F.greatest(F.col("total") - F.col("highest"), F.lit(0.0))
    factor = 1 + 0.05 * F.least(F.col("markets") - 1, F.lit(4))
    return per.withColumn("score", (0.7 * F.col("highest") + 0.3 * rest) * factor)


def ranked_assets(markets: DataFrame, top: int = 500) -> DataFrame:
    """Assets by score, ties by symbol."""
    return ranked(liquidity(markets), [F.col("score").desc(), F.col("symbol")]).withColumn("top500", F.col("rank") <= top)


def top_per_exchange(markets: DataFrame, n: int) -> DataFrame:
    """The n markets of each exchange with the most quote volume."""
    place = F.row_number().over(W.partitionBy("exchange").orderBy(F.col("quote_volume").desc_nulls_last(), "symbol"))
    return markets.withColumn("place", place).where(F.col("place") <= n)


def task_stats(tasks: DataFrame) -> DataFrame:
    """Written, skipped and created candles in all, by exchange and by timeframe: three grouping sets in one pass.

    created counts what a task has added, at least 0 and at most what it has written."""
    created = F.greatest(F.least(F.col("after") - F.col("before"), F.col("written")), F.lit(0))
    return tasks.withColumn("created", created).groupingSets([[], [F.col("exchange")], [F.col("timeframe")]], "exchange", "timeframe").agg(F.count("*").alias("tasks"), F.sum("written").alias("written"), F.sum("skipped").alias("skipped"), F.sum("created").alias("created"))
