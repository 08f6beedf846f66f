"""Candles, assets and markets derived from the tables at hand, for when no venue feeds are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeframes import DURATION_MS


# Which venue an event's type stands for, and the markets that users trade, by the last digit of the user's
# number (five, three and two of ten).
VENUES = {"click": "AFRICA", "error": "AMERICA", "purchase": "ASIA", "signup": "EUROPE", "view": "MIDDLE EAST"}
SYMBOLS = {"Brand#11-USDT": (0, 4), "Brand#12-USDT": (5, 7), "Brand#13-USDT": (8, 9)}


def venue_of(event_type):
    out = event_type
    for kind, venue in VENUES.items():
        out = F.when(event_type == kind, venue).otherwise(out)
    return out


def symbol_of(user_id):
    out = F.lit(None).cast("string")
    for symbol, (low, high) in SYMBOLS.items():
        out = F.when(F.pmod(user_id, F.lit(10)).between(low, high), symbol).otherwise(out)
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str):
    """Milliseconds since the epoch of a zone-less timestamp."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def events_now(events: DataFrame) -> DataFrame:
    """One row: the last instant of the events, which stands for the present."""
    return events.agg(F.max(epoch_ms("ts")).alias("now_ms"))


def candles_from_events(events: DataFrame, timeframe: str) -> DataFrame:
    """Candles on the UTC grid; a venue is an event type, a market a venue and a group of users. One shuffle, of partial
    aggregates by market and bucket."""
    width = DURATION_MS[timeframe]
    bucket = (F.floor(epoch_ms("ts") / width) * width).cast("long")
    order = F.struct("ts", "event_id")
    out = events.groupBy(venue_of(F.col("event_type")).alias("exchange"), symbol_of(F.col("user_id")).alias("symbol"), bucket.alias("open_ms")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count("*").alias("volume"),
    )
    out = out.withColumn("volume", F.col("volume").cast("double")).withColumn("timeframe", F.lit(timeframe))
    return out.crossJoin(F.broadcast(events_now(events))).withColumn("closed", F.col("open_ms") + width <= F.col("now_ms"))  # one row


def all_candles(events: DataFrame, timeframes: tuple[str, ...] = ("15m", "1h", "4h", "1d")) -> DataFrame:
    """Candles of several timeframes, each a multiple of the first: the first ones are made of the events, and all
    others of those, so that the events are read once."""
    first = candles_from_events(events, timeframes[0])
    kinds = F.array(*[F.struct(F.lit(t).alias("timeframe"), F.lit(DURATION_MS[t]).cast("long").alias("width")) for t in timeframes])
    each = first.drop("timeframe", "closed").withColumn("t", F.explode(kinds)).select("*", "t.*", (F.floor(F.col("open_ms") / F.col("t.width")) * F.col("t.width")).cast("long").alias("at"))
    out = each.groupBy("exchange", "symbol", "timeframe", "width", "at", "now_ms").agg(
        F.min_by("open", "open_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_ms").alias("close"), F.sum("volume").alias("volume")
    )
    return out.withColumnRenamed("at", "open_ms").withColumn("closed", F.col("open_ms") + F.col("width") <= F.col("now_ms")).drop("width")


def markets_from_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market per (region, brand) of lineitem's suppliers and parts, with attributes that vary by a fixed rule."""
    lines, parts, suppliers, nations, regions = (read(spark, sf_dir, n) for n in ("lineitem", "part", "supplier", "nation", "region"))
    # Lines are added up by part and supplier first, which are far fewer.
    sold = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("quote_volume"), F.sum("l_quantity").alias("volume"), F.count("*").alias("trades"))
    sold = (
        sold.join(parts, sold.l_partkey == parts.p_partkey)
        .join(suppliers, sold.l_suppkey == suppliers.s_suppkey)
        .join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
        .join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 rows
    )
    out = sold.groupBy(F.col("r_name").alias("exchange"), F.col("p_brand").alias("base")).agg(
        F.sum("quote_volume").alias("quote_volume"), F.sum("volume").alias("volume"), F.sum("trades").alias("trades")
    )
    rule = F.pmod(F.col("trades"), F.lit(11))
    return out.select(
        "exchange", "base", F.lit("USDT").alias("quote"), F.concat_ws("-", "base", F.lit("USDT")).alias("symbol"),
        F.when(F.pmod(F.col("trades"), F.lit(13)) == 0, "FUTURES").otherwise("SPOT").alias("market_type"),
        F.when(rule == 0, "INACTIVE").otherwise("ACTIVE").alias("status"), (F.pmod(F.col("trades"), F.lit(7)) != 0).alias("enabled"),
        F.when(rule == 5, F.lit(None)).otherwise(F.col("quote_volume")).alias("quote_volume"), "volume", "trades",
        (rule - 5).cast("double").alias("change"),
    )
