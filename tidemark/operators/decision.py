"""From indicators to verdicts: trend score, common horizon, alignment, and the vote across exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeframes import DURATION_MS, bar_count, expected_latest_closed, on_grid
from tidemark.operators.predicates import filter_reason

# Weights, bands and thresholds of the trend strategy.
TREND = {
    "minimum_score": 70,
    "weights": {"trend": 30, "medium": 15, "rsi": 20, "macd": 20, "volume": 15},
    "rsi_long": (52, 72),
    "rsi_short": (28, 48),
    "dead_zone": 0.0,
    "volume_ratio": 1.0,
}
# Bars by which markets may differ, and by which the horizon may lag the clock.
RELATIVE_LAG, ABSOLUTE_LAG = 3, 1


def trend_score(rows: DataFrame, config: dict = TREND) -> DataFrame:
    """Long and short score and direction of snapshot rows. The volume weight goes to whoever leads before it; a
    direction takes a strict lead and the minimum score."""
    w, price = config["weights"], F.col("close")

    def yes(test) -> F.Column:
        return F.coalesce(test, F.lit(False))

    dead = F.lit(config["dead_zone"]) * F.abs(price)
    parts = {
        "trend": (yes((F.col("ema50") > F.col("ema200")) & (price > F.col("ema50"))), yes((F.col("ema50") < F.col("ema200")) & (price < F.col("ema50")))),
        "medium": (yes((F.col("ema20") > F.col("ema50")) & (price > F.col("ema20"))), yes((F.col("ema20") < F.col("ema50")) & (price < F.col("ema20")))),
        "rsi": (yes(F.col("rsi14").between(*config["rsi_long"])), yes(F.col("rsi14").between(*config["rsi_short"]))),
        "macd": (yes(F.col("macd_hist") > dead), yes(F.col("macd_hist") < -dead)),
    }

    def score(side: int) -> F.Column:
        return sum((F.when(p[side], w[n]).otherwise(0) for n, p in parts.items()), F.lit(0))

    confirmed = yes(F.col("volume_ratio") >= config["volume_ratio"])
    rows = rows.withColumn("_long", score(0)).withColumn("_short", score(1))
    extra = F.when(confirmed, w["volume"]).otherwise(0)
    rows = rows.withColumn("long_score", F.least(F.lit(100), F.col("_long") + F.when(F.col("_long") > F.col("_short"), extra).otherwise(0)))
    rows = rows.withColumn("short_score", F.least(F.lit(100), F.col("_short") + F.when(F.col("_short") > F.col("_long"), extra).otherwise(0)))
    low = config["minimum_score"]
    up = (F.col("long_score") >= low) & (F.col("long_score") > F.col("short_score"))
    down = (F.col("short_score") >= low) & (F.col("short_score") > F.col("long_score"))
    return rows.withColumn("direction", F.when(up, "LONG").when(down, "SHORT").otherwise("NEUTRAL")).withColumn("score", F.greatest("long_score", "short_score")).drop("_long", "_short")


def market_results(markets: DataFrame, scored: DataFrame, keys: list[str], top_only: bool = True, minimum_volume: float = 1_000_000.0) -> DataFrame:
    """Every market with status evaluated, filtered (and why) or no-snapshot; scores only where evaluated."""
    out = markets.join(scored, keys, "left").withColumn("reason", filter_reason(top_only, minimum_volume))
    status = F.when(F.col("reason").isNotNull(), "filtered").when(F.col("direction").isNull(), "no-snapshot").otherwise("evaluated")
    out = out.withColumn("status", status)
    for c in ("direction", "long_score", "short_score"):
        out = out.withColumn(c, F.when(F.col("status") == "evaluated", F.col(c)))
    return out


def strategy_results(markets: DataFrame, snapshots: DataFrame, candles: DataFrame, config: dict, evaluate_custom) -> DataFrame:
    """Every market's result under a checked configuration: filtered ones first; then scores from snapshots if their
    periods are the configuration's, else (by evaluate_custom) from candles. keys: exchange and symbol."""
    from tidemark.plans.config import periods_of, standard_periods, trend_parameters

    parameters = trend_parameters(config)
    keys = ["exchange", "symbol"]
    if standard_periods(config):
        scored = trend_score(snapshots, parameters).withColumn("refused", F.lit(None).cast("string"))
    else:
        scored = evaluate_custom(snapshots, candles, periods_of(config), parameters).withColumnRenamed("reason", "refused").drop("status")
    scored = scored.select(*keys, "timeframe", "open_ms", "long_score", "short_score", "direction", "refused")
    out = market_results(markets, scored, keys, config["filters"]["top500Only"], config["filters"]["minimumQuoteVolume24h"])
    refused = (F.col("status") != "filtered") & F.col("refused").isNotNull()
    return out.withColumn("status", F.when(refused, "cannot-evaluate").otherwise(F.col("status"))).withColumn("reason", F.coalesce("reason", F.when(refused, F.col("refused")))).drop("refused")


def vote(results: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Votes of the evaluated markets of each asset; both sides at the threshold is a conflict, without a direction."""
    ok = F.col("status") == "evaluated"

    def votes(d: str) -> F.Column:
        return F.count_if(ok & (F.col("direction") == d))

    out = results.groupBy(*keys).agg(votes("LONG").alias("long_votes"), votes("SHORT").alias("short_votes"), votes("NEUTRAL").alias("neutral_votes"), F.count_if(ok).alias("evaluated"), F.count_if(~ok).alias("skipped"))
    up, down, total = F.col("long_votes") >= least, F.col("short_votes") >= least, F.col("evaluated").cast("string")
    of = lambda c: F.concat(F.col(c).cast("string"), F.lit("/"), total)
    best = F.concat(F.greatest("long_votes", "short_votes").cast("string"), F.lit("/"), total)
    none = F.col("evaluated") == 0
    return out.withColumn("conflict", ~none & up & down).withColumn("direction", F.when(none | (up & down), "NEUTRAL").when(up, "LONG").when(down, "SHORT").otherwise("NEUTRAL")).withColumn(
        "confirmation", F.when(none, "0/0").when(up & down, F.concat(F.lit("LONG "), of("long_votes"), F.lit(" · SHORT "), of("short_votes"))).when(up, of("long_votes")).when(down, of("short_votes")).otherwise(best)
    )


def common_horizon(participants: DataFrame, candles: DataFrame, timeframe: str, now_ms: int | F.Column, group: list[str], member: str, relative: int = RELATIVE_LAG, absolute: int = ABSOLUTE_LAG) -> DataFrame:
    """The newest closed candle on the grid that all participants of a group have, and whether it may be used.

    participants: (group, member); candles: (group, member, open_ms, closed). An open time is common if as many
    members have it as take part: a counting join, whatever their number. now_ms: a number, or an aggregate of candles.
    Checks come in a fixed order."""
    width = DURATION_MS[timeframe]
    clock = candles.agg((F.lit(now_ms) if isinstance(now_ms, int) else now_ms).alias("_now"))  # one row
    now = F.col("_now")
    good = candles.where(F.col("closed") & on_grid(F.col("open_ms"), width)).select(*group, member, "open_ms").distinct()
    good = good.join(participants, [*group, member], "left_semi")
    n = participants.groupBy(*group).agg(F.count_distinct(member).alias("participants"))
    have = good.groupBy(*group).agg(F.count_distinct(member).alias("with_data"), F.max("open_ms").alias("newest_ms"))
    shared = good.groupBy(*group, "open_ms").agg(F.count("*").alias("members")).join(n, group).where("members = participants")
    common = shared.groupBy(*group).agg(F.max("open_ms").alias("common_ms"), F.count("*").alias("shared"))
    out = n.join(have, group, "left").join(common, group, "left").crossJoin(F.broadcast(clock))
    lag = bar_count(F.col("newest_ms") - F.col("common_ms"), width)
    late = bar_count(expected_latest_closed(now, width) - F.col("common_ms"), width)
    out = out.withColumn("relative_lag", lag).withColumn("absolute_lag", late)
    status = (
        F.when(F.coalesce("with_data", F.lit(0)) < F.col("participants"), "data_unavailable")
        .when(F.col("common_ms").isNull(), "no_common_horizon")
        .when(F.col("relative_lag") > relative, "relative_lag_stale")
        .when(F.col("absolute_lag") < 0, "future_horizon")
        .when(F.col("absolute_lag") > absolute, "absolute_stale")
        .otherwise("ok")
    )
    return out.withColumn("status", status).select(*group, "participants", F.coalesce("shared", F.lit(0)).alias("shared"), "common_ms", "newest_ms", "relative_lag", "absolute_lag", "status")


def alignment(results: DataFrame, keys: list[str], timeframe: str) -> DataFrame:
    """Whether the evaluated candles of a group are all on the grid and all the same; nothing evaluated is unsafe."""
    ok = F.col("status") == "evaluated"
    time = F.when(ok, F.col("open_ms"))
    out = results.groupBy(*keys).agg(F.count_if(ok).alias("evaluated"), F.count_if(ok & ~on_grid(F.col("open_ms"), DURATION_MS[timeframe])).alias("off_grid"), F.count_distinct(time).alias("times"))
    return out.withColumn("safe", (F.col("evaluated") > 0) & (F.col("off_grid") == 0) & (F.col("times") == 1))
