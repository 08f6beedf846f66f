"""Whole evaluations: a strategy over snapshots or over candles, and structure at the horizon that venues share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import PERIODS, SERIES, minimum_candles, with_indicators
from tidemark.functions.timeframes import duration
from tidemark.operators.reports import MARKET
from tidemark.operators import decision, paging, predicates, scoring, structure, zones
from tidemark.sources.tables import settled


def price_matches(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Equal but for a relative tolerance; NaN matches nothing."""
    near = (a == b) | (F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)) <= tolerance)
    return F.coalesce(near & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def evaluate_custom(snapshots: DataFrame, candles: DataFrame, periods: dict = PERIODS, config: dict = decision.TREND, history: int = 300) -> DataFrame:
    """Trend scores with other periods than the snapshots have. snapshots: (exchange, timeframe, open_ms, close).

    They are worked out on the newest candles at or before a snapshot's; without enough of them, without its very
    candle, or at another price the series cannot be evaluated."""
    at = snapshots.select(*SERIES, F.col("open_ms").alias("at_ms"), F.col("close").alias("seen"))
    own = candles.where("closed").join(at, SERIES).where(F.col("open_ms") <= F.col("at_ms"))
    cut = paging.newest_per_group(own, SERIES, "open_ms", max(history, minimum_candles(periods)))
    enough = cut.groupBy(*SERIES).agg(F.count("*").alias("n"), F.max("open_ms").alias("newest_ms"))
    scored = decision.trend_score(paging.latest_per_group(with_indicators(cut, periods), SERIES, "open_ms"), config)
    out = at.join(enough, SERIES, "left").join(scored.drop("open_ms"), SERIES, "left")
    reason = (
        F.when(F.coalesce("n", F.lit(0)) < minimum_candles(periods), "history")
        .when(F.col("newest_ms") != F.col("at_ms"), "candle")
        .when(~price_matches(F.col("close"), F.col("seen")), "price")
    )
    out = out.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "evaluated").otherwise("cannot-evaluate"))
    kept = [F.when(F.col("status") == "evaluated", F.col(c)).alias(c) for c in ("long_score", "short_score", "direction")]
    return out.select(*SERIES, F.col("at_ms").alias("open_ms"), "status", "reason", *kept)


def filtered_markets(markets: DataFrame, top_only: bool, minimum_volume: float) -> DataFrame:
    """(exchange, symbol, reason) of markets that a strategy's filters leave out. markets: with rank and quote_volume."""
    return markets.select(*MARKET, predicates.filter_reason(top_only, minimum_volume).alias("reason")).where("reason is not null")


def market_verdicts(candles: DataFrame, timeframe: str, now_ms: int | Column, group: list[str], swing, internal, filtered: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The horizon of each group, and a row for each of its markets: evaluated on candles up to the horizon only, or
    filtered, which takes no part in the horizon."""
    members = candles.select(*dict.fromkeys([*group, *MARKET])).distinct()
    left_out = None
    if filtered is not None:
        filtered = settled(filtered.select(*MARKET, F.col("reason") if "reason" in filtered.columns else F.lit(None).cast("string").alias("reason")))
        left_out = members.join(filtered, MARKET)
        members = members.join(filtered, MARKET, "left_anti")
        candles = candles.join(filtered, MARKET, "left_anti")
    horizon = decision.common_horizon(members.select(*group, "exchange").distinct(), candles, timeframe, now_ms, group, "exchange")
    horizon = settled(horizon)
    usable = horizon.where("status = 'ok'").select(*group, F.col("common_ms").alias("at_ms"))
    upto = candles.join(usable, group).where(F.col("open_ms") <= F.col("at_ms"))
    rows = settled(structure.prepared(upto.select(*candles.columns)))
    verdicts = scoring.score_series(rows, swing, internal)
    seen = rows.groupBy(*SERIES).agg(F.max("open_ms").alias("open_ms"))
    own = dict.fromkeys([*group, *MARKET])
    none = F.lit(None).cast("string")
    results = verdicts.join(seen, SERIES).join(members, MARKET).select(*own, "open_ms", "status", "direction", "long_score", "short_score", F.when(F.col("status") != "evaluated", F.col("status")).alias("reason"))
    if left_out is not None:
        empty = {c: F.lit(None).cast(t) for c, t in results.dtypes if c not in own and c != "reason"}
        results = results.unionByName(left_out.select(*own, "reason").withColumns(empty | {"status": F.lit("filtered")}))
    return horizon, settled(results.withColumn("reason", F.coalesce("reason", none)))


def structure_at_horizon(candles: DataFrame, timeframe: str, now_ms: int | Column, group: list[str], least: int = 2, swing: int | tuple[int, int] = scoring.SWING, internal: int | tuple[int, int] = scoring.INTERNAL, filtered: DataFrame | None = None) -> DataFrame:
    """Structure verdict of each group of venues at their common horizon: (group, horizon, votes, usable).

    candles: one timeframe, with the group's columns, one market of a group at each venue. Every venue is evaluated on candles up to the horizon only; the
    vote counts if the horizon is ok and every verdict rests on the horizon's candle. filtered (exchange, symbol and, if
    known, the reason; see filtered_markets): markets that take no part in the horizon and are not evaluated, but count among
    the results as skipped."""
    horizon, results = market_verdicts(candles, timeframe, now_ms, group, swing, internal, filtered)
    votes = decision.vote(results, group, least)
    aligned = decision.alignment(results, group, timeframe).select(*group, "safe")
    out = horizon.join(votes, group, "left").join(aligned, group, "left")
    ok = (F.col("status") == "ok") & F.coalesce("safe", F.lit(False))
    return out.select(*group, F.col("status").alias("horizon_status"), "common_ms", "relative_lag", "absolute_lag", "evaluated", "skipped", "long_votes", "short_votes", "neutral_votes", ok.alias("usable"), F.when(ok, F.col("direction")).alias("direction"), F.when(ok, F.col("confirmation")).alias("confirmation"))


def aggregate_summary(candles: DataFrame, timeframe: str, now_ms: int | Column, group: list[str], least: int = 2, swing: int | tuple[int, int] = scoring.SWING, internal: int | tuple[int, int] = scoring.INTERNAL, filtered: DataFrame | None = None) -> DataFrame:
    """What structure_at_horizon says of each group, with its participants: how many were evaluated, could not be, or were
    filtered, why the vote does not count, and per_exchange, a row a market in order of venues. Votes and direction are
    there only where the vote counts."""
    horizon, results = market_verdicts(candles, timeframe, now_ms, group, swing, internal, filtered)
    votes, aligned = decision.vote(results, group, least), decision.alignment(results, group, timeframe).select(*group, "safe", "off_grid", "times")
    n = lambda test: F.count_if(test)
    good, left = F.col("status") == "evaluated", F.col("status") == "filtered"
    shown = F.struct("exchange", "symbol", F.when(good | left, F.col("status")).otherwise("cannot-evaluate").alias("status"), "reason", "direction", "long_score", "short_score", F.when(good, F.col("open_ms")).alias("horizon_ms"))
    parts = results.groupBy(*group).agg(n(left).alias("filtered_count"), n(~good & ~left).alias("cannot_evaluate_count"), F.array_sort(F.collect_list(shown)).alias("per_exchange"))  # a venue each
    out = horizon.join(votes.drop("skipped"), group, "left").join(aligned, group, "left").join(parts, group, "left")
    fine = F.col("status") == "ok"
    refusals = F.when(~fine, F.array("status")).otherwise(F.array_compact(F.array(F.when(F.coalesce("evaluated", F.lit(0)) == 0, "nothing_evaluated"), F.when(F.col("off_grid") > 0, "off_grid"), F.when(F.col("times") > 1, "different_candles"))))
    allowed = fine & F.coalesce("safe", F.lit(False))
    counted = [F.when(allowed, F.col(c)).alias(c) for c in ("direction", "conflict", "long_votes", "short_votes", "neutral_votes", "confirmation")]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*group, fine.alias("usable"), F.col("status").alias("horizon_status"), F.col("common_ms").alias("horizon_ms"), "newest_ms", "relative_lag", "absolute_lag", F.col("participants").alias("participant_count"), zero("filtered_count"), F.coalesce("evaluated", F.lit(0)).alias("evaluated_count"), zero("cannot_evaluate_count"), *counted, F.lit(least).alias("least"), allowed.alias("gate_allowed"), refusals.alias("refusals"), "per_exchange")


def overlay(rows: DataFrame, swing: int = scoring.SWING, internal: int = scoring.INTERNAL) -> DataFrame:
    """All facts of the series that are known at their last candle, in one form, for drawing. rows: prepared."""
    rows = settled(rows)
    common = [*SERIES, "kind", "side", "bottom", "top", "event_ms", "confirmed_ms", "ended_ms", "state"]
    none = F.lit(None).cast("long").alias("ended_ms")

    def fact(df: DataFrame, kind: str, side, bottom, top, ended=none, state=F.lit("CONFIRMED")) -> DataFrame:
        return df.select(*SERIES, F.lit(kind).alias("kind"), side.alias("side"), bottom.alias("bottom"), top.alias("top"), "event_ms", "confirmed_ms", ended.alias("ended_ms"), state.alias("state")).select(*common)

    out, gaps = [], settled(structure.gaps(rows))
    for layer, n in (("swing", swing), ("internal", internal)):
        pivots, events = structure.both_pivots(rows, n, n), settled(structure.structure_events(rows, n, n))
        out += [fact(pivots, f"{layer} pivot", F.col("kind"), F.col("price"), F.col("price")), fact(events, f"{layer} event", F.concat_ws(" ", "type", "dir"), F.col("level"), F.col("level"))]
        levels = settled(zones.liquidity_levels(rows, n, n))
        if layer == "swing":
            out.append(fact(levels.withColumn("confirmed_ms", F.col("created_ms")), "liquidity", F.concat_ws(" ", "origin", "side"), F.col("price"), F.col("price"), F.col("resolved_ms"), F.col("state")))
            ranges = structure.dealing_ranges(events).withColumn("event_ms", F.col("opened_ms")).withColumn("confirmed_ms", F.col("opened_ms"))
            out.append(fact(ranges, "range", F.col("dir"), F.col("low"), F.col("high"), F.col("closed_ms"), F.when(F.col("closed_ms").isNull(), "OPEN").otherwise("CLOSED")))
        blocks = zones.order_blocks(rows, events, gaps, levels)
        out.append(fact(blocks, f"{layer} block", F.col("dir"), F.col("bottom"), F.col("top"), F.coalesce("invalidated_ms", "expired_ms"), F.col("state")))
    lives = structure.gap_lives(rows, gaps)
    out.append(fact(lives, "gap", F.col("direction"), F.col("bottom"), F.col("top"), F.coalesce("invalidated_ms", "expired_ms"), F.col("state")))
    found = structure.displacements(rows).withColumn("event_ms", F.col("open_ms")).withColumn("confirmed_ms", F.col("open_ms") + duration(F.col("timeframe")))
    out.append(fact(found, "displacement", F.col("direction"), F.lit(None).cast("double"), F.lit(None).cast("double")))
    whole = out[0]
    for f in out[1:]:
        whole = whole.unionByName(f)
    return whole
