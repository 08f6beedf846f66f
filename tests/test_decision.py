"""Horizon, vote, alignment, freshness, upserts and pages on small tables."""

from pyspark.sql import functions as F

from tidemark.functions.timeframes import freshness
from tidemark.operators import decision, paging, predicates
from tidemark.sources import upserts

H = 3_600_000


def horizon(spark, opens, now, participants=None):
    rows = [("A", m, t * H, True) for m, ts in opens.items() for t in ts]
    candles = spark.createDataFrame(rows, "asset string, exchange string, open_ms long, closed boolean")
    members = spark.createDataFrame([("A", m) for m in (participants or opens)], "asset string, exchange string")
    return decision.common_horizon(members, candles, "1h", now * H, ["asset"], "exchange").first()


def test_horizon_statuses(spark):
    assert horizon(spark, {"x": [1, 2, 3], "y": [1, 2, 3]}, 4).status == "ok"
    got = horizon(spark, {"x": [1, 2, 3], "y": [1, 2]}, 4)
    assert (got.status, got.common_ms, got.relative_lag) == ("ok", 2 * H, 1)
    assert horizon(spark, {"x": [1], "y": [2]}, 4).status == "no_common_horizon"
    assert horizon(spark, {"x": [1], "y": [1]}, 4, ["x", "y", "z"]).status == "data_unavailable"
    assert horizon(spark, {"x": [1, 6], "y": [1]}, 7).status == "relative_lag_stale"
    assert horizon(spark, {"x": [5], "y": [5]}, 4).status == "future_horizon"
    assert horizon(spark, {"x": [1], "y": [1]}, 9).status == "absolute_stale"


def test_off_grid_candles_do_not_count(spark):
    rows = [("A", m, t, True) for m in "xy" for t in (H, 2 * H + 1)]
    candles = spark.createDataFrame(rows, "asset string, exchange string, open_ms long, closed boolean")
    members = spark.createDataFrame([("A", "x"), ("A", "y")], "asset string, exchange string")
    assert decision.common_horizon(members, candles, "1h", 2 * H, ["asset"], "exchange").first().common_ms == H


def votes(spark, directions, least):
    rows = [("A", "evaluated" if d else "filtered", d) for d in directions]
    return decision.vote(spark.createDataFrame(rows, "asset string, status string, direction string"), ["asset"], least).first()


def test_votes(spark):
    r = votes(spark, ["LONG"] * 4 + ["SHORT"], 3)
    assert (r.direction, r.confirmation, r.conflict) == ("LONG", "4/5", False)
    r = votes(spark, ["LONG"] * 3 + ["SHORT"] * 3, 3)
    assert (r.direction, r.conflict, r.confirmation) == ("NEUTRAL", True, "LONG 3/6 · SHORT 3/6")
    r = votes(spark, [None] * 3, 1)
    assert (r.evaluated, r.skipped, r.direction, r.confirmation) == (0, 3, "NEUTRAL", "0/0")
    assert votes(spark, ["LONG", "LONG", "SHORT"], 3).confirmation == "2/3"


def test_alignment(spark):
    rows = [("A", "evaluated", 3 * H), ("A", "evaluated", 3 * H), ("B", "evaluated", 3 * H), ("B", "evaluated", 2 * H), ("C", "filtered", None), ("D", "evaluated", 3 * H + 5)]
    got = {r.asset: r.safe for r in decision.alignment(spark.createDataFrame(rows, "asset string, status string, open_ms long"), ["asset"], "1h").collect()}
    assert got == {"A": True, "B": False, "C": False, "D": False}


def test_trend_score_tie_is_neutral(spark):
    row = [(100.0, None, None, None, 50.0, 0.0, 2.0)]
    df = spark.createDataFrame(row, "close double, ema20 double, ema50 double, ema200 double, rsi14 double, macd_hist double, volume_ratio double")
    got = decision.trend_score(df).first()
    assert (got.long_score, got.short_score, got.direction) == (0, 0, "NEUTRAL")


def test_freshness_edges(spark):
    df = spark.createDataFrame([(0,), (None,), (99 * H,)], "t long")
    for now, want in ((2 * H, "fresh"), (2 * H + 1, "delayed"), (6 * H, "delayed"), (6 * H + 1, "stale")):
        got = [r.f for r in df.select(freshness(F.col("t"), F.lit(now), H).alias("f")).collect()]
        assert got == [want, "missing", "fresh"]


CANDLE = "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, closed boolean"


def test_upsert_keeps_the_last_and_skips_the_unsound(spark):
    stored = spark.createDataFrame([("x", "S", "1h", 0, 1.0, 2.0, 0.5, 1.5, 1.0, False)], CANDLE)
    new = [("x", "S", "1h", 0, 1.0, 3.0, 0.5, 2.5, 1.0, False, 1), ("x", "S", "1h", 0, 1.0, 3.0, 0.5, 2.7, 1.0, True, 2), ("x", "S", "1h", H, 1.0, 0.5, 2.0, 1.0, 1.0, True, 3), ("y", "S", "1h", 0, 1.0, 2.0, 0.5, float("nan"), 1.0, True, 4)]
    got = upserts.upsert_candles(stored, spark.createDataFrame(new, CANDLE + ", seq long")).collect()
    assert [(r.exchange, r.close, r.closed) for r in got] == [("x", 2.7, True)]


def test_market_upsert_keeps_the_asset(spark):
    kind = "exchange string, symbol string, price double, asset_id long"
    got = upserts.upsert_markets(spark.createDataFrame([("x", "a", 1.0, 7)], kind), spark.createDataFrame([("x", "a", 2.0, None, 1), ("x", "b", 3.0, 8, 2)], kind + ", seq long"), ["exchange", "symbol"])
    assert sorted(map(tuple, got.collect())) == [("x", "a", 2.0, 7), ("x", "b", 3.0, 8)]


def test_incremental_cut_is_inclusive(spark):
    kind = "exchange string, symbol string, timeframe string, open_ms long"
    new = spark.createDataFrame([("x", "S", "1h", t) for t in (1, 2, 3)] + [("y", "S", "1h", 1)], kind)
    got = upserts.incremental_cut(new, spark.createDataFrame([("x", "S", "1h", 2)], kind)).collect()
    assert sorted((r.exchange, r.open_ms) for r in got) == [("x", 2), ("x", 3), ("y", 1)]


def test_keyset_pages_join_up(spark):
    df = spark.createDataFrame([(t,) for t in range(10)], "open_ms long")
    first = paging.keyset_page(df, None, 4).collect()
    assert [r.open_ms for r in first] == [6, 7, 8, 9] and first[0].has_more and first[0].next_cursor_ms == 6
    last = paging.keyset_page(df, 3, 4).collect()
    assert [r.open_ms for r in last] == [0, 1, 2] and not last[0].has_more


def test_merge_older_drops_overlap(spark):
    a, b = (spark.createDataFrame([(t,) for t in ts], "open_ms long") for ts in ((1, 2, 3), (3, 4)))
    assert sorted(r.open_ms for r in paging.merge_older(a, b).collect()) == [1, 2, 3, 4]


def test_bases(spark):
    df = spark.createDataFrame([(b,) for b in ("BTC", "USDT", "A", "btc", "X(1)", "EUR")], "base string")
    assert [r.base for r in df.where(predicates.allowed_base(F.col("base"))).collect()] == ["BTC"]


def test_tickers_that_live(spark):
    rows = [("A1", True, 1.0, 2.0), ("A1", False, 1.0, 2.0), ("A1", True, 0.0, 2.0), ("A1", True, 1.0, 0.0), ("USDT", True, 1.0, 2.0), ("A1", True, None, 2.0)]
    df = spark.createDataFrame(rows, "base string, active boolean, price double, quote_volume double")
    assert df.where(predicates.live_ticker()).count() == 1


def test_eligible_exchanges(spark):
    df = spark.createDataFrame([("X", "1h"), ("X", "4h"), ("Y", "1h"), ("X", "2h"), (None, "1h")], "e string, t string")
    got = df.select(predicates.eligible_exchange(F.col("e"), F.col("t"), ("X",), (("X", "4h"),)).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False, False, False]


def test_series_validity(spark):
    rows = [("x", "S", "1h", 0, 1.0, 2.0, 0.5, 1.5, 1.0, True), ("x", "S", "1h", 0, 1.0, 2.0, 0.5, 2.0 + 1e-9, 1.0, True), ("x", "S", "1h", H, 1.0, 2.0, 0.5, 2.1, 1.0, True), ("x", "S", "1h", 2 * H, 1.0, 2.0, 0.5, 1.5, 1.0, False)]
    r = predicates.series_validity(spark.createDataFrame(rows, CANDLE)).first()
    assert (r.n, r.sound, r.repeated) == (4, 2, 1)


def test_excluded_bases_are_not_ranked(spark):
    from tidemark.operators import reports

    df = spark.createDataFrame([("BTC", 5.0), ("USDT", 9.0), ("EUR", 7.0), ("BTC", 3.0), ("ETH", None)], "base string, quote_volume double")
    assert [(r.symbol, r["rank"]) for r in reports.ranked_assets(df).orderBy("rank").collect()] == [("BTC", 1), ("ETH", 2)]


def test_range_position_and_pages(spark):
    from tidemark.operators import structure

    df = spark.createDataFrame([(10.0,), (15.0,), (15.3,), (20.0,), (21.0,)], "price double")
    got = df.select(*structure.range_position(F.col("price"), F.lit(10.0), F.lit(20.0))).collect()
    assert [(round(r.position, 3), r.zone, r.outside) for r in got] == [(0.0, "discount", False), (0.5, "equilibrium", False), (0.53, "premium", False), (1.0, "premium", False), (1.1, "premium", True)]
    assert [paging.total_pages(n) for n in (0, 1, 50, 51)] == [1, 1, 1, 2]


def test_custom_periods_in_strategy_results(spark):
    from tests.test_config import TREND, changed
    from tests.test_series import bars, from_closes, walk
    from tidemark.operators import evaluation

    candles = bars(spark, from_closes(walk(60)))
    last = candles.orderBy(F.col("open_ms").desc()).limit(1)
    markets = spark.createDataFrame([("X", "S", 1, 2e6), ("X", "T", 2, 2e6), ("X", "U", None, 2e6), ("X", "V", 3, None)], "exchange string, symbol string, rank int, quote_volume double")
    config = changed(changed(changed(TREND, ("ema",), {"fast": 3, "medium": 5, "slow": 20}), ("macd",), {"fast": 3, "slow": 6, "signal": 3}), ("volume", "period"), 5)
    got = {r.symbol: (r.status, r.reason) for r in decision.strategy_results(markets, last, candles, config, evaluation.evaluate_custom).collect()}
    assert got == {"S": ("evaluated", None), "T": ("no-snapshot", None), "U": ("filtered", "universe"), "V": ("filtered", "volume")}
    config = changed(config, ("ema", "slow"), 200)
    assert [(r.status, r.reason) for r in decision.strategy_results(markets.where("symbol = 'S'"), last, candles, config, evaluation.evaluate_custom).collect()] == [("cannot-evaluate", "history")]
