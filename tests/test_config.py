"""Configurations fail closed; parameters keep to their bounds; journal lines are masked; evaluations refuse."""

import copy

import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import evaluation, journal
from tidemark.plans import config
from tests.test_series import H, bars, from_closes, walk

TREND = {
    "minimumSignalScore": 70,
    "weights": {"trend": 30, "mediumTrend": 15, "rsi": 20, "macd": 20, "volume": 15},
    "ema": {"fast": 20, "medium": 50, "slow": 200},
    "rsi": {"period": 14, "longMin": 52, "longMax": 72, "shortMin": 28, "shortMax": 48},
    "macd": {"fast": 12, "slow": 26, "signal": 9},
    "atr": {"period": 14, "stopMultiplier": 1.5, "takeProfit1Multiplier": 1.5, "takeProfit2Multiplier": 2.5, "takeProfit3Multiplier": 4},
    "volume": {"period": 20, "minimumRatio": 1},
    "execution": {"closedCandleOnly": True, "cooldownCandles": 3},
    "filters": {"minimumQuoteVolume24h": 1_000_000, "top500Only": True},
}
STRUCTURE = {
    "minimumSignalScore": 72, "swingLeft": 20, "swingRight": 20, "internalLeft": 3, "internalRight": 3, "atrPeriod": 14, "eqBand": 0.02,
    "structureEventFreshBars": 10, "sweepFreshBars": 5, "orderBlockFreshBars": 20, "fvgFreshBars": 20,
    "weights": {"swingStructureBias": 20, "recentSwingBos": 15, "internalStructure": 10, "liquiditySweep": 10, "swingOrderBlock": 15, "internalOrderBlock": 5, "fvg": 10, "rangePosition": 10, "confluence": 5},
}


def changed(base, path, value):
    out = copy.deepcopy(base)
    at = out
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    return out


def test_trend_config():
    assert config.trend_errors(TREND) == [] and config.standard_periods(TREND)
    for path, value in ((("ema", "fast"), 60), (("rsi", "longMin"), 80), (("weights",), dict.fromkeys(TREND["weights"], 0)), (("macd", "deadZoneRatio"), 0.2), (("atr", "period"), 1.5), (("execution", "closedCandleOnly"), 1), (("volume", "minimumRatio"), float("nan")), (("filters",), None)):
        assert config.trend_errors(changed(TREND, path, value)), path
    assert config.trend_errors([])
    assert not config.standard_periods(changed(TREND, ("rsi", "period"), 7))


def test_configurations_reach_the_engines():
    from tidemark.operators import decision, scoring

    assert config.trend_parameters(TREND) == decision.TREND
    got = config.structure_parameters(STRUCTURE)
    assert (got["swing"], got["internal"], got["weights"], got["minimum"], got["fresh"], got["band"]) == (scoring.SWING, scoring.INTERNAL, scoring.WEIGHTS, scoring.MINIMUM, scoring.FRESH, scoring.BAND)
    assert config.structure_parameters(changed(STRUCTURE, ("swingLeft",), 5))["swing"] == (5, scoring.SWING)


def test_structure_config():
    assert config.structure_errors({"1h": STRUCTURE, "4h": STRUCTURE}) == []
    for one in ({"2h": STRUCTURE}, {}, {"1h": changed(STRUCTURE, ("extra",), 1)}, {"1h": changed(STRUCTURE, ("weights", "fvg"), 11)}, {"1h": changed(STRUCTURE, ("swingLeft",), 0)}, {"1h": changed(STRUCTURE, ("filters",), {"a": 1}), "4h": STRUCTURE}):
        assert config.structure_errors(one)


def test_parameters():
    assert config.symbol_param(" btc ") == "BTC" and config.exchange_param("bybit") == "BYBIT" and config.timeframe_param("4h") == "4h"
    assert (config.limit_param(None), config.limit_param("50"), config.lenient_limit("x"), config.lenient_limit("70")) == (300, 50, 300, 70)
    assert config.timeframe_list("1h, 5m,1h") == ["1h", "5m"] and config.cursor_param("5", 0) == 5 and config.cursor_param(None, 0) is None
    for bad in (lambda: config.limit_param("49"), lambda: config.limit_param("50.5"), lambda: config.symbol_param("B-C"), lambda: config.timeframe_param("2h"), lambda: config.exchange_param(None), lambda: config.cursor_param("99999999999", 0), lambda: config.cursor_param("-1", 0)):
        with pytest.raises(ValueError):
            bad()


def test_snapshot_parameters():
    assert config.snapshot_parameters([]) == {"top": 10, "timeframes": ["1h"], "history": 300, "plan": False}
    assert config.snapshot_parameters(["--top=5", "--timeframes=5m,1h,5m", "--timeframe=4h", "--history=200", "--plan"]) == {"top": 5, "timeframes": ["5m", "1h"], "history": 200, "plan": True}
    for bad in (["--top=0"], ["--top=1.5"], ["--history=199"], ["--top", "5"], ["--limit=5"], ["--timeframe=2h"]):
        with pytest.raises(ValueError):
            config.snapshot_parameters(bad)


def test_journal(spark):
    lines = [(1, 0, "INFO", "[sync]  two\n lines"), (2, 0, "WARN", "my PASSWORD is x"), (3, 0, "INFO", "y" * 500), (4, 0, "INFO", "plain")]
    got = journal.journal(spark.createDataFrame(lines, "seq long, ts long, level string, message string"))
    rows = {r.seq: r for r in got.collect()}
    assert (rows[1].source, rows[1].message) == ("sync", "[sync] two lines")
    assert rows[2].message == journal.HIDDEN and len(rows[3].message) == 400 and rows[4].source == "app"
    page = lambda **k: [(r.seq, r.total, r.pages, r.page) for r in journal.journal_page(got, **k).orderBy("seq").collect()]
    assert page(level="INFO", page=1, size=2) == [(3, 3, 2, 1), (4, 3, 2, 1)] and page(level="INFO", page=2, size=2) == [(1, 3, 2, 2)]
    assert page(page=9, size=3) == page(page=1, size=3) and len(page(size=0)) == 4 and page(source="sync") == [(1, 1, 1, 1)] and page(level="NONE") == []
    assert {r.source for r in journal.sources(got).collect()} == {"sync", "app"}


def test_custom_periods_refuse(spark):
    candles = bars(spark, from_closes(walk(60)))
    periods = {"ema": (3, 5, 20), "rsi": 5, "macd": (3, 6, 3), "atr": 5, "volume": 5}
    last = candles.orderBy(F.col("open_ms").desc()).limit(1)

    def reason(snapshots, p=periods):
        return evaluation.evaluate_custom(snapshots, candles, p).first()

    assert reason(last).status == "evaluated" and reason(last).long_score is not None
    assert reason(last.withColumn("close", F.col("close") * (1 + 1e-8))).reason == "price"
    assert reason(last.withColumn("open_ms", F.col("open_ms") + H)).reason == "candle"
    refused = reason(last, ind.PERIODS)
    assert (refused.reason, refused.status, refused.direction) == ("history", "cannot-evaluate", None)
