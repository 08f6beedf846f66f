"""Filters, summaries and asymmetric pivots of whole evaluations."""

import numpy as np
import pytest

from tests.test_series import H, bars, from_closes, walk
from tests.test_zones import mirrored
from tidemark.operators import evaluation, predicates, scoring, structure


@pytest.fixture(scope="module")
def closes():
    n = np.arange(260)
    return from_closes(100 + 6 * np.sin(n / 4) + 3 * np.sin(n / 11) + (walk(260) - 100) / 8)


def test_summary_of_a_group_with_filtered_markets(spark, closes):
    candles = bars(spark, closes).unionByName(bars(spark, closes, "Y")).unionByName(bars(spark, closes[:100], "Z"))
    markets = spark.createDataFrame([("X", "S", 3, 9e6), ("Y", "S", 4, 9e6), ("Z", "S", 500, 9e6)], "exchange string, symbol string, rank int, quote_volume double")
    out = evaluation.filtered_markets(markets, True, 1e6)
    assert [tuple(r) for r in out.collect()] == [("Z", "S", "universe")]
    got = evaluation.aggregate_summary(candles, "1h", 260 * H, ["symbol"], swing=5, filtered=out).first()
    assert (got.usable, got.gate_allowed, got.refusals, got.participant_count, got.filtered_count, got.evaluated_count, got.cannot_evaluate_count) == (True, True, [], 2, 1, 2, 0)
    each = {r.exchange: r for r in got.per_exchange}
    assert [r.exchange for r in got.per_exchange] == ["X", "Y", "Z"]
    assert (each["Z"].status, each["Z"].reason, each["Z"].long_score, each["Z"].horizon_ms) == ("filtered", "universe", None, None)
    assert each["X"].status == "evaluated" and each["X"].horizon_ms == got.horizon_ms == 259 * H and each["X"].long_score == each["Y"].long_score
    assert got.long_votes + got.short_votes + got.neutral_votes == 2
    stale = evaluation.aggregate_summary(candles, "1h", 260 * H, ["symbol"], swing=5).first()
    assert (stale.usable, stale.gate_allowed, stale.refusals, stale.direction, stale.long_votes) == (False, False, ["relative_lag_stale"], None, None)
    short = evaluation.aggregate_summary(bars(spark, closes[:50]).unionByName(bars(spark, closes[:50], "Y")), "1h", 50 * H, ["symbol"]).first()
    assert (short.usable, short.gate_allowed, short.refusals, short.cannot_evaluate_count) == (True, False, ["nothing_evaluated"], 2)
    assert {(r.status, r.reason) for r in short.per_exchange} == {("cannot-evaluate", "INSUFFICIENT_HISTORY")}


def test_pivots_that_look_further_back(spark, closes):
    assert scoring.minimum_history((5, 9)) == 40 and scoring.minimum_history(5) == 24
    a = scoring.score_series(structure.prepared(bars(spark, closes)), (6, 3), (4, 2)).first()
    b = scoring.score_series(structure.prepared(bars(spark, mirrored(closes))), (6, 3), (4, 2)).first()
    assert a.status == b.status == "evaluated" and (a.long_score, a.short_score) == (b.short_score, b.long_score)
    same = [scoring.score_series(structure.prepared(bars(spark, closes)), n, m).first() for n, m in ((5, 3), ((5, 5), (3, 3)))]
    assert same[0] == same[1]


def test_a_reader_that_refuses(spark, closes):
    from pyspark.sql import functions as F

    good = bars(spark, closes[:30]).withColumn("position", (F.col("open_ms") / H).cast("long"))
    assert predicates.checked_series(good).count() == 30
    at = lambda n, **new: good.withColumns({c: F.when(F.col("position") == n, v).otherwise(F.col(c)) for c, v in new.items()})
    cases = [("open", at(4, closed=F.lit(False))), ("prices", at(5, high=F.lit(0.0))), ("number", at(6, low=F.lit(float("nan")))), ("number", at(6, close=F.lit(None).cast("double"))), ("repeated", at(7, open_ms=F.lit(6 * H))), ("order", at(8, open_ms=F.lit(2 * H)))]
    for reason, rows in cases:
        got = predicates.series_refusals(rows).collect()
        assert len(got) == 1 and got[0].reason == reason, reason
        with pytest.raises(ValueError, match=reason):
            predicates.checked_series(rows)
    assert predicates.series_refusals(good.withColumn("timeframe", F.lit("2h"))).first().reason == "timeframe"
