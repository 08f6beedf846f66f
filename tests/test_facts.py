"""Facts at many times from one evaluation against an evaluation of each prefix, and their documents."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts, structure
from tidemark.sources.tables import settled

H = 3_600_000
KIND = "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, closed boolean"


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    made = []
    for name in ("A", "B"):
        before = 100.0
        for k in range(230):
            close = before + float(draw.standard_normal()) * (3.0 if draw.random() < 0.1 else 0.7) + 0.4 * float(np.sin(k / 9))
            high, low = max(before, close) + 0.3 * float(draw.random()), min(before, close) - 0.3 * float(draw.random())
            made.append(("x", name, "1h", k * H, before, high, low, close, 1.0, True))
            before = close + (float(draw.standard_normal()) if draw.random() < 0.2 else 0.0)
    return spark.createDataFrame([(*r[:5], max(r[5], r[4]), min(r[6], r[4]), *r[7:]) for r in made], KIND)


@pytest.fixture(scope="module")
def known(rows):
    return settled(facts.all_versions(settled(structure.prepared(rows)), 6, 3))


def shown(df):
    return sorted((r.symbol, r.kind, r.layer, r.key, r.state, r.event_ms, r.known_from_ms, r.fields) for r in df.collect())


@pytest.mark.parametrize("bars", [120, 203])
def test_as_of_is_the_prefix(rows, known, bars):
    """Nothing from after the time is shown, and nothing known by then is missing."""
    at = bars * H
    prefix = facts.all_versions(settled(structure.prepared(rows, at)), 6, 3)
    got, want = shown(facts.as_of(known, [at])), shown(facts.as_of(prefix, [at]))
    assert got == want and len(want) > 100
    assert {w[1] for w in want} >= {"pivot", "event", "level", "liquidity", "gap", "displacement"}


def test_fifty_times_in_one_pass(known):
    times = [k * H for k in range(33, 231, 4)]
    got = facts.as_of(known, times).groupBy("as_of_ms").count().collect()
    assert len(got) == 50
    for r in got:
        alone = known.where((F.col("known_from_ms") <= r.as_of_ms) & F.expr(f"known_until_ms is null or known_until_ms > {r.as_of_ms}"))
        assert r["count"] == alone.count() if r.as_of_ms % (5 * H) == 0 else r["count"] > 0
    assert known.groupBy("symbol", "kind", "layer", "key", "known_from_ms").count().where("count > 1").isEmpty()


def test_documents(known, tmp_path):
    made = facts.documents(facts.as_of(known, [150 * H, 200 * H]))
    rows = made.collect()
    assert len(rows) == 4
    for r in rows:
        found = json.loads(r.document)
        assert set(found) == {"pivots", "events", "levels", "liquidity", "ranges", "gaps", "blocks", "displacements"}
        gap = found["gaps"][0]
        assert list(gap)[:4] == ["key", "layer", "state", "event_ms"] and gap["key"] == f"SMC1|FVG|1h|{gap['direction']}|{gap['event_ms']}"
        assert all(g[c] is None or g[c] <= r.as_of_ms for g in found["gaps"] for c in ("touched_ms", "filled_ms", "invalidated_ms"))
    facts.write_documents(made, str(tmp_path / "out"))
    assert sorted(r.value for r in made.sparkSession.read.text(str(tmp_path / "out")).collect()) == sorted(r.document for r in rows)


def test_fact_ids(spark):
    rows = [("FVG", "SMC1|FVG|1h|up|5"), ("FVG", "SMC1|OB|1h|up|5"), ("SWING_ORDER_BLOCK", "SMC1|OB|1h|up|swing|5"), ("INTERNAL_ORDER_BLOCK", None), ("OB_FVG_CONFLUENCE", "SMC1|FVG|1h|up|5"), ("OTHER", "x"), (None, "SMC1|FVG|")]
    got = spark.createDataFrame(rows, "code string, value string").select(facts.fact_ids(F.col("code"), F.col("value")).alias("ids")).collect()
    assert [r.ids for r in got] == [[rows[0][1]], [], [rows[2][1]], [], [], [], []]
