"""Venue formats, and the streaming table against the same rows in one batch."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import bridge, venues
from tidemark.streaming import ingest

T0, H = 1_700_002_800_000, 3_600_000


def answers(spark, body, fetched=T0 + 90 * 60_000):
    return spark.createDataFrame([("S", "1h", fetched, json.dumps(body))], "symbol string, timeframe string, fetched_ms long, body string")


@pytest.mark.parametrize(
    "venue, body",
    [
        ("BINANCE", [[T0 + i * H, "1", "4", "0.5", "2", "10", T0 + (i + 1) * H - 1] for i in range(2)]),
        ("BYBIT", {"result": {"list": [[str(T0 + i * H), "1", "4", "0.5", "2", "10", "9"] for i in (1, 0)]}}),
        ("GATE", [[str((T0 + i * H) // 1000), "9", "2", "4", "0.5", "1", "10"] for i in range(2)]),
        ("KUCOIN", {"data": [[str((T0 + i * H) // 1000), "1", "2", "4", "0.5", "10", "9"] for i in (1, 0)]}),
        ("BINGX", {"code": 0, "data": [[T0, 1, 4, 0.5, 2, 10], {"openTime": T0 + H, "open": "1", "high": "4", "low": "0.5", "close": "2", "volume": "10"}, [0, 1, 4, 0.5, 2, 10], [T0, 1, 4, 0.5, "x", 1]]}),
    ],
)
def test_candle_formats(spark, venue, body):
    got = venues.parse_candles(answers(spark, body), venue).orderBy("open_ms").collect()
    assert [(r.open_ms, r.open, r.high, r.low, r.close, r.volume, r.closed) for r in got] == [(T0, 1.0, 4.0, 0.5, 2.0, 10.0, True), (T0 + H, 1.0, 4.0, 0.5, 2.0, 10.0, False)]
    assert [r.close_ms for r in got] == [T0 + H - 1, T0 + 2 * H - 1]


def test_tickers(spark):
    body = lambda x: spark.createDataFrame([(json.dumps(x),)], "body string")
    listing = {"symbols": [{"symbol": "AUSDT", "baseAsset": "A", "quoteAsset": "USDT", "status": "TRADING"}, {"symbol": "BUSDT", "baseAsset": "B", "quoteAsset": "USDT", "status": "BREAK"}, {"symbol": "CBTC", "baseAsset": "C", "quoteAsset": "BTC", "status": "TRADING"}]}
    seen = [{"symbol": s, "lastPrice": "2", "volume": "x", "quoteVolume": "5", "priceChangePercent": "-1.5"} for s in ("AUSDT", "BUSDT", "CBTC")]
    got = venues.parse_tickers(body(listing), body(seen), "BINANCE").collect()
    assert [(r.symbol, r.base, r.price, r.volume, r.quote_volume, r.change) for r in got] == [("AUSDT", "A", 2.0, 0.0, 5.0, -1.5)]
    listing = {"data": {"symbols": [{"symbol": "A-USDT", "status": 1}, {"symbol": "B-USDT", "status": 1, "apiStateBuy": False}]}}
    seen = {"data": [{"symbol": s, "last": "110", "openPrice": "100", "quoteVolume24h": "7"} for s in ("A-USDT", "B-USDT")]}
    got = venues.parse_tickers(body(listing), body(seen), "BINGX").collect()
    assert [(r.base, r.price, round(r.change, 6), r.quote_volume) for r in got] == [("A", 110.0, 10.0, 7.0)]
    listing = {"data": [{"symbol": "A-USDT", "baseCurrency": "A", "quoteCurrency": "USDT", "enableTrading": True}]}
    got = venues.parse_tickers(body(listing), body({"data": {"ticker": [{"symbol": "A-USDT", "last": "3", "vol": "2", "volValue": "0", "changeRate": "0.01"}]}}), "KUCOIN").first()
    assert (got.quote_volume, got.change) == (6.0, 1.0)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("x", "A", "1h", T0 + i * H, 1.0, 4.0, 0.5, 2.0 + k, 1.0, k > 0, 10 * i + k) for i in range(30) for k in range(2)]
    kind = "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, closed boolean, seq long"
    source = tmp_path / "in"
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], kind).coalesce(1).write.mode("append").parquet(str(source))
    table = ingest.CandleTable(spark, str(tmp_path / "table"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = ingest.run(stream, table, str(tmp_path / "check"))
    query.awaitTermination(120)
    got = sorted((r.open_ms, r.close, r.closed) for r in table.read().collect())
    assert got == [(T0 + i * H, 3.0, True) for i in range(30)]


def test_trades_stream_equals_bridge(spark, tmp_path):
    events = bridge.read(spark, "/root/testdata/sf0.001", "events")
    trades = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", bridge.venue_of(F.col("event_type")).alias("exchange"), bridge.symbol_of(F.col("user_id")).alias("symbol"), "value")
    trades.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = ingest.candles_from_trades(spark.readStream.schema(trades.schema).parquet(str(tmp_path / "in")), "4h")
    query = out.writeStream.format("memory").queryName("candles_out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.exchange, r.symbol, r.open_ms): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("candles_out").collect()}
    want = {(r.exchange, r.symbol, r.open_ms): (r.open, r.high, r.low, r.close, r.volume) for r in bridge.candles_from_events(events, "4h").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 30


def test_cadence():
    ingest.check_cadence(["5m"], 300_000)
    ingest.check_cadence(["5m"], 600_000, once=True)
    with pytest.raises(ValueError):
        ingest.check_cadence(["1h", "5m"], 300_001)


def test_late_candles_are_not_taken(spark, tmp_path):
    kind = "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, closed boolean, seq long"
    batch = lambda *rows: spark.createDataFrame([("x", s, "1h", T0 + h * H, 1.0, 4.0, 0.5, c, 1.0, True, n) for n, (s, h, c) in enumerate(rows)], kind)
    table = ingest.CandleTable(spark, str(tmp_path / "table"))
    table.upsert(batch(("A", 0, 1.0), ("A", 120, 1.0)), 0)
    table.upsert(batch(("A", 3, 2.0), ("A", 48, 2.0), ("A", 120, 2.0), ("B", 3, 2.0)), 1)
    want = [("A", 0, 1.0), ("A", 120, 2.0), ("B", 3, 2.0)]
    stored = lambda: sorted((r.symbol, (r.open_ms - T0) // H, r.close) for r in table.read().collect())
    assert stored() == want
    table.upsert(batch(("A", 119, 3.0), ("B", 2, 3.0), ("B", 4, 3.0)), 2)
    assert stored() == [*want, ("B", 4, 3.0)]
    again = ingest.CandleTable(spark, str(tmp_path / "table"))
    again.upsert(batch(("A", 121, 3.0)), 3)
    assert ("A", 121, 3.0) in stored()


def test_markets_of_one_venue_stay_apart(spark):
    from tidemark.sources import upserts

    kind = "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, closed boolean"
    row = lambda s, c: ("x", s, "1h", T0, 1.0, 4.0, 0.5, c, 1.0, True)
    new = spark.createDataFrame([(*row("BTC", 2.0), 1), (*row("ETH", 3.0), 2)], kind + ", seq long")
    got = upserts.upsert_candles(spark.createDataFrame([row("BTC", 1.0)], kind), new).collect()
    assert sorted((r.symbol, r.close) for r in got) == [("BTC", 2.0), ("ETH", 3.0)]
