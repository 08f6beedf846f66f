"""The venues' data source: formats, retries, batch, and a stream that is stopped and restarted."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import connector
from tidemark.streaming import ingest

T0, H = 1_700_002_800_000, 3_600_000
CANDLE = "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, close_ms long, fetched_ms long"


class Flaky(connector.RecordedAnswers):
    """Fails the first two fetches of each answer; counts in files, as tasks are processes of their own."""

    def __init__(self, options):
        super().__init__(options)
        self.folder = options["counts"]

    def fetch(self, series, fetched_ms):
        name = os.path.join(self.folder, f"{'-'.join(series)}-{fetched_ms}")
        n = len(open(name).read()) if os.path.exists(name) else 0
        with open(name, "a") as f:
            f.write("x")
        if n < 2:
            raise OSError("busy")
        return super().fetch(series, fetched_ms)


@pytest.fixture(scope="module")
def source(spark):
    connector.register(spark)
    return spark


def answers(spark, path, fetch, hours, symbols=("A#1-USDT", "B"), price=1.0):
    """One answer a series at time T0 + fetch: the newest candle is still open then."""
    fetched = T0 + fetch * H - H // 2
    rows = [(e, s, "1h", T0 + h * H, price, price + 3, price - 0.5, price + k, 10.0, T0 + (h + 1) * H - 1, fetched) for e in ("BINANCE", "GATE", "KUCOIN", "BYBIT", "BINGX") for k, s in enumerate(symbols) for h in hours]
    connector.record(spark.createDataFrame(rows, CANDLE), path)


def test_retry():
    waits, calls = [], []
    connector.time.sleep, kept = waits.append, connector.time.sleep
    try:
        def fetch():
            calls.append(1)
            if len(calls) < 3:
                raise OSError("busy")
            return "ok"

        assert connector.with_retry(fetch) == "ok" and waits == [0.5, 1.0]
        with pytest.raises(OSError):
            connector.with_retry(lambda: open("/nowhere"), attempts=2, base_delay_ms=1)
        assert waits == [0.5, 1.0, 0.001]
    finally:
        connector.time.sleep = kept


def test_batch(source, tmp_path):
    path = str(tmp_path / "answers")
    answers(source, path, 3, [0, 1, 2])
    answers(source, path, 4, [1, 2, 3])
    read = source.read.format("venue_answers").option("path", path)
    rows = read.load().collect()
    assert len(rows) == 10 and {r.fetched_ms for r in rows} == {T0 + 4 * H - H // 2}
    got = connector.parse_answers(read.load())
    assert got.count() == 30 and got.where("closed").count() == 20
    assert {r.symbol for r in got.select("symbol").distinct().collect()} == {"A#1-USDT", "B"}
    assert {tuple(r) for r in got.select("open", "high", "low", "close", "volume").where("symbol = 'B'").distinct().collect()} == {(1.0, 4.0, 0.5, 2.0, 10.0)}
    assert connector.parse_answers(read.load(), limit=1).count() == 10
    some = read.option("exchange", "GATE, BYBIT").option("symbol", "B").load()
    assert {(r.exchange, r.symbol) for r in some.collect()} == {("GATE", "B"), ("BYBIT", "B")}
    with pytest.raises(Exception, match="unknown exchanges"):
        read.option("exchange", "NOWHERE").load().collect()


def test_unreadable_answers(source, tmp_path):
    """A body without candles has no newest time and no rows, and stops nothing."""
    assert connector.newest_open_ms("BYBIT", '{"retCode": 1}') == -1
    assert connector.newest_open_ms("BINGX", json.dumps({"data": [{"openTime": T0}, ["x"], [T0 + H]]})) == T0 + H
    assert connector.newest_open_ms("GATE", "[]") == -1


def test_retries_in_tasks(source, tmp_path):
    path, counts = str(tmp_path / "answers"), tmp_path / "counts"
    counts.mkdir()
    answers(source, path, 2, [0, 1], symbols=("A",))
    read = source.read.format("venue_answers").options(path=path, counts=str(counts), transport=f"{__name__}:Flaky", base_delay_ms=1)
    assert read.load().count() == 5
    assert all(len(f.read_text()) >= 3 for f in counts.iterdir())
    with pytest.raises(Exception, match="busy"):
        for f in counts.iterdir():
            f.unlink()
        read.option("attempts", 1).load().collect()


def test_a_stream_that_is_restarted(source, tmp_path):
    """Answers come in three rounds, the query is stopped between them and dies once after the table was written;
    nothing is lost or taken twice, and the open candle is rewritten."""
    path, check = str(tmp_path / "answers"), str(tmp_path / "check")
    table = ingest.CandleTable(source, str(tmp_path / "table"))
    stream = lambda: source.readStream.format("venue_answers").option("path", path).load()
    answers(source, path, 3, [0, 1, 2])
    ingest.run_answers(stream(), table, check).awaitTermination(180)
    answers(source, path, 5, [2, 3, 4], price=2.0)
    answers(source, path, 6, [3, 4, 5], price=3.0)

    class Dies(ingest.CandleTable):
        def upsert(self, batch, batch_id=0):
            super().upsert(batch, batch_id)
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        ingest.run_answers(stream(), Dies(source, table.path), check).awaitTermination(180)
    ingest.run_answers(stream(), table, check).awaitTermination(180)
    ingest.run_answers(stream(), table, check).awaitTermination(180)  # nothing new
    got = table.read().collect()
    want = {0: 1.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: 3.0, 5: 3.0}
    assert len(got) == 10 * 6
    assert all(r.open == want[(r.open_ms - T0) // H] and r.closed == (r.open_ms < T0 + 5 * H) for r in got)
    total = ingest.run_stats(table.runs()).where("exchange is null and timeframe is null").first()
    assert (total.given, total.written + total.skipped + total.late + total.repeated, total.created, total.markets) == (90, 90, 60, 10)
    assert not os.path.exists(f"{table.path}__staging") or not os.listdir(f"{table.path}__staging")


def test_taken_and_set_aside_are_all(source, tmp_path):
    kind = "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, closed boolean, seq long"
    row = lambda h, c, seq, s="A": ("x", s, "1h", T0 + h * H, 1.0, 4.0, 0.5, c, 1.0, True, seq)
    table = ingest.CandleTable(source, str(tmp_path / "table"))
    table.upsert(source.createDataFrame([row(0, 1.0, 1), row(5, 1.0, 5), row(5, 2.0, 7), row(5, 9.0, 8)], kind), 0)  # a close above the high
    table.upsert(source.createDataFrame([row(3, 1.0, 9), row(5, 3.0, 6), row(6, 3.0, 9), row(0, 1.0, 1, "B")], kind), 1)
    got = {(r.symbol, (r.open_ms - T0) // H): r.close for r in table.read().collect()}
    assert got == {("A", 0): 1.0, ("A", 5): 2.0, ("A", 6): 3.0, ("B", 0): 1.0}  # the older answer of hour 5 comes too late
    aside = sorted((r.batch, r.reason, (r.open_ms - T0) // H) for r in table.aside().collect())
    assert aside == [(0, "repeated", 5), (0, "unsound", 5), (1, "late", 3)]
    runs = {(r.batch, r.symbol): (r.given, r.skipped, r.late, r.repeated, r.written, r.created) for r in table.runs().collect()}
    assert runs == {(0, "A"): (4, 1, 0, 1, 2, 2), (1, "A"): (3, 0, 1, 0, 2, 1), (1, "B"): (1, 0, 0, 0, 1, 1)}


def test_repeats_and_metrics_of_a_stream(source, tmp_path):
    kind = "exchange string, symbol string, timeframe string, open_ms long, open double, high double, low double, close double, volume double, closed boolean, seq long"
    row = lambda h, c=2.0: ("x", "A", "1h", T0 + h * H, 1.0, 4.0, 0.5, c, 1.0, True, T0 + h * H)
    folder = str(tmp_path / "in")
    for n, rows in enumerate([[row(0), row(1)], [row(1), row(2, 9.0)], [row(2, 9.0), row(3)]]):
        source.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
    stream = source.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)
    taken = []
    query = ingest.watched(ingest.without_repeats(stream, "2 hours")).writeStream.foreachBatch(lambda b, n: taken.extend((r.open_ms - T0) // H for r in b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert sorted(taken) == [0, 1, 2, 3]
    seen = [p.observedMetrics["candles"] for p in query.recentProgress if "candles" in p.observedMetrics]
    assert sum(m.given for m in seen) == 4 and sum(m.sound for m in seen) == 3
