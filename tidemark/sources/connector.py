"""Venues as a Spark data source: answers of a venue, one partition a series, in a batch or as a stream.

    spark.dataSource.register(VenueAnswers)
    spark.readStream.format("venue_answers").option("path", ...).load()

What speaks to a venue is a transport (option `transport`, "module:Class"), which lists series, lists the times of a series'
answers and fetches one; the one here reads recorded answers. A row is an answer as it was sent; `venues.parse_candles`
and `parse_tickers` read it. Fetches are tried `attempts` times, with waits that double from `base_delay_ms` on.

A stream's offset has, for each series, the time of the last answer and the newest open time in it. A batch is the
answers between two offsets, so a batch that is run again has the same rows; the table's cut by newest open time lets
the open candle through again and nothing older.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from importlib import import_module
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.functions.indicators import SERIES
from tidemark.sources.venues import CANDLES, EXCHANGES, parse_candles

SCHEMA = "exchange string, symbol string, timeframe string, fetched_ms long, body string"
ATTEMPTS, BASE_DELAY_MS = 3, 500


def with_retry(fetch: Callable[[], str], attempts: int = ATTEMPTS, base_delay_ms: float = BASE_DELAY_MS) -> str:
    """What fetch returns; after each failure but the last it waits base_delay_ms, then twice as long each time."""
    for k in range(attempts):
        try:
            return fetch()
        except Exception:
            if k + 1 >= attempts:
                raise
            time.sleep(base_delay_ms * 2**k / 1000)
    raise ValueError("no attempts")


class RecordedAnswers:
    """Answers in a folder, as `record` writes them: exchange=, symbol=, timeframe=, fetched_ms=. Listings and tickers
    have the symbol `*` and their kind for a timeframe."""

    def __init__(self, options: dict):
        import pyarrow.fs as pafs

        uri = options["path"]
        self.fs, self.root = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")

    def _under(self, folder: str, name: str) -> list[str]:
        import pyarrow.fs as pafs

        found = self.fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type == pafs.FileType.Directory and f.base_name.startswith(f"{name}="))

    def series(self) -> list[tuple[str, str, str]]:
        """(exchange, symbol, timeframe), in order of venues."""
        found = []
        for e in self._under(self.root, "exchange"):
            for s in self._under(f"{self.root}/{e}", "symbol"):
                found += [tuple(unquote(x.partition("=")[2]) for x in (e, s, t)) for t in self._under(f"{self.root}/{e}/{s}", "timeframe")]
        return sorted(found, key=lambda x: (EXCHANGES.index(x[0]) if x[0] in EXCHANGES else len(EXCHANGES), x))

    def _folder(self, series: tuple[str, ...]) -> str:
        """Folder names are escaped as their writer does; they are found by what they stand for."""
        folder = self.root
        for name, value in zip(SERIES, series):
            folder += "/" + next(x for x in self._under(folder, name) if unquote(x.partition("=")[2]) == value)
        return folder

    def times(self, series: tuple[str, ...]) -> list[int]:
        return sorted(int(x.partition("=")[2]) for x in self._under(self._folder(series), "fetched_ms"))

    def fetch(self, series: tuple[str, ...], fetched_ms: int) -> str:
        import pyarrow.fs as pafs

        folder = f"{self._folder(series)}/fetched_ms={fetched_ms}"
        files = [f.path for f in self.fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and not f.base_name.startswith(("_", "."))]
        body = b""
        for path in sorted(files):
            with self.fs.open_input_file(path) as f:
                body += f.read()
        return body.decode().rstrip("\n")


def transport_of(options: dict):
    module, _, name = options.get("transport", f"{__name__}:RecordedAnswers").partition(":")
    return getattr(import_module(module), name)(options)


def newest_open_ms(exchange: str, body: str) -> int:
    """The newest open time among an answer's candles; -1 if there is none."""
    spec, found = CANDLES[exchange], json.loads(body)
    for name in spec.rows.split(".")[1:]:
        found = found.get(name) if isinstance(found, dict) else None
    times = [-1]
    for row in found or []:
        value = row[spec.time] if isinstance(row, list) else next((row[k] for k in ("time", "openTime", "timestamp") if row.get(k) is not None), None)
        try:
            times.append(int(float(value) * spec.unit))
        except (TypeError, ValueError):
            continue
    return max(times)


class Answers(InputPartition):
    """Answers of one series; from_ms: the newest open time known before them."""

    def __init__(self, series: tuple[str, ...], times: list[int], from_ms: int = -1):
        super().__init__((series, times, from_ms))


class Reading:
    """What batch and stream readers share. Options come as text."""

    def __init__(self, options: dict):
        self.options = options
        self.attempts, self.delay = int(options.get("attempts", ATTEMPTS)), float(options.get("base_delay_ms", BASE_DELAY_MS))

    def wanted(self) -> list[tuple[str, str, str]]:
        """Series by the options exchange, symbol and timeframe, each of which may name several."""
        named = {n: {x.strip() for x in self.options[n].split(",")} for n in SERIES if n in self.options}
        unknown = named.get("exchange", set()) - set(EXCHANGES)
        if unknown:
            raise ValueError(f"unknown exchanges: {sorted(unknown)}")
        found = transport_of(self.options).series()
        return [s for s in found if all(v in named[n] for n, v in zip(SERIES, s) if n in named) and (s[1] != "*" or named.get("symbol") == {"*"})]

    def get(self, transport, series: tuple[str, ...], at: int) -> str:
        return with_retry(lambda: transport.fetch(series, at), self.attempts, self.delay)

    def read(self, partition: Answers) -> Iterator[tuple]:
        series, times, _ = partition.value
        transport = transport_of(self.options)
        for at in times:
            yield (*series, at, self.get(transport, series, at))


class BatchReader(Reading, DataSourceReader):
    """The newest answer of each series."""

    def partitions(self) -> list[Answers]:
        transport = transport_of(self.options)
        return [Answers(s, transport.times(s)[-1:]) for s in self.wanted()]


class StreamReader(Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """{series as JSON: [time of the last answer, newest open time in it]}"""
        transport, out = transport_of(self.options), {}
        for s in self.wanted():
            if times := transport.times(s):
                out[json.dumps(s)] = [times[-1], newest_open_ms(s[0], self.get(transport, s, times[-1]))]
        return out

    def partitions(self, start: dict, end: dict) -> list[Answers]:
        transport, out = transport_of(self.options), []
        for name, (until, _) in sorted(end.items()):
            since, newest = start.get(name, [-1, -1])
            series = tuple(json.loads(name))
            if times := [t for t in transport.times(series) if since < t <= until]:
                out.append(Answers(series, times, newest))
        return out

    def commit(self, end: dict) -> None:
        return None


class VenueAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "venue_answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VenueAnswers)


def parse_answers(answers: DataFrame, limit: int | None = None) -> DataFrame:
    """Candles of the answers of all venues."""
    out = None
    for e in EXCHANGES:
        own = parse_candles(answers.where(F.col("exchange") == e).drop("exchange"), e, limit)
        out = own if out is None else out.unionByName(own)
    return out


def body_of(exchange: str) -> F.Column:
    """A series' candles (`rows`: structs of open_ms, open, high, low, close, volume) as the venue would send them."""
    spec = CANDLES[exchange]
    places = {spec.time: "time", spec.open: "open", spec.high: "high", spec.low: "low", spec.close: "close", spec.volume: "volume"}

    def row(x):
        text = lambda i: (x["open_ms"] / spec.unit).cast("long").cast("string") if places.get(i) == "time" else x[places[i]].cast("string") if i in places else F.lit("0")
        width = max([*places, spec.close_time or 0]) + 1
        closes = {spec.close_time: x["close_ms"].cast("string")} if spec.close_time else {}
        return F.array(*[closes.get(i, text(i)) for i in range(width)])

    body = F.transform("rows", row)
    for name in reversed(spec.rows.split(".")[1:]):
        body = F.struct(body.alias(name))
    return F.to_json(body)


def record(candles: DataFrame, path: str) -> None:
    """Writes candles (with close_ms and fetched_ms) of known venues as one answer a series and fetch."""
    rows = candles.groupBy(*SERIES, "fetched_ms").agg(F.array_sort(F.collect_list(F.struct("open_ms", "open", "high", "low", "close", "volume", "close_ms"))).alias("rows"))
    body = None
    for e in EXCHANGES:
        body = F.when(F.col("exchange") == e, body_of(e)) if body is None else body.when(F.col("exchange") == e, body_of(e))
    rows.select(*SERIES, "fetched_ms", body.alias("value")).where("value is not null").write.mode("append").partitionBy(*SERIES, "fetched_ms").text(path)
