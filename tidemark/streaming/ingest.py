"""Continuous ingestion: raw answers or trades in, upserted candles out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.indicators import SERIES
from tidemark.functions.timeframes import DURATION_MS
from tidemark.sources.upserts import latest_wins
from tidemark.operators.predicates import sound_candle

KEY = [*SERIES, "open_ms"]
PARTITION = ["timeframe", "day"]


def check_cadence(timeframes: list[str], interval_ms: int, once: bool = False) -> None:
    """A continuous run that holds the 5-minute candle must come round within it."""
    if not once and "5m" in timeframes and interval_ms > DURATION_MS["5m"]:
        raise ValueError("the interval is longer than the shortest candle")


class CandleTable:
    """A folder of candles partitioned by timeframe and day. A batch rewrites only the partitions that it touches, by
    way of a staging folder, and may be run again: of the answers for a key the last one wins (by `seq`, which stays in
    the table), whatever batch it comes in.

    What a batch gives is taken or set aside: `aside()` has the rows that were not taken and why, `runs()` the numbers of
    each batch and series. Both are folders by batch, overwritten if the batch runs again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def aside(self) -> DataFrame:
        """Rows not taken: reason is unsound, late (older than the newest stored candle of the series) or repeated (the
        same row again, within the watermark or within its batch)."""
        return self.spark.read.parquet(f"{self.path}__aside")

    def runs(self) -> DataFrame:
        """Per batch and series: given, skipped (unsound), late, repeated, written and created rows, and the rows of the
        series in the partitions touched before and after (which is what created is the difference of)."""
        return self.spark.read.parquet(f"{self.path}__runs")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _newest(self) -> DataFrame | None:
        """The newest stored time of each series: the last whole version of a small table, or else from all candles."""
        folder = f"{self.path}__newest"
        if self._exists(folder):
            fs, root = self._folder(folder)
            whole = [int(n) for s in fs.listStatus(root) if (n := s.getPath().getName()).isdigit() and self._exists(f"{folder}/{n}/_SUCCESS")]
            if whole:
                return self.spark.read.parquet(f"{folder}/{max(whole)}")
        return self.read().groupBy(*SERIES).agg(F.max("open_ms").alias("newest_ms")) if self._exists(self.path) else None

    def _folder(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _drop(self, path: str) -> None:
        fs, p = self._folder(path)
        fs.delete(p, True)

    def upsert(self, batch: DataFrame, batch_id: int = 0) -> None:
        """Takes a batch. A candle older than the newest stored one of its series is late and not taken."""
        day = F.floor(F.col("open_ms") / DURATION_MS["1d"]).cast("int")
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.lit(0).cast("long"))
        batch = batch.withColumn("seq", F.col("seq").cast("long")).withColumn("day", day)
        columns = batch.columns
        newest = self._newest()
        if newest is None:
            batch = batch.withColumn("_last", F.lit(None).cast("long"))
        else:
            batch = batch.join(newest.withColumnRenamed("newest_ms", "_last"), SERIES, "left")
        reason = F.when(~F.coalesce(sound_candle(), F.lit(False)), "unsound").when(F.col("open_ms") < F.col("_last"), "late")
        nth = F.row_number().over(W.partitionBy(*KEY, "reason").orderBy(F.col("seq").desc()))
        marked = batch.withColumn("reason", reason).drop("_last").withColumn("nth", nth)
        marked = marked.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("nth") > 1), "repeated").otherwise(F.col("reason"))).drop("nth")
        staging = f"{self.path}__staging/{batch_id}"
        marked.write.mode("overwrite").parquet(f"{staging}/given")
        given = self.spark.read.parquet(f"{staging}/given")
        given.where("reason is not null").write.mode("overwrite").parquet(f"{self.path}__aside/batch={batch_id}")
        taken = given.where("reason is null").select(*columns)
        if self._exists(self.path):
            touched = taken.select(*PARTITION).distinct()
            stored = self.read().select(*columns).join(F.broadcast(touched), PARTITION, "left_semi").select(*columns)  # a row for each day of a batch
        else:
            stored = taken.limit(0)
        latest_wins(stored, taken, KEY).write.mode("overwrite").parquet(f"{staging}/merged")
        merged = self.spark.read.parquet(f"{staging}/merged")
        self._note(given, stored, merged, batch_id)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(self.path)
        # After the candles: a batch that is run again finds its own candles still in time.
        times = taken.select(*SERIES, F.col("open_ms").alias("newest_ms"))
        times = times if newest is None else times.unionByName(newest)
        version = f"{self.path}__newest/{self._version() + 1}"
        times.groupBy(*SERIES).agg(F.max("newest_ms").alias("newest_ms")).write.mode("overwrite").parquet(version)
        fs, root = self._folder(f"{self.path}__newest")
        for s in fs.listStatus(root):
            if s.getPath().getName().isdigit() and int(s.getPath().getName()) < self._version() - 1:
                fs.delete(s.getPath(), True)
        self._drop(staging)

    def _note(self, given: DataFrame, stored: DataFrame, merged: DataFrame, batch_id: int) -> None:
        """The numbers of a batch, before the table changes. A batch that died after that and runs again notes what it
        adds then; the folder keeps the larger number of created rows."""
        n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
        of = lambda r: n(F.col("reason") == r)
        rows = given.groupBy(*SERIES).agg(F.count("*").alias("given"), of("unsound").alias("skipped"), of("late").alias("late"), of("repeated").alias("repeated"), n(F.col("reason").isNull()).alias("written"))
        before = stored.groupBy(*SERIES).agg(F.count("*").alias("before"))
        after = merged.groupBy(*SERIES).agg(F.count("*").alias("after"))
        rows = rows.join(before, SERIES, "left").join(after, SERIES, "left").na.fill(0, ["before", "after"])
        created = F.greatest(F.least(F.col("after") - F.col("before"), F.col("written")), F.lit(0))
        folder = f"{self.path}__runs/batch={batch_id}"
        rows = rows.withColumn("created", created)
        if self._exists(f"{folder}/_SUCCESS"):
            known = self.spark.read.parquet(folder).select(*SERIES, F.col("created").alias("_known"))
            rows = rows.join(known, SERIES, "left").withColumn("created", F.greatest("created", F.coalesce("_known", F.lit(0)))).drop("_known")
            rows = self.spark.createDataFrame(rows.collect(), rows.schema)  # a row a series: it is read from where it is written
        rows.write.mode("overwrite").parquet(folder)

    def _version(self) -> int:
        fs, root = self._folder(f"{self.path}__newest")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return max((int(n) for n in names if n.isdigit()), default=-1)


def run_stats(runs: DataFrame) -> DataFrame:
    """Written, skipped and created candles of runs in all, by exchange and by timeframe."""
    sums = [F.sum(c).alias(c) for c in ("given", "written", "skipped", "late", "repeated", "created")]
    return runs.groupingSets([[], [F.col("exchange")], [F.col("timeframe")]], "exchange", "timeframe").agg(F.count_distinct("exchange", "symbol").alias("markets"), *sums)


def watched(stream: DataFrame, name: str = "candles") -> DataFrame:
    """The stream with metrics that Spark reports with each batch's progress (query.lastProgress, listeners): given,
    sound and the newest open time."""
    return stream.observe(name, F.count("*").alias("given"), F.count_if(sound_candle()).alias("sound"), F.max("open_ms").alias("newest_ms"))


def without_repeats(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A stream without rows that came before with the same series, time and answer, as far back as the watermark
    remembers; sources that send at least once send some rows twice."""
    at = stream.withColumn("_at", F.timestamp_millis(F.col("seq"))).withWatermark("_at", lateness)
    return at.dropDuplicatesWithinWatermark([*KEY, "seq"]).drop("_at")


def run_answers(stream: DataFrame, table: CandleTable, checkpoint: str, once: bool = True, interval: str = "120 seconds"):
    """Takes a stream of venues' answers (sources.connector) into a table."""
    from tidemark.sources.connector import parse_answers

    writer = stream.writeStream.foreachBatch(lambda batch, n: table.upsert(parse_answers(batch), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def run(stream: DataFrame, table: CandleTable, checkpoint: str, once: bool = True, interval: str = "120 seconds"):
    """Upserts a stream of candles (with seq) into a table. One writer at a time: the checkpoint is its lock."""
    writer = stream.writeStream.foreachBatch(table.upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def candles_from_trades(trades: DataFrame, timeframe: str, lateness: str = "10 minutes") -> DataFrame:
    """Candles of a stream of trades (ts timestamp, event_id, exchange, symbol, value). The watermark only bounds the state: a
    candle is given out once no trade in time can change it."""
    width = DURATION_MS[timeframe]
    order = F.struct("ts", "event_id")
    out = trades.withWatermark("ts", lateness).groupBy("exchange", "symbol", F.window("ts", f"{width // 1000} seconds").alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return out.select("exchange", "symbol", F.lit(timeframe).alias("timeframe"), F.unix_millis(F.col("w.start")).alias("open_ms"), "open", "high", "low", "close", "volume")
