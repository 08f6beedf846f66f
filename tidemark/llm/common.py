"""Shared pieces: the folder that driver and executors share, written tables, and column guards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folder of a local application that names none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir or set as checkpoint folder. Where none is, a temporary one, but only
    if driver and executors are one machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = _own.setdefault(context.applicationId, _own.get(context.applicationId) or "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and outlives the executors that made it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the folder of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; extra ones, whatever they are called, cannot clash with an operator's own."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(df: DataFrame, name: str) -> str:
    """name, or with as many underscores more as no column of df is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows up to which a narrow table (ids, hashes, a short text) may be sent to every executor.
BROADCAST_ROWS = 500_000


def sent_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, counted now; beyond that Spark shuffles both sides.
    size: what a row counts for, where rows hold arrays; df is then counted whole."""
    if size is not None:
        return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= 8 * rows else df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its input has fewer splits than there are cores, which only small inputs have: a table
    of one row group would otherwise be one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def lower_ascii(text):
    """A-Z in lower case and nothing else. lower() does that where there are no other letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Texts of one Arrow batch: a few MB, where Spark's default of 10,000 rows takes tens of MB in the executor and again in each of its Python workers.
BATCH_TEXTS = 500


def map_texts(rows: DataFrame, run, schema: str) -> DataFrame:
    """rows.mapInArrow over small batches. Spark has only a session's setting for their size, and reads it when the
    plan runs, so it stays set; a session that has its own size keeps it."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_TEXTS))
    return rows.mapInArrow(run, schema)
