"""Log lines made fit to be kept: one line, bounded, nothing that looks like a secret; the newest ones, in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What hints at a secret, in any case; what is shown instead; length of a line; entries kept.
SECRET = r"(?i)database_url|auth_secret|password|secret|token|cookie|authorization|bearer|api[_-]?key|private[_-]?key|ssh[_-]|ssh-rsa|ssh-ed25519|postgres(ql)?://|mysql://"
HIDDEN = "[запись скрыта: распознан потенциальный секрет]"
LONGEST, KEPT = 400, 500


def one_line(message: Column) -> Column:
    text = F.trim(F.regexp_replace(message, r"\s+", " "))
    return F.when(F.length(text) > LONGEST, F.concat(F.substring(text, 1, LONGEST - 1), F.lit("…"))).otherwise(text)


def safe(message: Column) -> Column:
    text = one_line(message)
    return F.when(text.rlike(SECRET), HIDDEN).otherwise(text)


def source_of(message: Column) -> Column:
    """The name in brackets that a line begins with, or app."""
    found = F.regexp_extract(message, r"^\[([^\]]{1,40})\]", 1)
    return F.when(found == "", "app").otherwise(found)


def journal(lines: DataFrame) -> DataFrame:
    """lines (seq, ts, level, message): the newest KEPT entries, masked."""
    text = safe(F.col("message"))
    return lines.orderBy(F.col("seq").desc()).limit(KEPT).select("seq", "ts", "level", source_of(text).alias("source"), text.alias("message"))


def journal_page(entries: DataFrame, level: str | None = None, source: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """A page of the entries that fit, newest first, with their total and the number of pages. A size that is not from 1
    to 100 is 50 below and 100 above; a page that is not there is the first."""
    out = entries if level is None else entries.where(F.col("level") == level)
    out = out if source is None else out.where(F.col("source") == source)
    size = 50 if size < 1 else min(size, 100)
    place = F.row_number().over(W.orderBy(F.col("seq").desc()))  # KEPT entries at most
    out = out.withColumn("place", place).withColumn("total", F.count("*").over(W.partitionBy())).withColumn("pages", F.ceil(F.col("total") / size))
    wanted = F.when((F.lit(page) >= 1) & (F.lit(page) <= F.col("pages")), page).otherwise(1)
    return out.withColumn("page", wanted).where(F.ceil(F.col("place") / size) == F.col("page")).drop("place")


def sources(entries: DataFrame) -> DataFrame:
    return entries.select("source").distinct()
