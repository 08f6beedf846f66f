"""Timeframes, instants on their grid, and the freshness of candles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The timeframes and their lengths in milliseconds.
DURATION_MS = {"5m": 300_000, "15m": 900_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}


def duration(timeframe: Column) -> Column:
    """Length of a timeframe column's value; null for unknown ones."""
    out = F.lit(None).cast("long")
    for name, ms in DURATION_MS.items():
        out = F.when(timeframe == name, F.lit(ms)).otherwise(out)
    return out


def on_grid(open_ms: Column, width: Column | int) -> Column:
    return F.pmod(open_ms, F.lit(width) if isinstance(width, int) else width) == 0


def expected_latest_closed(now_ms: Column, width: int) -> Column:
    """Open time of the newest candle that is over at now_ms."""
    return (F.floor(now_ms / width) * width - width).cast("long")


def bar_count(ms: Column, width: int) -> Column:
    """Bars in a span, halves rounded up."""
    return F.floor(ms / width + 0.5).cast("long")


def freshness(open_ms: Column, now_ms: Column, width: int) -> Column:
    """fresh up to two lengths of age, delayed up to six, then stale; missing without a candle; the future is fresh."""
    age = F.greatest(now_ms - open_ms, F.lit(0))
    return F.when(open_ms.isNull(), "missing").when(age <= 2 * width, "fresh").when(age <= 6 * width, "delayed").otherwise("stale")
