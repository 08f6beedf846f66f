"""Predicates on markets, assets, tickers and candles, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Base symbols that are not traded against.
EXCLUDED_BASES = (
    "USDT", "USDC", "FDUSD", "TUSD", "USDP", "DAI", "USDE", "USDS", "PYUSD", "RLUSD",
    "USD1", "USDG", "USDQ", "USDD", "GUSD", "LUSD", "FRAX", "EUR", "EURC", "EURI",
)


def active_market() -> Column:
    """Enabled, active, quoted in USDT, spot."""
    return listed_market() & (F.col("quote") == "USDT") & (F.col("market_type") == "SPOT")


def listed_market() -> Column:
    """Enabled and active, whatever the quote and type."""
    return F.col("enabled") & (F.col("status") == "ACTIVE")


def in_universe(rank: Column, size: int = 100) -> Column:
    """1 <= rank <= size; no rank is outside."""
    return F.coalesce(rank.between(1, size), F.lit(False))


def top_ranked(assets: DataFrame, n: int) -> DataFrame:
    """The first n enabled assets that have a rank of at most n."""
    return assets.where(F.col("enabled") & F.col("rank").isNotNull() & (F.col("rank") <= n)).orderBy(F.col("rank").asc_nulls_last(), "symbol").limit(n)


def finite(*names: str) -> Column:
    return reduce(Column.__and__, [F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) for n in names])


def sound_candle() -> Column:
    """Finite, the high at the top, the low at the bottom, no negative volume; no tolerance."""
    return (
        finite("open", "high", "low", "close", "volume")
        & (F.col("high") >= F.greatest("low", "open", "close"))
        & (F.col("low") <= F.least("open", "close"))
        & (F.col("volume") >= 0)
    )


def tolerant_candle(tolerance: float = 1e-9) -> Column:
    """Closed, with open and close between low and high but for a relative tolerance."""
    slack = F.greatest(F.abs("high"), F.abs("low"), F.lit(1.0)) * tolerance
    return (
        finite("open", "high", "low", "close") & F.col("closed")
        & (F.col("high") + slack >= F.greatest("low", "open", "close"))
        & (F.col("low") - slack <= F.least("open", "close"))
    )


def series_validity(candles: DataFrame) -> DataFrame:
    """Rows, closed and sound ones (with the tolerance), and repeated open times of each series: a table has no order of
    its own, so what is left of "strictly increasing" is that no time comes twice."""
    from tidemark.functions.indicators import SERIES

    return candles.groupBy(*SERIES).agg(F.count("*").alias("n"), F.count_if(tolerant_candle()).alias("sound"), (F.count("*") - F.count_distinct("open_ms")).alias("repeated"))


def series_refusals(rows: DataFrame, position: str = "position", tolerance: float = 1e-9) -> DataFrame:
    """(series, position, reason) of the first row of each series, in the order of `position`, that a strict reader refuses:
    unknown timeframe, no time, not closed, a number that is none, a high or low that does not hold, the time of the row before again, or
    an earlier one. A row a refused series; none if all may be evaluated."""
    from tidemark.functions.indicators import SERIES
    from tidemark.functions.timeframes import DURATION_MS

    before = F.lag("open_ms").over(W.partitionBy(*SERIES).orderBy(position))
    holds = (F.col("high") >= F.greatest("open", "close") - tolerance) & (F.col("low") <= F.least("open", "close") + tolerance) & (F.col("high") >= F.col("low") - tolerance)
    reason = (
        F.when(~F.coalesce(F.col("timeframe").isin(*DURATION_MS), F.lit(False)), "timeframe").when(F.col("open_ms").isNull(), "time").when(~F.coalesce("closed", F.lit(False)), "open")
        .when(~finite("open", "high", "low", "close"), "number").when(~holds, "prices").when(F.col("open_ms") == before, "repeated").when(F.col("open_ms") < before, "order")
    )
    found = rows.withColumn("reason", reason).where("reason is not null")
    return found.groupBy(*SERIES).agg(F.min(F.struct(F.col(position).alias("position"), "reason")).alias("first")).select(*SERIES, "first.*")


def checked_series(rows: DataFrame, position: str = "position") -> DataFrame:
    """rows, if no series is refused."""
    first = series_refusals(rows, position).first()
    if first:
        raise ValueError(f"{first.exchange} {first.symbol} {first.timeframe}: row {first.position}: {first.reason}")
    return rows


def allowed_base(base: Column) -> Column:
    """2 to 20 capital letters or digits, and not an excluded one."""
    return ~base.isin(*EXCLUDED_BASES) & base.rlike("^[A-Z0-9]{2,20}$")


def live_ticker() -> Column:
    return F.col("active") & (F.col("price") > 0) & (F.col("quote_volume") > 0) & allowed_base(F.col("base"))


def filter_reason(top_only: bool, minimum_volume: float) -> Column:
    """Why a market is left out of a strategy, or null: rank outside the universe, or too little volume (none is 0)."""
    outside = F.lit(top_only) & ~in_universe(F.col("rank"))
    thin = F.coalesce("quote_volume", F.lit(0.0)) < minimum_volume
    return F.when(outside, "universe").when(thin, "volume")


def eligible_exchange(exchange: Column, timeframe: Column, exchanges: tuple[str, ...], off_grid: tuple[tuple[str, str], ...] = ()) -> Column:
    """Known venue, known timeframe, and not one of the pairs whose candles are off the grid."""
    from tidemark.functions.timeframes import DURATION_MS

    out = exchange.isin(*exchanges) & timeframe.isin(*DURATION_MS)
    for e, t in off_grid:
        out &= ~((exchange == e) & (timeframe == t))
    return F.coalesce(out, F.lit(False))


def search_assets(assets: DataFrame, query: str, n: int = 8) -> DataFrame:
    """Enabled assets whose symbol begins with the query, or whose name holds it, in upper case; best ranks first."""
    q = query.strip().upper()
    return assets.where(F.col("enabled") & (F.col("symbol").startswith(q) | F.col("name").contains(q))).orderBy(F.col("rank").asc_nulls_last(), "symbol").limit(n)


def search_markets(markets: DataFrame, exchange: str | None = None, text: str = "", known: tuple[str, ...] = ()) -> DataFrame:
    """Markets of a known exchange whose symbol holds the first 32 characters of text."""
    out = markets.where(F.col("exchange") == exchange) if exchange and exchange in known else markets
    return out.where(F.col("symbol").contains(text.strip()[:32].upper())) if text.strip() else out


def filter_table(rows: DataFrame, text: str = "", side: str = "all") -> DataFrame:
    """Name or symbol holds text in any case; up: change >= 0, down: change < 0, no change is 0."""
    t, change = text.strip().lower(), F.coalesce("change", F.lit(0.0))
    out = rows.where(F.lower("base").contains(t) | F.lower("symbol").contains(t)) if t else rows
    return out.where(change >= 0) if side == "up" else out.where(change < 0) if side == "down" else out
