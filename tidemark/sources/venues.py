"""Tickers and candles of five venues from their raw answers.

An answer is a row (symbol, timeframe, fetched_ms, body) with the JSON text that a venue sent. What differs between
venues is stated in tables of places and names; what is done with them is the same: parse, join the listing with the
ticker, cast. A missing, unreadable or zero number counts as 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeframes import duration


@dataclass(frozen=True)
class Candles:
    """Where rows are in a body, how many milliseconds a time unit has, and the place of each column in a row."""

    rows: str
    unit: int
    time: int
    open: int
    high: int
    low: int
    close: int
    volume: int
    close_time: int | None = None


@dataclass(frozen=True)
class Tickers:
    """Names in the listing (rows, symbol, base, quote, conditions) and in the ticker (rows, symbol, numbers)."""

    listing: str
    symbol: str
    base: str | None
    quote: str | None
    conditions: tuple[str, ...]
    tickers: str
    ticker_symbol: str
    price: str
    volume: str
    quote_volume: str
    change: str
    change_factor: float = 1.0


# The venues' formats, in the order in which venues are listed.
CANDLES = {
    "BINANCE": Candles("$", 1, 0, 1, 2, 3, 4, 5, 6),
    "BYBIT": Candles("$.result.list", 1, 0, 1, 2, 3, 4, 5),
    "GATE": Candles("$", 1000, 0, 5, 3, 4, 2, 6),
    "KUCOIN": Candles("$.data", 1000, 0, 1, 3, 4, 2, 5),
    "BINGX": Candles("$.data", 1, 0, 1, 2, 3, 4, 5),
}
TICKERS = {
    "BINANCE": Tickers("$.symbols", "symbol", "baseAsset", "quoteAsset", ("status = 'TRADING'", "coalesce(isSpotTradingAllowed, 'true') <> 'false'"), "$", "symbol", "lastPrice", "volume", "quoteVolume", "priceChangePercent"),
    "BYBIT": Tickers("$.result.list", "symbol", "baseCoin", "quoteCoin", ("status = 'Trading'",), "$.result.list", "symbol", "lastPrice", "volume24h", "turnover24h", "price24hPcnt", 100.0),
    "GATE": Tickers("$", "id", "base", "quote", ("trade_status = 'tradable'",), "$", "currency_pair", "last", "base_volume", "quote_volume", "change_percentage"),
    "KUCOIN": Tickers("$.data", "symbol", "baseCurrency", "quoteCurrency", ("enableTrading = 'true'",), "$.data.ticker", "symbol", "last", "vol", "volValue", "changeRate", 100.0),
    "BINGX": Tickers("$.data.symbols", "symbol", None, None, ("cast(status as int) = 1", "coalesce(apiStateBuy, 'true') <> 'false'", "coalesce(apiStateSell, 'true') <> 'false'"), "$.data", "symbol", "lastPrice", "volume", "quoteVolume", "priceChangePercent"),
}
EXCHANGES = tuple(CANDLES)


def number(value: Column) -> Column:
    n = value.try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.0).otherwise(n)


def rows_at(body: Column, path: str, kind: str) -> Column:
    return F.from_json(body if path == "$" else F.get_json_object(body, path), kind)


def or_else(*values: Column) -> Column:
    """The first that is not 0."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values], F.lit(0.0))


def parse_candles(answers: DataFrame, exchange: str, limit: int | None = None) -> DataFrame:
    """Candles of a venue's answers; closed if over when fetched. A venue that gives no close time closes a millisecond
    before the next candle. Rows may also be objects with named fields. Unreadable closes and times are dropped."""
    spec = CANDLES[exchange]
    rows = answers.select("symbol", "timeframe", "fetched_ms", F.explode(rows_at(F.col("body"), spec.rows, "array<string>")).alias("row"))
    listed = F.from_json("row", "array<string>")
    named = F.from_json("row", "time string, openTime string, timestamp string, open string, high string, low string, close string, volume string")
    rows = rows.withColumn("a", F.when(F.col("row").startswith("["), listed)).withColumn("o", F.when(~F.col("row").startswith("["), named))
    at = lambda i: F.get("a", F.lit(i))
    time = F.coalesce(at(spec.time), "o.time", "o.openTime", "o.timestamp").try_cast("double")
    rows = rows.withColumn("open_ms", (time * spec.unit).cast("long"))
    for name in ("open", "high", "low", "close", "volume"):
        rows = rows.withColumn(name, F.coalesce(at(getattr(spec, name)), F.col(f"o.{name}")).try_cast("double"))
    close = (at(spec.close_time).try_cast("double")).cast("long") if spec.close_time else F.col("open_ms") + duration(F.col("timeframe")) - 1
    rows = rows.withColumn("close_ms", close).where("open_ms > 0 and close is not null and not isnan(close)")
    out = rows.select(F.lit(exchange).alias("exchange"), "symbol", "timeframe", "open_ms", "close_ms", "open", "high", "low", "close", "volume", (F.col("close_ms") < F.col("fetched_ms")).alias("closed"), F.col("fetched_ms").alias("seq"))
    if limit is None:
        return out
    from tidemark.operators.paging import newest_per_group

    return newest_per_group(out, ["symbol", "timeframe"], "open_ms", limit)


def parse_tickers(listing: DataFrame, tickers: DataFrame, exchange: str) -> DataFrame:
    """Tickers of tradable USDT pairs. listing, tickers: one answer (body) or several."""
    spec = TICKERS[exchange]
    fields = {spec.symbol, *(x for x in (spec.base, spec.quote) if x), "status", "isSpotTradingAllowed", "trade_status", "enableTrading", "apiStateBuy", "apiStateSell"}
    pairs = listing.select(F.explode(rows_at(F.col("body"), spec.listing, "array<struct<" + ", ".join(f"{f}: string" for f in sorted(fields)) + ">>")).alias("p")).select("p.*")
    for condition in spec.conditions:
        pairs = pairs.where(condition)
    quote = F.col(spec.quote) if spec.quote else F.when(F.col(spec.symbol).endswith("-USDT"), "USDT")
    base = F.col(spec.base) if spec.base else F.regexp_replace(spec.symbol, "-USDT$", "")
    pairs = pairs.select(F.col(spec.symbol).alias("symbol"), base.alias("base"), quote.alias("quote")).where("quote = 'USDT'")
    fields = {spec.ticker_symbol, spec.price, spec.volume, spec.quote_volume, spec.change, "last", "volume24h", "quoteVolume24h", "openPrice"}
    seen = tickers.select(F.explode(rows_at(F.col("body"), spec.tickers, "array<struct<" + ", ".join(f"{f}: string" for f in sorted(fields)) + ">>")).alias("t")).select("t.*")
    n = lambda name: number(F.col(name))
    price, volume, quote_volume, change = n(spec.price), n(spec.volume), n(spec.quote_volume), n(spec.change) * spec.change_factor
    if exchange == "KUCOIN":
        quote_volume = or_else(quote_volume, price * volume)
    if exchange == "BINGX":  # other names in older answers, and a change that may have to be worked out
        price, volume, opened = or_else(price, n("last")), or_else(volume, n("volume24h")), n("openPrice")
        quote_volume = or_else(quote_volume, n("quoteVolume24h"), price * volume)
        change = F.when((change == 0) & (opened > 0) & (price > 0), (price - opened) / opened * 100).otherwise(change)
    seen = seen.select(F.col(spec.ticker_symbol).alias("symbol"), price.alias("price"), volume.alias("volume"), quote_volume.alias("quote_volume"), change.alias("change"))
    return seen.join(pairs, "symbol").select(F.lit(exchange).alias("exchange"), "symbol", "base", "quote", "price", "volume", "quote_volume", "change", F.lit(True).alias("active"))
