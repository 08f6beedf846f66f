"""The queries in SQL, for an engine that did not run them."""

from __future__ import annotations

from tidemark.functions.timeframes import DURATION_MS


VENUE = "CASE event_type WHEN 'click' THEN 'AFRICA' WHEN 'error' THEN 'AMERICA' WHEN 'purchase' THEN 'ASIA' WHEN 'signup' THEN 'EUROPE' ELSE 'MIDDLE EAST' END"
SYMBOL = "CASE WHEN user_id % 10 < 5 THEN 'Brand#11-USDT' WHEN user_id % 10 < 8 THEN 'Brand#12-USDT' ELSE 'Brand#13-USDT' END"


def candles(timeframe: str) -> str:
    w = DURATION_MS[timeframe]
    return f"""SELECT {VENUE} AS exchange, {SYMBOL} AS symbol, '{timeframe}' AS timeframe, ((epoch_us(ts) // 1000) // {w}) * {w} AS open_ms,
      first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
      count(*)::DOUBLE AS volume, ((epoch_us(ts) // 1000) // {w}) * {w} + {w} <= (SELECT max((epoch_us(ts) // 1000)) FROM events) AS closed
      FROM events GROUP BY {VENUE}, {SYMBOL}, ((epoch_us(ts) // 1000) // {w}) * {w}"""


ALL = "c AS (" + " UNION ALL ".join(candles(t) for t in ("15m", "1h", "4h", "1d")) + ")"
HOURLY = f"c AS ({candles('1h')})"
MARKETS = """m AS (SELECT r_name AS exchange, p_brand AS base, 'USDT' AS quote, p_brand || '-USDT' AS symbol,
  CASE WHEN count(*) % 13 = 0 THEN 'FUTURES' ELSE 'SPOT' END AS market_type, CASE WHEN count(*) % 11 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status,
  count(*) % 7 <> 0 AS enabled, CASE WHEN count(*) % 11 = 5 THEN NULL ELSE sum(l_extendedprice * (1 - l_discount)) END AS quote_volume,
  sum(l_quantity) AS volume, count(*) AS trades, (count(*) % 11 - 5)::DOUBLE AS change
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, p_brand)"""
ACTIVE = "enabled AND status = 'ACTIVE' AND quote = 'USDT' AND market_type = 'SPOT'"
ASSETS = """v AS (SELECT base AS symbol, coalesce(sum(CASE WHEN quote_volume > 0 THEN quote_volume END), 0) AS total,
  coalesce(max(CASE WHEN quote_volume > 0 THEN quote_volume END), 0) AS highest, count(CASE WHEN quote_volume > 0 THEN 1 END) AS markets FROM m GROUP BY base),
  s AS (SELECT *, (0.7 * highest + 0.3 * greatest(total - highest, 0)) * (1 + 0.05 * least(markets - 1, 4)) AS score FROM v),
  a AS (SELECT *, row_number() OVER (ORDER BY score DESC, symbol) AS rank FROM s)"""


STANDARD = {"ema": (20, 50, 200), "rsi": 14, "macd": (12, 26, 9), "atr": 14, "volume": 20}


def recursive(source: str, periods: dict = STANDARD) -> str:
    """All recursive indicators of `source` (exchange, timeframe, open_ms, high, low, close, volume) in one pass. Columns
    keep the names of the standard periods."""
    fast, slow, signal = periods["macd"]
    named = tuple(zip(("e12", "ema20", "e26", "ema50", "ema200"), (fast, periods["ema"][0], slow, *periods["ema"][1:])))
    ema = lambda n, p: f"CASE WHEN x.rn = {p} THEN x.sma{p} WHEN x.rn > {p} THEN (x.close - r.{n}) * 2.0 / {p + 1} + r.{n} END"
    means = ", ".join(f"avg(close) OVER (PARTITION BY exchange, symbol ORDER BY open_ms ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW) AS sma{p}" for p in sorted({p for _, p in named}))
    emas = ", ".join(f"{ema(n, p)} AS {n}" for n, p in named)
    first = ", ".join(f"NULL::DOUBLE AS {n}" for n, _ in named)
    run = lambda n, v, p: f"CASE WHEN x.rn = {p + 1} THEN x.{v}_mean WHEN x.rn > {p + 1} THEN (r.{n} * {p - 1} + x.{v}) / {p} END AS {n}"
    wilder = {"gain": periods["rsi"], "loss": periods["rsi"], "tr": periods["atr"]}
    begun = ", ".join(f"avg({v}) OVER (PARTITION BY exchange, symbol ORDER BY open_ms ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW) AS {v}_mean" for v, p in wilder.items())
    volume = periods["volume"]
    return f"""d AS (SELECT *, row_number() OVER w AS rn, greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss,
      CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
      FROM ({source}) WINDOW w AS (PARTITION BY exchange, symbol ORDER BY open_ms)),
    x AS (SELECT *, count(*) OVER (PARTITION BY exchange, symbol) AS n, {means}, {begun},
      CASE WHEN rn >= {volume} THEN avg(volume) OVER (PARTITION BY exchange, symbol ORDER BY open_ms ROWS BETWEEN {volume - 1} PRECEDING AND CURRENT ROW) END AS volume_mean
      FROM d),
    r AS (SELECT exchange, symbol, rn, {first}, NULL::DOUBLE AS ag, NULL::DOUBLE AS al, NULL::DOUBLE AS atr14 FROM x WHERE rn = 1
      UNION ALL SELECT x.exchange, x.symbol, x.rn, {emas}, {run('ag', 'gain', wilder['gain'])}, {run('al', 'loss', wilder['loss'])}, {run('atr14', 'tr', wilder['tr'])} FROM r JOIN x ON x.exchange = r.exchange AND x.symbol = r.symbol AND x.rn = r.rn + 1),
    l AS (SELECT x.*, r.ema20, r.ema50, r.ema200, r.atr14, CASE WHEN r.al = 0 THEN 100 ELSE 100 - 100 / (1 + r.ag / r.al) END AS rsi14, CASE WHEN x.n >= {slow + signal} THEN r.e12 - r.e26 END AS macd
      FROM x JOIN r ON x.exchange = r.exchange AND x.symbol = r.symbol AND x.rn = r.rn),
    l9 AS (SELECT *, avg(macd) OVER (PARTITION BY exchange, symbol ORDER BY rn ROWS BETWEEN {signal - 1} PRECEDING AND CURRENT ROW) AS macd9 FROM l),
    g AS (SELECT exchange, symbol, rn, macd9 AS macd_signal FROM l9 WHERE rn = {slow + signal - 1} AND n >= {slow + signal}
      UNION ALL SELECT l9.exchange, l9.symbol, l9.rn, (l9.macd - g.macd_signal) * 2.0 / {signal + 1} + g.macd_signal FROM g JOIN l9 ON l9.exchange = g.exchange AND l9.symbol = g.symbol AND l9.rn = g.rn + 1),
    i AS (SELECT l.*, g.macd_signal, l.macd - g.macd_signal AS macd_hist, CASE WHEN l.volume_mean > 0 THEN l.volume / l.volume_mean END AS volume_ratio
      FROM l LEFT JOIN g ON l.exchange = g.exchange AND l.symbol = g.symbol AND l.rn = g.rn)"""


CLOSED_SERIES = "SELECT exchange, symbol, timeframe, open_ms, open, high, low, close, volume FROM c WHERE closed"


def cut(n: int) -> str:
    return f"{CLOSED_SERIES} QUALIFY row_number() OVER (PARTITION BY exchange, symbol ORDER BY open_ms DESC) <= {n}"


def pivots(left: int, right: int, side: str) -> str:
    v = "high" if side == "high" else "-low"
    w = "PARTITION BY exchange, symbol ORDER BY open_ms"
    return f"""SELECT exchange, symbol, '{side}' AS kind, {'v' if side == 'high' else '-v'} AS price, event_ms, confirmed_ms FROM (
      SELECT exchange, symbol, plateau, min(i) AS first, min(open_ms) AS event_ms, first(v ORDER BY i) AS v, first(before ORDER BY i) AS before, last(after ORDER BY i) AS after, last(conf ORDER BY i) AS confirmed_ms FROM (
        SELECT *, sum(fresh) OVER ({w}) AS plateau, max(v) OVER ({w} ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING) AS before, max(v) OVER ({w} ROWS BETWEEN 1 FOLLOWING AND {right} FOLLOWING) AS after,
          lead(open_ms + 3600000, {right}) OVER ({w}) AS conf FROM (SELECT *, {v} AS v, row_number() OVER ({w}) - 1 AS i, CASE WHEN {v} = lag({v}) OVER ({w}) THEN 0 ELSE 1 END AS fresh FROM ({cut(500)})))
      GROUP BY exchange, symbol, plateau) WHERE first >= {left} AND confirmed_ms IS NOT NULL AND v > before AND v > after"""


def breaks(left: int, right: int) -> str:
    """Breaks of structure as a recursion over the bars of each series; needs `z` (the cut, numbered). The levels of
    each side are lists of (confirmed, event, price); the greatest of those in question is aimed at."""
    greatest = lambda of: f"list_sort({of}, 'DESC')[1]"
    since = lambda of, least: greatest(f"list_filter({of}, lambda v: v.c >= {least})")
    level = "STRUCT(c BIGINT, e BIGINT, p DOUBLE)"
    return f"""z AS (SELECT *, open_ms + 3600000 AS close_ms, row_number() OVER (PARTITION BY exchange, symbol ORDER BY open_ms) AS rn FROM ({cut(500)})),
    nw AS (SELECT exchange, symbol, confirmed_ms, list({{'c': confirmed_ms, 'e': event_ms, 'p': price}}) FILTER (kind = 'high') AS nu, list({{'c': confirmed_ms, 'e': event_ms, 'p': price}}) FILTER (kind = 'low') AS nd
      FROM ({pivots(left, right, 'high')} UNION ALL {pivots(left, right, 'low')}) GROUP BY ALL),
    b AS MATERIALIZED (SELECT z.exchange, z.symbol, rn, open_ms, close_ms, close, coalesce(nu, []::{level}[]) AS nu, coalesce(nd, []::{level}[]) AS nd FROM z LEFT JOIN nw ON nw.exchange = z.exchange AND nw.symbol = z.symbol AND nw.confirmed_ms = z.close_ms),
    st AS (SELECT exchange, symbol, 0::BIGINT AS rn, []::{level}[] AS u, []::{level}[] AS d, NULL::VARCHAR AS trend, NULL::VARCHAR AS ps, NULL::{level} AS pl, NULL::BIGINT AS pt, -1::BIGINT AS lu, -1::BIGINT AS ld,
        NULL::VARCHAR AS type, NULL::VARCHAR AS dir, NULL::{level} AS lv, NULL::{level} AS anchor, 0::BIGINT AS event_ms, 0::BIGINT AS confirmed_ms FROM z WHERE rn = 1
      UNION ALL SELECT exchange, symbol, rn, CASE WHEN type IN ('BOS', 'CHOCH') AND dir = 'up' THEN list_filter(u, lambda v: v <> lv) ELSE u END, CASE WHEN type IN ('BOS', 'CHOCH') AND dir = 'down' THEN list_filter(d, lambda v: v <> lv) ELSE d END,
        CASE WHEN type IN ('BOS', 'CHOCH_INVALIDATED') THEN dir WHEN type = 'CHOCH' THEN NULL ELSE trend END,
        CASE WHEN type = 'CHOCH' THEN dir WHEN type IS NULL THEN ps END, CASE WHEN type = 'CHOCH' THEN lv WHEN type IS NULL THEN pl END, CASE WHEN type = 'CHOCH' THEN close_ms WHEN type IS NULL THEN pt END,
        CASE WHEN type = 'BOS' AND dir = 'up' THEN lv.c ELSE lu END, CASE WHEN type = 'BOS' AND dir = 'down' THEN lv.c ELSE ld END, type, dir, lv,
        CASE WHEN type = 'BOS' AND dir = 'up' THEN {greatest('d')} WHEN type = 'BOS' THEN {greatest('u')} WHEN type = 'CHOCH' THEN lv END, open_ms, close_ms
      FROM (SELECT *, CASE WHEN type IS NULL THEN NULL WHEN ps IS NOT NULL THEN CASE WHEN type = 'BOS' THEN tp ELSE pl END WHEN trend IS NULL THEN CASE WHEN dir = 'up' THEN au ELSE ad END
            WHEN type = 'BOS' THEN oni WHEN dir = 'up' THEN au ELSE ad END AS lv FROM (
        SELECT *, CASE WHEN ps IS NOT NULL THEN CASE WHEN back THEN 'CHOCH_INVALIDATED' WHEN ahead THEN 'BOS' END WHEN ahead AND back THEN 'AMBIGUOUS' WHEN ahead OR (trend IS NULL AND back) THEN 'BOS' WHEN back THEN 'CHOCH' END AS type,
          CASE WHEN ps IS NOT NULL THEN CASE WHEN back THEN CASE ps WHEN 'up' THEN 'down' ELSE 'up' END ELSE ps END WHEN trend = 'down' THEN CASE WHEN ahead THEN 'down' ELSE 'up' END ELSE CASE WHEN ahead THEN 'up' ELSE 'down' END END AS dir FROM (
        SELECT *, coalesce(CASE WHEN ps = 'up' THEN close > tp.p WHEN ps = 'down' THEN close < tp.p WHEN trend = 'up' THEN close > oni.p WHEN trend = 'down' THEN close < oni.p ELSE len(u) > 0 AND len(d) > 0 AND close > au.p END, false) AS ahead,
          coalesce(CASE WHEN ps = 'up' THEN close < pl.p WHEN ps = 'down' THEN close > pl.p WHEN trend = 'up' THEN close < ad.p WHEN trend = 'down' THEN close > au.p ELSE len(u) > 0 AND len(d) > 0 AND close < ad.p END, false) AS back FROM (
        SELECT *, {greatest('u')} AS au, {greatest('d')} AS ad, CASE ps WHEN 'up' THEN {since('u', 'pt + 1')} WHEN 'down' THEN {since('d', 'pt + 1')} END AS tp, CASE trend WHEN 'up' THEN {since('u', 'lu')} WHEN 'down' THEN {since('d', 'ld')} END AS oni FROM (
        SELECT b.exchange, b.symbol, b.rn, b.open_ms, b.close_ms, b.close, list_concat(st.u, b.nu) AS u, list_concat(st.d, b.nd) AS d, trend, ps, pl, pt, lu, ld FROM st JOIN b ON b.exchange = st.exchange AND b.symbol = st.symbol AND b.rn = st.rn + 1 WHERE st.type IS DISTINCT FROM 'AMBIGUOUS')))))),
    be AS MATERIALIZED (SELECT exchange, symbol, '1h' AS timeframe, type, CASE WHEN type <> 'AMBIGUOUS' THEN dir END AS dir, CASE WHEN type <> 'AMBIGUOUS' THEN lv.p END AS level, CASE WHEN type <> 'AMBIGUOUS' THEN lv.e END AS level_ms, event_ms, confirmed_ms, anchor.p AS anchor_price, anchor.e AS anchor_ms
      FROM st WHERE type IS NOT NULL QUALIFY type = 'AMBIGUOUS' OR NOT max(type = 'AMBIGUOUS') OVER (PARTITION BY exchange, symbol))"""
