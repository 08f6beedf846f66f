"""Queries by name over the tables of a folder, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import scan
from tidemark.functions.timeframes import DURATION_MS, duration, expected_latest_closed, freshness
from tidemark.operators import asof, decision, evaluation, facts, journal, paging, predicates, reports, scoring, snapshots, structure, zones
from tidemark.plans import sql
from tidemark.sources import bridge, connector, upserts
from tidemark.sources.tables import settled, shared_dir
from tidemark.streaming import series

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
H = DURATION_MS["1h"]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def events(s: SparkSession, d: str) -> DataFrame:
    return bridge.read(s, d, "events")


def every(s: SparkSession, d: str) -> DataFrame:
    return bridge.all_candles(events(s, d))


def hourly(s: SparkSession, d: str) -> DataFrame:
    return bridge.candles_from_events(events(s, d), "1h")


def markets(s: SparkSession, d: str) -> DataFrame:
    return bridge.markets_from_star(s, d)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits: engines add in different orders."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


WITH_ALL, WITH_1H, WITH_M, WITH_A = (f"WITH {x} " for x in (sql.ALL, sql.HOURLY, sql.MARKETS, f"{sql.MARKETS}, {sql.ASSETS}"))


# Coverage and health of candles


@query(WITH_ALL + "SELECT timeframe, count(*) AS total, count(*) FILTER (closed) AS closed, count(*) FILTER (NOT closed) AS open, count(DISTINCT (exchange, symbol)) AS markets, min(open_ms) AS first_open_ms, max(open_ms) FILTER (closed) AS last_closed_ms, max(open_ms) AS last_open_ms FROM c GROUP BY timeframe")
def candle_coverage_by_timeframe(s, d):
    return reports.health_by_timeframe(every(s, d))


@query(WITH_ALL + "SELECT exchange, symbol, timeframe, count(*) AS candles, max(open_ms) AS last_ms FROM c GROUP BY ALL")
def market_timeframe_counts(s, d):
    return reports.counts_by_market(every(s, d))


@query(WITH_ALL + "SELECT exchange, symbol, timeframe, count(*) AS candles, max(open_ms) FILTER (closed) AS last_ms FROM c GROUP BY ALL")
def market_timeframe_counts_closed(s, d):
    return reports.counts_by_market(every(s, d), closed_last=True)


@query(WITH_ALL + "SELECT exchange, symbol, string_agg(timeframe || ':' || n || ':' || t, ',' ORDER BY timeframe) AS timeframes FROM (SELECT exchange, symbol, timeframe, count(*) AS n, max(open_ms) AS t FROM c GROUP BY ALL) GROUP BY exchange, symbol")
def market_timeframes_nested(s, d):
    text = F.array_join(F.transform("timeframes", lambda x: F.concat_ws(":", x["timeframe"], x["candles"], x["last_ms"])), ",")
    return reports.nested_by_market(every(s, d)).select("exchange", "symbol", text.alias("timeframes"))


@query(WITH_ALL + ", t AS (SELECT * FROM c UNION ALL SELECT * FROM c WHERE timeframe = '1d') SELECT count(*) AS duplicates FROM (SELECT 1 FROM t GROUP BY exchange, symbol, timeframe, open_ms HAVING count(*) > 1)")
def duplicate_candles(s, d):
    c = every(s, d)
    return reports.duplicate_keys(c.unionByName(c.where("timeframe = '1d'")))


@query(WITH_ALL + "SELECT exchange, count(DISTINCT symbol) AS markets, count(DISTINCT timeframe) AS timeframes, count(*) AS candles, min(open_ms) AS first_ms, max(open_ms) AS last_ms FROM c GROUP BY exchange")
def coverage_by_exchange(s, d):
    return reports.coverage_by_exchange(every(s, d))


@query(WITH_ALL + "SELECT timeframe, count(*) AS markets FROM (SELECT exchange, symbol, timeframe FROM c WHERE closed GROUP BY ALL HAVING count(*) >= 100) GROUP BY timeframe")
def markets_with_enough_history(s, d):
    return reports.enough_history(every(s, d), 100)


@query(WITH_ALL + "SELECT t.timeframe FROM (VALUES ('5m'), ('15m'), ('1h'), ('4h'), ('1d')) t(timeframe) WHERE t.timeframe NOT IN (SELECT timeframe FROM c)")
def missing_timeframes(s, d):
    return reports.missing_timeframes(every(s, d), s.createDataFrame([(t,) for t in DURATION_MS], "timeframe string"))


@query(WITH_ALL + "SELECT count(*) FILTER (closed) AS closed, count(*) FILTER (NOT closed) AS open FROM c")
def closed_open_totals(s, d):
    return reports.closed_open_totals(every(s, d))


@query(WITH_ALL + f"""SELECT exchange, symbol, timeframe, last_ms, CASE WHEN age <= 2 * w THEN 'fresh' WHEN age <= 6 * w THEN 'delayed' ELSE 'stale' END AS freshness FROM (
  SELECT exchange, symbol, timeframe, max(open_ms) FILTER (closed) AS last_ms, CASE timeframe WHEN '15m' THEN 900000 WHEN '1h' THEN 3600000 WHEN '4h' THEN 14400000 ELSE 86400000 END AS w,
  greatest((SELECT max((epoch_us(ts) // 1000)) FROM events) - max(open_ms) FILTER (closed), 0) AS age FROM c GROUP BY ALL)""")
def candle_freshness(s, d):
    last = reports.counts_by_market(every(s, d), closed_last=True).crossJoin(F.broadcast(bridge.events_now(events(s, d))))  # one row
    state = F.lit(None).cast("string")
    for t, w in DURATION_MS.items():
        state = F.when(F.col("timeframe") == t, freshness(F.col("last_ms"), F.col("now_ms"), w)).otherwise(state)
    return last.select("exchange", "symbol", "timeframe", "last_ms", state.alias("freshness"))


@query(WITH_1H + "SELECT count(*) AS n, count(*) FILTER (high >= greatest(low, open, close) AND low <= least(open, close) AND volume >= 0) AS sound FROM c")
def sound_candles(s, d):
    return hourly(s, d).agg(F.count("*").alias("n"), F.count_if(predicates.sound_candle()).alias("sound"))


# Markets and assets


@query(WITH_M + f"SELECT exchange, count(*) AS total, count(*) FILTER ({sql.ACTIVE}) AS active FROM m GROUP BY exchange")
def markets_by_exchange(s, d):
    return reports.markets_by_exchange(markets(s, d))


@query(WITH_M + f"SELECT exchange, count(*) AS markets, count(*) * 5 AS tasks, count(*) * 1500 AS max_candles FROM m WHERE {sql.ACTIVE} GROUP BY exchange")
def ingestion_plan(s, d):
    return reports.ingestion_plan(markets(s, d), 5, 300)


@query(WITH_A + "SELECT symbol, round(total, 2) AS total, round(highest, 2) AS highest, markets, round(score, 2) AS score, rank, rank <= 10 AS top500 FROM a")
def asset_liquidity_rank(s, d):
    return rounded(reports.ranked_assets(markets(s, d), 10), 2).withColumn("rank", F.col("rank").cast("long"))


@query(WITH_M + "SELECT exchange, symbol, round(quote_volume, 2) AS quote_volume, row_number() OVER (PARTITION BY exchange ORDER BY quote_volume DESC NULLS LAST, symbol) AS place FROM m QUALIFY place <= 5")
def top_markets_per_exchange(s, d):
    return rounded(reports.top_per_exchange(markets(s, d), 5), 2).select("exchange", "symbol", "quote_volume", F.col("place").cast("long").alias("place"))


@query(WITH_A + "SELECT count(*) AS total, count(*) FILTER (markets > 3) AS enabled, count(*) FILTER (rank BETWEEN 1 AND 10) AS universe, count(*) FILTER (rank <= 15) AS top500, count(rank) AS ranked FROM a")
def asset_counts(s, d):
    return reports.asset_counts(reports.ranked_assets(markets(s, d), 15).withColumn("enabled", F.col("markets") > 3), 10)


@query(WITH_M + f"SELECT exchange, symbol FROM m WHERE {sql.ACTIVE}")
def active_markets(s, d):
    return markets(s, d).where(predicates.active_market()).select("exchange", "symbol")


@query(WITH_M + "SELECT exchange, symbol FROM m WHERE enabled AND status = 'ACTIVE'")
def listed_markets(s, d):
    return markets(s, d).where(predicates.listed_market()).select("exchange", "symbol")


@query(WITH_M + "SELECT exchange, symbol, coalesce(change, 0) AS change FROM m WHERE lower(base) LIKE '%#2%' AND coalesce(change, 0) >= 0")
def market_table_filter(s, d):
    return predicates.filter_table(markets(s, d), "#2", "up").select("exchange", "symbol", F.coalesce("change", F.lit(0.0)).alias("change"))


@query(WITH_A + "SELECT symbol, rank FROM a WHERE symbol LIKE 'BRAND#1%' ORDER BY rank NULLS LAST, symbol LIMIT 4")
def asset_search(s, d):
    assets = reports.ranked_assets(markets(s, d)).withColumn("enabled", F.lit(True)).withColumn("name", F.col("symbol")).withColumn("symbol", F.upper("symbol"))
    return predicates.search_assets(assets, " brand#1 ", 4).select("symbol", F.col("rank").cast("long").alias("rank"))


ORACLE_SQL["asset_search"] = ORACLE_SQL["asset_search"].replace("SELECT symbol, rank FROM a WHERE symbol", "SELECT upper(symbol) AS symbol, rank FROM a WHERE upper(symbol)")


@query(WITH_A + f"SELECT symbol, rank FROM a WHERE rank <= 10 AND symbol IN (SELECT base FROM m WHERE {sql.ACTIVE} AND exchange IN ('ASIA', 'EUROPE'))")
def ranked_assets_with_active_market(s, d):
    active = markets(s, d).where(predicates.active_market() & F.col("exchange").isin("ASIA", "EUROPE")).select(F.col("base").alias("symbol"))
    assets = reports.ranked_assets(markets(s, d)).where(predicates.in_universe(F.col("rank"), 10))
    return assets.join(active, "symbol", "left_semi").select("symbol", F.col("rank").cast("long").alias("rank"))


@query(WITH_A + f"SELECT a.symbol, count(m.exchange) AS markets FROM a LEFT JOIN m ON a.symbol = m.base AND {sql.ACTIVE} AND m.exchange = 'ASIA' GROUP BY a.symbol")
def assets_with_nested_markets(s, d):
    m = markets(s, d)
    own = m.where(predicates.active_market() & (F.col("exchange") == "ASIA")).select("base", "exchange")
    return reports.liquidity(m).select("symbol").join(own, F.col("symbol") == F.col("base"), "left").groupBy("symbol").agg(F.count("exchange").alias("markets"))


@query(WITH_M + "SELECT exchange, symbol FROM m ORDER BY exchange, symbol LIMIT 50 OFFSET 50")
def market_offset_page(s, d):
    return paging.offset_page(markets(s, d).select("exchange", "symbol"), 2, [F.col("exchange"), F.col("symbol")])


@query(WITH_M + "SELECT DISTINCT exchange FROM m")
def distinct_exchanges(s, d):
    return markets(s, d).select("exchange").distinct()


@query(WITH_M + "SELECT exchange, base, CASE WHEN quote_volume IS NULL OR quote_volume < 500000 THEN 'volume' END AS reason FROM m")
def strategy_filter_reasons(s, d):
    return markets(s, d).withColumn("rank", F.lit(1)).select("exchange", "base", predicates.filter_reason(True, 500_000.0).alias("reason"))


# Candles of markets, markets of assets


@query(f"WITH {sql.ALL}, {sql.MARKETS} SELECT exchange, symbol, timeframe, count(*) AS candles, max(open_ms) FILTER (closed) AS last_ms, base FROM c JOIN m USING (exchange, symbol) WHERE base = 'Brand#12' GROUP BY ALL")
def asset_market_candles(s, d):
    return reports.counts_of_asset(every(s, d), markets(s, d), "Brand#12", closed_last=True)


@query(f"""WITH {sql.ALL}, {sql.MARKETS}, {sql.ASSETS}, own AS (SELECT exchange, symbol FROM m WHERE {sql.ACTIVE} AND base IN (SELECT symbol FROM a WHERE rank <= 20))
  SELECT timeframe, count(DISTINCT (exchange, symbol)) AS covered, (SELECT count(*) FROM own) AS wanted FROM c JOIN own USING (exchange, symbol) GROUP BY timeframe""")
def top_assets_coverage(s, d):
    m = markets(s, d)
    return reports.top_coverage(every(s, d), m, reports.ranked_assets(m), 20)


@query(f"WITH {sql.ALL}, {sql.MARKETS} SELECT timeframe, base, sum(n)::BIGINT AS candles, count(*) AS markets FROM (SELECT exchange, symbol, timeframe, count(*) AS n FROM c GROUP BY ALL) JOIN m USING (exchange, symbol) WHERE enabled AND status = 'ACTIVE' GROUP BY timeframe, base")
def candles_by_timeframe_and_asset(s, d):
    counts = reports.with_market(reports.counts_by_market(every(s, d)), markets(s, d).where(predicates.listed_market()), "base")
    return counts.groupBy("timeframe", "base").agg(F.sum("candles").alias("candles"), F.count("*").alias("markets"))


@query(f"WITH {sql.ALL}, {sql.MARKETS}, pg AS (SELECT exchange, symbol FROM m ORDER BY exchange, symbol LIMIT 50) SELECT exchange, symbol, timeframe, count(*) AS candles, max(open_ms) AS last_ms FROM c JOIN pg USING (exchange, symbol) WHERE closed GROUP BY ALL")
def page_coverage(s, d):
    page = paging.offset_page(markets(s, d).select("exchange", "symbol"), 1, [F.col("exchange"), F.col("symbol")])
    return reports.coverage_of_page(every(s, d), page)


@query(f"WITH {sql.ALL}, {sql.MARKETS}, {sql.ASSETS} SELECT symbol, rank FROM a WHERE symbol IN (SELECT base FROM m WHERE {sql.ACTIVE} AND (exchange, symbol) IN (SELECT (exchange, symbol) FROM c))")
def charted_assets(s, d):
    m = markets(s, d)
    return reports.charted_assets(reports.ranked_assets(m), m, every(s, d)).select("symbol", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {sql.HOURLY}, {sql.MARKETS} SELECT exchange, symbol FROM m WHERE (exchange, symbol) IN (SELECT (exchange, symbol) FROM c)")
def markets_with_candles(s, d):
    return reports.markets_with_candles(markets(s, d), hourly(s, d)).select("exchange", "symbol")


@query(WITH_A + "SELECT symbol, rank, markets FROM a WHERE symbol = 'Brand#12'")
def asset_by_symbol(s, d):
    return reports.ranked_assets(markets(s, d)).where(F.col("symbol") == "Brand#12").select("symbol", F.col("rank").cast("long").alias("rank"), "markets")


@query(WITH_A + "SELECT symbol, rank FROM a WHERE rank <= 6 ORDER BY rank")
def top_ranked_assets(s, d):
    assets = reports.ranked_assets(markets(s, d)).withColumn("enabled", F.lit(True))
    return predicates.top_ranked(assets, 6).select("symbol", F.col("rank").cast("long").alias("rank"))


@query(WITH_M + "SELECT exchange, symbol FROM m WHERE exchange = 'ASIA' AND contains(upper(symbol), 'BRAND#2')")
def market_search(s, d):
    m = markets(s, d).withColumn("symbol", F.upper("symbol"))
    return predicates.search_markets(m, "ASIA", " brand#2", ("ASIA", "EUROPE")).select("exchange", "symbol")


ORACLE_SQL["market_search"] = ORACLE_SQL["market_search"].replace("SELECT exchange, symbol", "SELECT exchange, upper(symbol) AS symbol")


@query(WITH_A + "SELECT symbol, CASE WHEN rank <= 12 THEN rank END AS rank, coalesce(rank <= 5, false) AND rank <= 12 AS top500 FROM a")
def rank_rewrite(s, d):
    ranked = reports.ranked_assets(markets(s, d), 5)
    stored = ranked.select("symbol", (F.col("rank") + 100).alias("rank"), F.lit(True).alias("top500"))
    return upserts.rewrite_ranks(stored, ranked.where("rank <= 12")).select("symbol", F.col("rank").cast("long").alias("rank"), "top500")


@query(WITH_M + f"SELECT exchange, count(*) * 5 AS tasks, count(*) * 5 <= 100 AS allowed FROM m WHERE {sql.ACTIVE} GROUP BY exchange")
def run_scale_gate(s, d):
    planned = reports.ingestion_plan(markets(s, d), 5, 300)
    return planned.select("exchange", "tasks", reports.run_allowed(F.col("tasks"), most=100).alias("allowed"))


@query(WITH_ALL + """SELECT exchange, symbol, timeframe, count(*) AS n, count(*) FILTER (closed AND high + greatest(abs(high), abs(low), 1) * 1e-9 >= greatest(low, open, close) AND low - greatest(abs(high), abs(low), 1) * 1e-9 <= least(open, close)) AS sound, count(*) - count(DISTINCT open_ms) AS repeated FROM c GROUP BY ALL""")
def series_validity(s, d):
    return predicates.series_validity(every(s, d))


@query(WITH_ALL + """, o AS (SELECT *, row_number() OVER (PARTITION BY exchange, symbol, timeframe ORDER BY CASE WHEN timeframe = '1d' THEN -open_ms ELSE open_ms END, dup) - 1 AS position
    FROM (SELECT *, 0 AS dup FROM c WHERE timeframe <> '1h' OR closed UNION ALL SELECT *, 1 FROM c WHERE timeframe = '1h' AND closed AND (open_ms // 3600000) % 50 = 0)),
  b AS (SELECT *, lag(open_ms) OVER (PARTITION BY exchange, symbol, timeframe ORDER BY position) AS p FROM o),
  r AS (SELECT *, CASE WHEN NOT closed THEN 'open' WHEN high < greatest(open, close) - 1e-9 OR low > least(open, close) + 1e-9 THEN 'prices' WHEN open_ms = p THEN 'repeated' WHEN open_ms < p THEN 'order' END AS reason FROM b)
  SELECT exchange, symbol, timeframe, min(position) AS position, arg_min(reason, position) AS reason FROM r WHERE reason IS NOT NULL GROUP BY ALL""")
def series_refusals(s, d):
    """Daily candles come newest first, some hourly ones twice, the open candle is among all but the hourly ones."""
    c = every(s, d)
    hours = c.where("timeframe = '1h' and closed")
    rows = c.where("timeframe <> '1h'").unionByName(hours).withColumn("dup", F.lit(0)).unionByName(hours.where((F.floor(F.col("open_ms") / H) % 50) == 0).withColumn("dup", F.lit(1)))
    order = W.partitionBy(*ind.SERIES).orderBy(F.when(F.col("timeframe") == "1d", -F.col("open_ms")).otherwise(F.col("open_ms")), "dup")
    return predicates.series_refusals(rows.withColumn("position", (F.row_number().over(order) - 1).cast("long")))


@query(f"""WITH {sql.ALL}, {sql.MARKETS}, {sql.ASSETS} SELECT * FROM (VALUES (1, 'strategies', (SELECT count(*) FROM part)), (2, 'assets in the universe', (SELECT count(*) FROM a WHERE rank <= 10 AND markets > 3)),
  (3, 'markets in the universe', (SELECT count(*) FROM m WHERE {sql.ACTIVE} AND base IN (SELECT symbol FROM a WHERE rank <= 10))), (4, 'active markets', (SELECT count(*) FROM m WHERE {sql.ACTIVE})), (5, 'candles', (SELECT count(*) FROM c)),
  (6, 'active signals', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000)), (7, 'exchanges', (SELECT count(DISTINCT exchange) FROM m WHERE {sql.ACTIVE})), (8, 'last closed hour', (SELECT max(open_ms) FROM c WHERE timeframe = '1h' AND closed))) t(place, figure, value)""")
def admin_overview(s, d):
    """Orders stand for signals: large open ones are active."""
    m = markets(s, d)
    assets = reports.ranked_assets(m).withColumn("enabled", F.col("markets") > 3)
    signals = bridge.read(s, d, "orders").select(F.when((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 300_000), "ACTIVE").otherwise("CLOSED").alias("status"))
    return reports.overview(strategies(s, d), assets, m, every(s, d), signals, 10)


STRATEGIES = "(SELECT p_type AS slug, p_size AS version, p_partkey % 2 = 0 AS enabled, CASE WHEN p_partkey % 3 = 0 THEN 'PUBLISHED' ELSE 'DRAFT' END AS status, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS market_cap, p_partkey AS id FROM part)"


def strategies(s, d):
    key = F.col("p_partkey")
    return bridge.read(s, d, "part").select(F.col("p_type").alias("slug"), F.col("p_size").alias("version"), (key % 2 == 0).alias("enabled"), F.when(key % 3 == 0, "PUBLISHED").otherwise("DRAFT").alias("status"), F.when(key % 7 != 0, F.col("p_retailprice")).alias("market_cap"), key.alias("id"))


@query(f"SELECT slug, version, id FROM {STRATEGIES} WHERE enabled AND status = 'PUBLISHED' ORDER BY slug, version DESC")
def published_strategies(s, d):
    return reports.published_strategies(strategies(s, d)).select("slug", "version", "id")


@query(f"SELECT round(sum(coalesce(market_cap, 0)), 2) AS market_cap, count(*) FILTER (enabled AND status = 'PUBLISHED') AS published FROM {STRATEGIES}")
def market_overview(s, d):
    return rounded(reports.market_overview(strategies(s, d)), 2)


# Snapshots

WIDTH_SQL = "CASE timeframe WHEN '15m' THEN 900000 WHEN '1h' THEN 3600000 WHEN '4h' THEN 14400000 ELSE 86400000 END"
SNAPSHOTS = f"sn AS (SELECT exchange, symbol, timeframe, open_ms AS candle_ms, close AS price, open_ms + {WIDTH_SQL} AS calculated_ms FROM c WHERE closed QUALIFY row_number() OVER (PARTITION BY exchange, symbol, timeframe ORDER BY open_ms DESC) <= 3)"


def snapshot_rows(s, d):
    rows = paging.newest_per_group(every(s, d).where("closed"), ind.SERIES, "open_ms", 3)
    return rows.select(*ind.SERIES, F.col("open_ms").alias("candle_ms"), F.col("close").alias("price"), (F.col("open_ms") + duration(F.col("timeframe"))).alias("calculated_ms"))


@query(WITH_ALL + f", {SNAPSHOTS}, k AS (SELECT *, row_number() OVER (PARTITION BY exchange, symbol, timeframe ORDER BY candle_ms DESC) AS nth FROM sn) SELECT exchange, symbol, timeframe, candle_ms, round(CASE WHEN nth = 2 THEN price + 1 ELSE price END, 6) AS price, CASE WHEN nth <= 2 THEN 9000000000000 ELSE calculated_ms END AS calculated_ms FROM k")
def snapshot_upsert(s, d):
    rows = snapshot_rows(s, d)
    nth = F.row_number().over(W.partitionBy(*ind.SERIES).orderBy(F.col("candle_ms").desc()))
    rows = rows.withColumn("nth", nth)
    again = rows.where("nth <= 2").withColumn("price", F.col("price") + F.when(F.col("nth") == 2, 1.0).otherwise(0.0)).withColumn("seq", F.lit(1))
    return rounded(snapshots.upsert_snapshots(rows.where("nth > 1").drop("nth"), again, F.lit(9_000_000_000_000)))


@query(WITH_ALL + f", {SNAPSHOTS} SELECT timeframe, count(*) AS total, count(DISTINCT (exchange, symbol)) AS markets, max(candle_ms) AS last_candle_ms, max(calculated_ms) AS last_calculated_ms FROM sn GROUP BY timeframe")
def snapshot_health(s, d):
    return snapshots.health(snapshot_rows(s, d))


@query(WITH_ALL + f", {SNAPSHOTS} SELECT exchange, symbol, timeframe, candle_ms, calculated_ms FROM sn ORDER BY calculated_ms DESC, exchange, symbol, timeframe, candle_ms LIMIT 20")
def latest_snapshots(s, d):
    return snapshots.latest(snapshot_rows(s, d)).drop("price")


@query(f"WITH {sql.ALL}, {sql.MARKETS}, {SNAPSHOTS} SELECT exchange, symbol, timeframe, candle_ms, base, market_type FROM sn JOIN m USING (exchange, symbol)")
def snapshots_with_market(s, d):
    return snapshots.with_market(snapshot_rows(s, d), markets(s, d), "base", "market_type").select(*snapshots.KEY, "base", "market_type")


@query(f"""WITH {sql.ALL}, {sql.MARKETS}, {SNAPSHOTS}, own AS (SELECT exchange, symbol FROM m WHERE {sql.ACTIVE}), e AS (SELECT timeframe, count(*) FILTER (n >= 150) AS enough FROM (SELECT exchange, symbol, timeframe, count(*) FILTER (closed) AS n FROM c JOIN own USING (exchange, symbol) GROUP BY ALL) GROUP BY timeframe),
  x AS (SELECT timeframe, count(*) AS existing FROM sn JOIN own USING (exchange, symbol) GROUP BY timeframe)
  SELECT timeframe, markets, enough, existing, greatest(enough - existing, 0) AS created, least(existing, enough) AS updated, markets - enough AS without FROM (SELECT e.timeframe, (SELECT count(*) FROM own) AS markets, enough, coalesce(existing, 0) AS existing FROM e LEFT JOIN x USING (timeframe))""")
def snapshot_run_plan(s, d):
    stored = snapshot_rows(s, d)
    return snapshots.plan(markets(s, d).where(predicates.active_market()), every(s, d), stored, 150)


@query(WITH_M + "SELECT exchange, count(DISTINCT (exchange, symbol)) AS markets, count(*) FILTER (trades % 4 = 0) AS created, count(*) FILTER (trades % 4 = 1) AS updated, count(*) FILTER (trades % 4 = 2) AS skipped, count(*) FILTER (trades % 4 = 3) AS error FROM m GROUP BY ROLLUP (exchange)")
def snapshot_run_stats(s, d):
    outcome = F.element_at(F.array(*[F.lit(o) for o in ("created", "updated", "skipped", "error")]), (F.col("trades") % 4 + 1).cast("int"))
    return snapshots.run_stats(markets(s, d).select("exchange", "symbol", outcome.alias("outcome")))


# Pages, latest rows, upserts


@query(WITH_1H + "SELECT *, min(open_ms) OVER () AS next_cursor_ms FROM (SELECT open_ms, round(close, 6) AS close, true AS has_more FROM c WHERE (exchange, symbol) = (SELECT (exchange, symbol) FROM c ORDER BY exchange, symbol LIMIT 1) AND closed ORDER BY open_ms DESC LIMIT 100)")
def keyset_page(s, d):
    c = hourly(s, d)
    first = c.agg(F.min(F.struct("exchange", "symbol")).alias("m")).select("m.*")
    own = c.where("closed").join(F.broadcast(first), ["exchange", "symbol"], "left_semi")  # one row
    return rounded(paging.keyset_page(own, None, 100).select("open_ms", "close", "has_more", "next_cursor_ms"))


@query(WITH_1H + "SELECT exchange, symbol, open_ms, round(close, 6) AS close FROM c WHERE closed QUALIFY row_number() OVER (PARTITION BY exchange, symbol ORDER BY open_ms DESC) <= 300")
def newest_300_closed(s, d):
    return rounded(paging.newest_per_group(hourly(s, d).where("closed"), ind.SERIES, "open_ms", 300).select("exchange", "symbol", "open_ms", "close"))


@query(WITH_ALL + "SELECT exchange, symbol, timeframe, open_ms, round(close, 6) AS close FROM c QUALIFY row_number() OVER (PARTITION BY exchange, symbol, timeframe ORDER BY open_ms DESC) = 1")
def latest_candle(s, d):
    return rounded(paging.latest_per_group(every(s, d), ind.SERIES, "open_ms").select("exchange", "symbol", "timeframe", "open_ms", "close"))


@query(WITH_1H + f""", b AS (SELECT max(open_ms) - 100 * {H} AS t FROM c), k AS (SELECT exchange, symbol, open_ms, CASE WHEN open_ms >= t THEN close + 1 ELSE close END AS close, open_ms >= t AND open_ms < t + 50 * {H} AS replaced FROM c, b)
  SELECT exchange, symbol, count(*) AS n, count(*) FILTER (replaced) AS replaced, round(sum(close), 4) AS sum_close FROM k GROUP BY exchange, symbol""")
def candle_upsert(s, d):
    c = hourly(s, d)
    edge = c.agg((F.max("open_ms") - 100 * H).alias("t"))
    c = c.crossJoin(F.broadcast(edge))  # one row
    stored = c.where(F.col("open_ms") < F.col("t") + 50 * H)
    incoming = c.where(F.col("open_ms") >= F.col("t")).withColumns({n: F.col(n) + 1 for n in ("open", "high", "low", "close")}).withColumn("seq", F.lit(1))
    merged = upserts.upsert_candles(stored.select(*ind.SERIES, "open_ms", "open", "high", "low", "close", "volume", "closed", "t"), incoming)
    was = (F.col("open_ms") >= F.col("t")) & (F.col("open_ms") < F.col("t") + 50 * H)
    return merged.groupBy("exchange", "symbol").agg(F.count("*").alias("n"), F.count_if(was).alias("replaced"), F.round(F.sum("close"), 4).alias("sum_close"))


@query(WITH_1H + f"SELECT exchange, symbol, count(*) AS n, min(open_ms) AS first_ms FROM c JOIN (SELECT exchange, symbol, max(open_ms) AS t FROM c WHERE open_ms < (SELECT max(open_ms) FROM c) - 24 * {H} GROUP BY exchange, symbol) USING (exchange, symbol) WHERE open_ms >= t GROUP BY exchange, symbol")
def incremental_cut(s, d):
    c = hourly(s, d)
    edge = c.agg((F.max("open_ms") - 24 * H).alias("t"))
    stored = c.crossJoin(F.broadcast(edge)).where("open_ms < t").drop("t")  # one row
    return upserts.incremental_cut(c, stored).groupBy("exchange", "symbol").agg(F.count("*").alias("n"), F.min("open_ms").alias("first_ms"))


@query(WITH_1H + "SELECT exchange, timeframe, count(*) AS tasks, sum(open_ms % 7) AS written, sum(open_ms % 2) AS skipped, sum(greatest(least(open_ms % 5 - open_ms % 3, open_ms % 7), 0)) AS created FROM c GROUP BY GROUPING SETS ((), (exchange), (timeframe))")
def ingestion_stats(s, d):
    m = lambda n: F.col("open_ms") % n
    return reports.task_stats(hourly(s, d).select("exchange", "timeframe", m(7).alias("written"), m(2).alias("skipped"), m(3).alias("before"), m(5).alias("after")))


# Indicators

WITH_I = f"WITH RECURSIVE {sql.HOURLY}, {sql.recursive(sql.CLOSED_SERIES)} "
WITH_I300 = f"WITH RECURSIVE {sql.HOURLY}, {sql.recursive(sql.cut(300))} "
WITH_I500 = f"WITH RECURSIVE {sql.HOURLY}, {sql.recursive(sql.cut(500))} "


def series_query(name: str, columns: list[str]):
    shown = ", ".join(f"round({c}, 6) AS {c}" for c in columns)
    QUERIES[name] = lambda s, d: rounded(ind.with_indicators(hourly(s, d)).select("exchange", "symbol", "open_ms", *columns))
    ORACLE_SQL[name] = WITH_I + f"SELECT exchange, symbol, open_ms, {shown} FROM i"


series_query("ema_series", ["ema20", "ema50", "ema200"])
series_query("rsi14_series", ["rsi14"])
series_query("macd_series", ["macd", "macd_signal", "macd_hist"])
series_query("atr14_series", ["atr14"])
series_query("volume_ratio_series", ["volume_mean", "volume_ratio"])


@query(WITH_1H + "SELECT exchange, symbol, open_ms, CASE WHEN row_number() OVER w >= 20 THEN round(avg(close) OVER (PARTITION BY exchange, symbol ORDER BY open_ms ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) END AS sma20 FROM c WHERE closed WINDOW w AS (PARTITION BY exchange, symbol ORDER BY open_ms)")
def sma20_series(s, d):
    return rounded(hourly(s, d).where("closed").select("exchange", "symbol", "open_ms", ind.sma("close", 20).alias("sma20")))


@query(WITH_1H + "SELECT exchange, symbol, open_ms, round(greatest(high - low, abs(high - p), abs(low - p)), 6) AS true_range FROM (SELECT *, lag(close) OVER (PARTITION BY exchange, symbol ORDER BY open_ms) AS p FROM c WHERE closed) WHERE p IS NOT NULL")
def true_range_series(s, d):
    return rounded(hourly(s, d).where("closed").select("exchange", "symbol", "open_ms", ind.true_range().alias("true_range")).where("true_range is not null"))


@query(WITH_I + "SELECT exchange, symbol, round(ema20, 6) AS ema20 FROM i WHERE rn = n")
def ema20_last(s, d):
    return rounded(paging.latest_per_group(ind.with_indicators(hourly(s, d)), ind.SERIES, "open_ms").select("exchange", "symbol", "ema20"))


SNAPSHOT = ["close", "ema20", "ema50", "ema200", "rsi14", "macd", "macd_signal", "macd_hist", "atr14", "volume", "volume_mean", "volume_ratio"]


@query(WITH_I300 + "SELECT exchange, symbol, open_ms, " + ", ".join(f"round({c}, 6) AS {c}" for c in SNAPSHOT) + " FROM i WHERE rn = n AND n >= 200")
def indicator_snapshot(s, d):
    return rounded(ind.snapshots(hourly(s, d)).select("exchange", "symbol", "open_ms", *SNAPSHOT))


SCANNED = ["ema20", "ema50", "ema200", "rsi14", "macd", "macd_signal", "macd_hist", "atr14", "volume_mean", "volume_ratio"]


@query(WITH_I + "SELECT exchange, symbol, open_ms, " + ", ".join(f"round({c}, 6) AS {c}" for c in SCANNED) + " FROM i")
def indicator_scan(s, d):
    """All indicators of whole series, as a parallel scan over chunks of two days."""
    return rounded(scan.indicators_in_chunks(hourly(s, d), rows=48).select("exchange", "symbol", "open_ms", *SCANNED))


@query(f"""WITH {sql.ALL}, l AS (SELECT exchange, symbol, open_ms + {H} AS calculated_ms, close FROM c WHERE timeframe = '1h' AND closed),
  r AS (SELECT exchange, symbol, open_ms + {4 * H} AS close_ms, close AS slow_close, open_ms AS slow_open_ms FROM c WHERE timeframe = '4h' AND closed)
  SELECT l.*, slow_close, slow_open_ms FROM l ASOF LEFT JOIN r ON l.exchange = r.exchange AND l.symbol = r.symbol AND l.calculated_ms >= r.close_ms""")
def snapshot_asof(s, d):
    """Every hourly snapshot with the last four-hour candle that was over by then."""
    both = every(s, d).where("closed").withColumn("close_ms", F.col("open_ms") + duration(F.col("timeframe")))
    left = both.where("timeframe = '1h'").select("exchange", "symbol", F.col("close_ms").alias("calculated_ms"), "close")
    right = both.where("timeframe = '4h'").select("exchange", "symbol", "close_ms", F.col("close").alias("slow_close"), F.col("open_ms").alias("slow_open_ms"))
    return asof.last_at_or_before(left, right, ["exchange", "symbol"], "calculated_ms", "close_ms", ["slow_close", "slow_open_ms"], width=5 * DURATION_MS["1d"])


@query(WITH_1H + "SELECT exchange, symbol, open_ms, open, high, low, close, volume, closed FROM c")
def recorded_candles(s, d):
    """Candles written as the answers of five venues, each in its own format, and read back by the data source."""
    connector.register(s)
    regions = dict(zip(bridge.VENUES.values(), connector.EXCHANGES))
    name, back = F.lit(None).cast("string"), F.lit(None).cast("string")
    for region, venue in regions.items():
        name, back = F.when(F.col("exchange") == region, venue).otherwise(name), F.when(F.col("exchange") == venue, region).otherwise(back)
    c = hourly(s, d).withColumn("close_ms", F.col("open_ms") + H - 1).withColumn("fetched_ms", F.col("now_ms")).withColumn("exchange", name)
    path = f"{shared_dir(s)}/answers-{uuid.uuid4().hex}"
    connector.record(c, path)
    read = connector.parse_answers(s.read.format("venue_answers").option("path", path).load())
    return read.select(back.alias("exchange"), "symbol", "open_ms", "open", "high", "low", "close", "volume", "closed")


def streamed(s, candles, make, parts=3):
    """What a stream makes of candles that come in parts, the query being stopped after each and started again."""
    folder = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    candles = settled(candles)
    low, high = candles.agg(F.min("open_ms"), F.max("open_ms")).first()
    for k in range(parts):
        step = (high - low) // parts + 1
        candles.where(F.col("open_ms").between(low + k * step, low + (k + 1) * step - 1)).write.mode("append").parquet(f"{folder}/in")
        made = make(s.readStream.schema(candles.schema).parquet(f"{folder}/in"))
        made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(made.schema).parquet(f"{folder}/out")


@query(WITH_I + "SELECT exchange, symbol, open_ms, " + ", ".join(f"round({c}, 6) AS {c}" if not c.startswith("macd") else f"round(CASE WHEN rn >= 35 THEN {c} END, 6) AS {c}" for c in SCANNED) + " FROM i")
def streamed_indicators(s, d):
    """Indicators of a stream with state, across restarts."""
    return rounded(streamed(s, hourly(s, d).where("closed").drop("now_ms"), series.indicator_stream).select("exchange", "symbol", "open_ms", *SCANNED))


# Structure


def structure_rows(s, d):
    return structure.prepared(hourly(s, d))


def settled_rows(s, d):
    return settled(structure_rows(s, d))


@query(f"WITH {sql.HOURLY} " + sql.pivots(5, 5, "high") + " UNION ALL " + sql.pivots(5, 5, "low"))
def pivots_internal(s, d):
    return structure.both_pivots(structure.horizon(hourly(s, d)), 5, 5).drop("timeframe")


@query(f"WITH {sql.HOURLY} " + sql.pivots(20, 20, "high") + " UNION ALL " + sql.pivots(20, 20, "low"))
def pivots_swing(s, d):
    return structure.both_pivots(structure.horizon(hourly(s, d)), 20, 20).drop("timeframe")


@query(WITH_I500 + """, z AS (SELECT exchange, symbol, open_ms, open, close, abs(close - open) / atr14 AS body_atr, (high - low) / atr14 AS range_atr, CASE WHEN high = low THEN 0.5 ELSE (close - low) / (high - low) END AS close_location FROM i WHERE atr14 IS NOT NULL)
  SELECT exchange, symbol, open_ms, CASE WHEN close > open THEN 'up' ELSE 'down' END AS direction, round(body_atr, 6) AS body_atr, round(range_atr, 6) AS range_atr, round(close_location, 6) AS close_location FROM z
  WHERE body_atr >= 1 AND range_atr >= 1.2 AND ((close > open AND close_location >= 0.6) OR (close < open AND close_location <= 0.4))""")
def displacement(s, d):
    return rounded(structure.displacements(structure_rows(s, d), 1.0, 1.2).drop("timeframe"))


GAPS = """, q AS (SELECT *, rn - 1 AS k, open_ms + 3600000 AS close_ms, lag(open_ms) OVER w AS event_ms, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM i WINDOW w AS (PARTITION BY exchange, symbol ORDER BY open_ms)),
  f AS (SELECT exchange, symbol, k, close_ms, event_ms, CASE WHEN low > h2 THEN 'up' ELSE 'down' END AS direction, CASE WHEN low > h2 THEN h2 ELSE high END AS bottom, CASE WHEN low > h2 THEN low ELSE l2 END AS top, atr14 FROM q WHERE (low > h2 OR high < l2) AND atr14 IS NOT NULL),
  fg AS (SELECT *, (top - bottom) / atr14 AS size_atr FROM f WHERE (top - bottom) / atr14 >= 0.1)"""


@query(WITH_I500 + GAPS + " SELECT exchange, symbol, event_ms, close_ms AS confirmed_ms, direction, round(bottom, 6) AS bottom, round(top, 6) AS top, round(size_atr, 6) AS size_atr FROM fg")
def fvg_detect(s, d):
    return rounded(structure.gaps(structure_rows(s, d)).select("exchange", "symbol", "event_ms", F.col("close_ms").alias("confirmed_ms"), "direction", "bottom", "top", "size_atr"))


LIVES = """, p AS (SELECT fg.*, q.k AS j, q.close_ms AS at_ms, q.high, q.low, q.close, CASE WHEN direction = 'up' THEN q.close < bottom ELSE q.close > top END AS broken FROM fg LEFT JOIN q ON q.exchange = fg.exchange AND q.symbol = fg.symbol AND q.k > fg.k),
  pe AS (SELECT *, min(CASE WHEN broken THEN j END) OVER (PARTITION BY exchange, symbol, k) AS stop FROM p),
  life AS (SELECT exchange, symbol, k, any_value(event_ms) AS event_ms, any_value(close_ms) AS confirmed_ms, any_value(direction) AS direction,
    min(at_ms) FILTER (CASE WHEN direction = 'up' THEN low < top ELSE high > bottom END) AS touched_ms,
    min(at_ms) FILTER (CASE WHEN direction = 'up' THEN low <= (bottom + top) / 2 ELSE high >= (bottom + top) / 2 END) AS half_ms,
    min(at_ms) FILTER (CASE WHEN direction = 'up' THEN low <= bottom ELSE high >= top END) AS filled_ms, min(at_ms) FILTER (broken) AS invalidated_ms,
    CASE WHEN count(j) = 0 THEN 0 ELSE greatest(0, least(1, max(CASE WHEN direction = 'up' THEN top - low ELSE high - bottom END / (top - bottom)))) END AS fill
    FROM pe WHERE stop IS NULL OR j <= stop GROUP BY exchange, symbol, k),"""


@query(WITH_I500 + GAPS + LIVES + """
  done AS (SELECT life.*, CASE WHEN invalidated_ms IS NULL THEN e.close_ms END AS expired_ms FROM life LEFT JOIN q e ON e.exchange = life.exchange AND e.symbol = life.symbol AND e.k = life.k + 100)
  SELECT exchange, symbol, event_ms, direction, touched_ms, half_ms, filled_ms, invalidated_ms, expired_ms, round(fill, 6) AS fill, CASE WHEN invalidated_ms IS NOT NULL THEN 'INVALIDATED' WHEN expired_ms IS NOT NULL THEN 'EXPIRED'
    WHEN filled_ms IS NOT NULL THEN 'FILLED' WHEN half_ms IS NOT NULL THEN 'CE' WHEN touched_ms IS NOT NULL THEN 'TOUCHED' ELSE 'OPEN' END AS state FROM done""")
def fvg_lifecycle(s, d):
    rows = settled_rows(s, d)
    lives = structure.gap_lives(rows, structure.gaps(rows), 100)
    return rounded(lives.select("exchange", "symbol", "event_ms", "direction", "touched_ms", "half_ms", "filled_ms", "invalidated_ms", "expired_ms", "fill", "state"))


#: Fifty times, five hours apart.
AS_OF = [1_705_000_000_000 + k * 5 * H for k in range(50)]


@query(WITH_I500 + GAPS + LIVES + f"""
  due AS (SELECT life.*, e.close_ms AS due_ms FROM life LEFT JOIN q e ON e.exchange = life.exchange AND e.symbol = life.symbol AND e.k = life.k + 100),
  t AS (SELECT unnest(range({AS_OF[0]}, {AS_OF[-1] + 1}, {5 * H})) AS as_of_ms)
  SELECT as_of_ms, exchange, symbol, 'SMC1|FVG|1h|' || direction || '|' || event_ms AS key, CASE WHEN invalidated_ms <= as_of_ms THEN 'INVALIDATED' WHEN due_ms <= as_of_ms THEN 'EXPIRED' WHEN filled_ms <= as_of_ms THEN 'FILLED'
    WHEN half_ms <= as_of_ms THEN 'CE' WHEN touched_ms <= as_of_ms THEN 'TOUCHED' ELSE 'OPEN' END AS state FROM due JOIN t ON confirmed_ms <= as_of_ms""")
def gaps_as_of(s, d):
    """Every gap as it was known at each of fifty times, from one evaluation."""
    rows = settled_rows(s, d)
    known = facts.gap_versions(structure.gap_lives(rows, structure.gaps(rows), 100))
    return facts.as_of(known, AS_OF).select("as_of_ms", "exchange", "symbol", "key", "state")


@query(f"""WITH RECURSIVE {sql.HOURLY}, {sql.recursive(sql.cut(500))}{GAPS}{LIVES}
  due AS (SELECT life.*, e.close_ms AS due_ms, bottom, top, round(size_atr, 6) AS size_atr FROM life JOIN fg ON fg.exchange = life.exchange AND fg.symbol = life.symbol AND fg.k = life.k LEFT JOIN q e ON e.exchange = life.exchange AND e.symbol = life.symbol AND e.k = life.k + 100),
  {sql.breaks(5, 5)}, pv AS ({sql.pivots(5, 5, 'high')} UNION ALL {sql.pivots(5, 5, 'low')}), ao AS (SELECT {AS_OF[-1]} AS t),
  n AS (SELECT * FROM (
    SELECT exchange, symbol, 'p' AS what, event_ms, 'SMC1|P|1h|internal|' || kind || '|' || event_ms AS key, to_json({{'key': 'SMC1|P|1h|internal|' || kind || '|' || event_ms, 'layer': 'internal', 'state': 'CONFIRMED', 'event_ms': event_ms, 'kind': kind, 'price': price, 'confirmed_ms': confirmed_ms}})::VARCHAR AS x FROM pv, ao WHERE confirmed_ms <= t
    UNION ALL SELECT pv.exchange, pv.symbol, 'l', pv.event_ms, 'SMC1|P|1h|internal|' || kind || '|' || pv.event_ms, to_json({{'key': 'SMC1|P|1h|internal|' || kind || '|' || pv.event_ms, 'layer': 'internal', 'state': CASE WHEN be.confirmed_ms <= t THEN 'CONSUMED' ELSE 'ACTIVE' END, 'event_ms': pv.event_ms, 'kind': kind, 'price': price, 'confirmed_ms': pv.confirmed_ms, 'consumed_ms': CASE WHEN be.confirmed_ms <= t THEN be.confirmed_ms END}})::VARCHAR
      FROM ao, pv LEFT JOIN be ON be.exchange = pv.exchange AND be.symbol = pv.symbol AND be.type IN ('BOS', 'CHOCH') AND (be.dir = 'up') = (kind = 'high') AND be.level_ms = pv.event_ms WHERE pv.confirmed_ms <= t
    UNION ALL SELECT exchange, symbol, 'g', event_ms, 'SMC1|FVG|1h|' || direction || '|' || event_ms, to_json({{'key': 'SMC1|FVG|1h|' || direction || '|' || event_ms, 'layer': '', 'state': CASE WHEN invalidated_ms <= t THEN 'INVALIDATED' WHEN due_ms <= t THEN 'EXPIRED' WHEN filled_ms <= t THEN 'FILLED' WHEN half_ms <= t THEN 'CE' WHEN touched_ms <= t THEN 'TOUCHED' ELSE 'OPEN' END, 'event_ms': event_ms,
      'direction': direction, 'bottom': bottom, 'top': top, 'size_atr': size_atr, 'confirmed_ms': confirmed_ms, {", ".join(f"'{c}': CASE WHEN {c} <= t THEN {c} END" for c in ("touched_ms", "half_ms", "filled_ms", "due_ms", "invalidated_ms"))}}})::VARCHAR FROM due, ao WHERE confirmed_ms <= t))
  SELECT exchange, symbol, '{{"pivots":[' || coalesce(string_agg(x, ',' ORDER BY event_ms, key) FILTER (what = 'p'), '') || '],"events":[],"levels":[' || coalesce(string_agg(x, ',' ORDER BY event_ms, key) FILTER (what = 'l'), '')
    || '],"liquidity":[],"ranges":[],"gaps":[' || coalesce(string_agg(x, ',' ORDER BY event_ms, key) FILTER (what = 'g'), '') || '],"blocks":[],"displacements":[]}}' AS document FROM n GROUP BY exchange, symbol""")
def market_documents(s, d):
    """A JSON document for each market with its pivots, levels and gaps as they were known at one time."""
    rows = settled_rows(s, d)
    pivots, events = settled(structure.both_pivots(rows, 5, 5)), structure.structure_events(rows, 5, 5)
    lives = structure.gap_lives(rows, structure.gaps(rows), 100).withColumn("size_atr", F.round("size_atr", 6))
    known = facts.pivot_versions(pivots, "internal").unionByName(facts.level_versions(structure.structure_levels(pivots, events), "internal")).unionByName(facts.gap_versions(lives))
    return facts.documents(facts.as_of(known, AS_OF[-1:])).select("exchange", "symbol", "document")


@query(f"WITH RECURSIVE {sql.HOURLY}, {sql.breaks(5, 5)} SELECT * REPLACE (round(level, 6) AS level, round(anchor_price, 6) AS anchor_price) FROM be")
def structure_events_internal(s, d):
    return rounded(structure.structure_events(structure.horizon(hourly(s, d)), 5, 5))


@query(f"WITH RECURSIVE {sql.HOURLY}, {sql.breaks(20, 20)} SELECT * REPLACE (round(level, 6) AS level, round(anchor_price, 6) AS anchor_price) FROM be")
def structure_events_swing(s, d):
    return rounded(structure.structure_events(structure.horizon(hourly(s, d)), 20, 20))


@query(f"WITH RECURSIVE {sql.HOURLY}, {sql.breaks(5, 5)} SELECT * REPLACE (round(level, 6) AS level, round(anchor_price, 6) AS anchor_price) FROM be")
def streamed_structure(s, d):
    """Breaks of structure of a stream with state, across restarts."""
    return rounded(streamed(s, structure.horizon(hourly(s, d)).drop("now_ms", "i", "close_ms"), lambda c: series.structure_stream(c, 5, 5)))


@query(f"""WITH RECURSIVE {sql.HOURLY}, {sql.breaks(5, 5)}, tn AS (SELECT *, lead(confirmed_ms) OVER (PARTITION BY exchange, symbol ORDER BY confirmed_ms) AS closed_ms FROM be WHERE (type = 'BOS' AND anchor_price IS NOT NULL) OR type = 'CHOCH')
  SELECT exchange, symbol, timeframe, dir, round(least(level, anchor_price), 6) AS low, round(greatest(level, anchor_price), 6) AS high, confirmed_ms AS opened_ms, closed_ms FROM tn WHERE type = 'BOS'""")
def dealing_ranges(s, d):
    return rounded(structure.dealing_ranges(structure.structure_events(structure.horizon(hourly(s, d)), 5, 5)).drop("event_ms", "level_ms"))


@query(f"""WITH RECURSIVE {sql.HOURLY}, {sql.breaks(5, 5)}, pv AS ({sql.pivots(5, 5, 'high')} UNION ALL {sql.pivots(5, 5, 'low')})
  SELECT pv.exchange, pv.symbol, kind, round(price, 6) AS price, pv.event_ms, pv.confirmed_ms, CASE WHEN be.type IS NULL THEN 'ACTIVE' ELSE 'CONSUMED' END AS state, be.confirmed_ms AS consumed_ms, be.type AS consumed_by
  FROM pv LEFT JOIN be ON be.exchange = pv.exchange AND be.symbol = pv.symbol AND be.type IN ('BOS', 'CHOCH') AND (be.dir = 'up') = (kind = 'high') AND be.level_ms = pv.event_ms""")
def structure_levels(s, d):
    rows = structure.horizon(hourly(s, d))
    return rounded(structure.structure_levels(structure.both_pivots(rows, 5, 5), structure.structure_events(rows, 5, 5)).drop("timeframe"))


@query()
def liquidity_levels(s, d):
    return zones.liquidity_levels(settled_rows(s, d), 5, 5)


LEVELS = f"""WITH RECURSIVE {sql.HOURLY}, {sql.recursive(sql.cut(500))}, pv AS ({sql.pivots(5, 5, 'high')} UNION ALL {sql.pivots(5, 5, 'low')}),
  lv AS (SELECT pv.*, i.rn AS created FROM pv JOIN i ON i.exchange = pv.exchange AND i.symbol = pv.symbol AND i.open_ms + 3600000 = pv.confirmed_ms),
  pr AS (SELECT lv.exchange, lv.symbol, lv.kind, lv.price, lv.event_ms, i.rn, i.open_ms + 3600000 AS at_ms, CASE WHEN (kind = 'high' AND i.close > price) OR (kind = 'low' AND i.close < price) THEN 'BROKEN'
    WHEN (kind = 'high' AND i.high >= price + 0.05 * atr14 AND i.close < price) OR (kind = 'low' AND i.low <= price - 0.05 * atr14 AND i.close > price) THEN 'SWEPT' WHEN i.rn - created >= 100 THEN 'EXPIRED' END AS what
    FROM lv JOIN i ON i.exchange = lv.exchange AND i.symbol = lv.symbol AND i.rn > lv.created),
  fin AS (SELECT * FROM pr WHERE what IS NOT NULL QUALIFY row_number() OVER (PARTITION BY exchange, symbol, kind, event_ms ORDER BY rn) = 1)
  SELECT lv.exchange, lv.symbol, CASE WHEN lv.kind = 'high' THEN 'BUY_SIDE' ELSE 'SELL_SIDE' END AS side, round(lv.price, 6) AS price, lv.event_ms, coalesce(what, 'OPEN') AS state, at_ms AS resolved_ms
  FROM lv LEFT JOIN fin ON fin.exchange = lv.exchange AND fin.symbol = lv.symbol AND fin.kind = lv.kind AND fin.event_ms = lv.event_ms"""


@query(LEVELS)
def liquidity_structural(s, d):
    levels = zones.liquidity_levels(settled_rows(s, d), 5, 5, age=100).where("origin = 'STRUCTURAL'")
    return rounded(levels.select("exchange", "symbol", "side", "price", "event_ms", "state", "resolved_ms"))


@query()
def order_blocks_internal(s, d):
    rows = settled_rows(s, d)
    return zones.order_blocks(rows, structure.structure_events(rows, 3, 3), structure.gaps(rows), zones.liquidity_levels(rows, 3, 3))


@query()
def structure_scores(s, d):
    return scoring.score_series(structure_rows(s, d))


# Decisions

TREND_SQL = """, t1 AS (SELECT exchange, symbol, open_ms, close, volume_ratio,
    CASE WHEN ema50 > ema200 AND close > ema50 THEN 30 ELSE 0 END + CASE WHEN ema20 > ema50 AND close > ema20 THEN 15 ELSE 0 END + CASE WHEN rsi14 BETWEEN 52 AND 72 THEN 20 ELSE 0 END + CASE WHEN macd_hist > 0 THEN 20 ELSE 0 END AS l,
    CASE WHEN ema50 < ema200 AND close < ema50 THEN 30 ELSE 0 END + CASE WHEN ema20 < ema50 AND close < ema20 THEN 15 ELSE 0 END + CASE WHEN rsi14 BETWEEN 28 AND 48 THEN 20 ELSE 0 END + CASE WHEN macd_hist < 0 THEN 20 ELSE 0 END AS s FROM i),
  t2 AS (SELECT exchange, symbol, open_ms, least(100, l + CASE WHEN l > s AND volume_ratio >= 1 THEN 15 ELSE 0 END) AS long_score, least(100, s + CASE WHEN s > l AND volume_ratio >= 1 THEN 15 ELSE 0 END) AS short_score FROM t1),
  t3 AS (SELECT *, CASE WHEN long_score >= 70 AND long_score > short_score THEN 'LONG' WHEN short_score >= 70 AND short_score > long_score THEN 'SHORT' ELSE 'NEUTRAL' END AS direction, greatest(long_score, short_score) AS score FROM t2)"""


@query(WITH_I + TREND_SQL + " SELECT * FROM t3")
def trend_score_history(s, d):
    return decision.trend_score(ind.with_indicators(hourly(s, d))).select("exchange", "symbol", "open_ms", "long_score", "short_score", "direction", "score")


@query(WITH_I300 + TREND_SQL + " SELECT t3.* FROM t3 JOIN i USING (exchange, symbol, open_ms) WHERE rn = n AND n >= 200")
def trend_score(s, d):
    return decision.trend_score(ind.snapshots(hourly(s, d))).select("exchange", "symbol", "open_ms", "long_score", "short_score", "direction", "score")


@query(WITH_I + TREND_SQL + """, v AS (SELECT symbol, open_ms, count(*) FILTER (direction = 'LONG') AS long_votes, count(*) FILTER (direction = 'SHORT') AS short_votes, count(*) FILTER (direction = 'NEUTRAL') AS neutral_votes, count(*) AS evaluated, 0::BIGINT AS skipped FROM t3 GROUP BY symbol, open_ms)
  SELECT *, long_votes >= 2 AND short_votes >= 2 AS conflict, CASE WHEN long_votes >= 2 AND short_votes >= 2 THEN 'NEUTRAL' WHEN long_votes >= 2 THEN 'LONG' WHEN short_votes >= 2 THEN 'SHORT' ELSE 'NEUTRAL' END AS direction,
    CASE WHEN long_votes >= 2 AND short_votes >= 2 THEN 'LONG ' || long_votes || '/' || evaluated || ' · SHORT ' || short_votes || '/' || evaluated WHEN long_votes >= 2 THEN long_votes || '/' || evaluated WHEN short_votes >= 2 THEN short_votes || '/' || evaluated ELSE greatest(long_votes, short_votes) || '/' || evaluated END AS confirmation FROM v""")
def exchange_vote(s, d):
    scored = decision.trend_score(ind.with_indicators(hourly(s, d))).withColumn("status", F.lit("evaluated"))
    return decision.vote(scored, ["symbol", "open_ms"], 2)


@query(WITH_1H + f""", g AS (SELECT symbol, open_ms, count(DISTINCT exchange) AS k FROM c WHERE closed GROUP BY symbol, open_ms), p AS (SELECT symbol, count(DISTINCT exchange) AS participants FROM c GROUP BY symbol),
  x AS (SELECT symbol, count(*) AS shared, max(open_ms) AS common_ms FROM g JOIN p USING (symbol) WHERE k = participants GROUP BY symbol), n AS (SELECT symbol, max(open_ms) AS newest_ms FROM g GROUP BY symbol),
  y AS (SELECT symbol AS asset, participants, coalesce(shared, 0) AS shared, common_ms, newest_ms, (newest_ms - common_ms) // {H} AS relative_lag, ((SELECT max((epoch_us(ts) // 1000)) FROM events) // {H} * {H} - {H} - common_ms) // {H} AS absolute_lag FROM p JOIN n USING (symbol) LEFT JOIN x USING (symbol))
  SELECT *, CASE WHEN common_ms IS NULL THEN 'no_common_horizon' WHEN relative_lag > 3 THEN 'relative_lag_stale' WHEN absolute_lag < 0 THEN 'future_horizon' WHEN absolute_lag > 1 THEN 'absolute_stale' ELSE 'ok' END AS status FROM y""")
def common_horizon(s, d):
    c = hourly(s, d).withColumnRenamed("symbol", "asset")
    return decision.common_horizon(c.select("asset", "exchange").distinct(), c, "1h", F.max("now_ms"), ["asset"], "exchange")


@query(WITH_ALL + "SELECT symbol, timeframe, count(*) AS evaluated, 0::BIGINT AS off_grid, count(DISTINCT open_ms) AS times, count(DISTINCT open_ms) = 1 AS safe FROM (SELECT timeframe, exchange, symbol, max(open_ms) AS open_ms FROM c WHERE closed AND timeframe = '1h' GROUP BY ALL) GROUP BY symbol, timeframe")
def candle_alignment(s, d):
    last = paging.latest_per_group(every(s, d).where("closed and timeframe = '1h'"), ind.SERIES, "open_ms").withColumn("status", F.lit("evaluated"))
    return decision.alignment(last, ["symbol", "timeframe"], "1h")


@query(WITH_1H + f"SELECT exchange, symbol, max(open_ms) AS last_ms, ((SELECT max((epoch_us(ts) // 1000)) FROM events) // {H} * {H} - {H} - max(open_ms)) // {H} AS bars_behind FROM c WHERE closed GROUP BY exchange, symbol")
def bars_behind_clock(s, d):
    now = bridge.events_now(events(s, d))
    last = hourly(s, d).where("closed").groupBy("exchange", "symbol").agg(F.max("open_ms").alias("last_ms")).crossJoin(F.broadcast(now))  # one row
    return last.select("exchange", "symbol", "last_ms", ((expected_latest_closed(F.col("now_ms"), H) - F.col("last_ms")) / H).cast("long").alias("bars_behind"))


CONFIG = {
    "minimumSignalScore": 70, "weights": {"trend": 30, "mediumTrend": 15, "rsi": 20, "macd": 20, "volume": 15}, "ema": {"fast": 20, "medium": 50, "slow": 200},
    "rsi": {"period": 14, "longMin": 52, "longMax": 72, "shortMin": 28, "shortMax": 48}, "macd": {"fast": 12, "slow": 26, "signal": 9}, "atr": {"period": 14, "stopMultiplier": 1.5, "takeProfit1Multiplier": 1.5, "takeProfit2Multiplier": 2.5, "takeProfit3Multiplier": 4},
    "volume": {"period": 20, "minimumRatio": 1}, "execution": {"closedCandleOnly": True, "cooldownCandles": 3}, "filters": {"minimumQuoteVolume24h": 500_000, "top500Only": True},
}


@query(f"""WITH RECURSIVE {sql.HOURLY}, {sql.MARKETS}, {sql.recursive(sql.cut(300))} {TREND_SQL}, t AS (SELECT t3.* FROM t3 JOIN i USING (exchange, symbol, open_ms) WHERE rn = n AND n >= 200),
  y AS (SELECT m.exchange, m.symbol, coalesce(quote_volume, 0) < 500000 AS thin, direction, long_score, short_score FROM m LEFT JOIN t USING (exchange, symbol))
  SELECT exchange, symbol, CASE WHEN thin THEN 'filtered' WHEN direction IS NULL THEN 'no-snapshot' ELSE 'evaluated' END AS status, CASE WHEN thin THEN 'volume' END AS reason,
    CASE WHEN NOT thin THEN direction END AS direction, CASE WHEN NOT thin THEN long_score END AS long_score, CASE WHEN NOT thin THEN short_score END AS short_score FROM y""")
def strategy_results(s, d):
    m, c = markets(s, d), hourly(s, d)
    ranked = m.join(reports.ranked_assets(m).select(F.col("symbol").alias("base"), "rank"), "base", "left")
    out = decision.strategy_results(ranked, ind.snapshots(c), c, CONFIG, evaluation.evaluate_custom)
    return out.select("exchange", "symbol", "status", "reason", "direction", "long_score", "short_score")


@query()
def structure_reasons(s, d):
    return scoring.reasons(scoring.score_series(structure_rows(s, d)))


CUSTOM = {"ema": (10, 30, 100), "rsi": 7, "macd": (6, 13, 5), "atr": 10, "volume": 10}


@query(f"WITH RECURSIVE {sql.HOURLY}, {sql.recursive(sql.cut(300), CUSTOM)} {TREND_SQL} SELECT t3.exchange, t3.symbol, '1h' AS timeframe, t3.open_ms, 'evaluated' AS status, NULL::VARCHAR AS reason, long_score, short_score, direction FROM t3 JOIN i USING (exchange, symbol, open_ms) WHERE rn = n AND n >= 200")
def trend_score_custom_periods(s, d):
    c = hourly(s, d)
    return evaluation.evaluate_custom(ind.snapshots(c), c, CUSTOM)


@query()
def structure_at_common_horizon(s, d):
    return evaluation.structure_at_horizon(hourly(s, d), "1h", F.max("now_ms"), ["symbol"])


@query()
def structure_overlay(s, d):
    return evaluation.overlay(structure_rows(s, d))


@query("""SELECT seq, ts, level, CASE WHEN m LIKE '[%' AND regexp_extract(m, '^\\[([^\\]]{1,40})\\]', 1) <> '' THEN regexp_extract(m, '^\\[([^\\]]{1,40})\\]', 1) ELSE 'app' END AS source, m AS message FROM (
  SELECT event_id AS seq, (epoch_us(ts) // 1000) AS ts, upper(event_type) AS level, '[' || event_type || '] user ' || user_id || ' ' || props AS m FROM events ORDER BY event_id DESC LIMIT 500)""")
def journal_entries(s, d):
    text = F.concat(F.lit("[ "), "event_type", F.lit("]  user "), F.col("user_id").cast("string"), F.lit("\n"), "props")
    lines = events(s, d).select(F.col("event_id").alias("seq"), bridge.epoch_ms("ts").alias("ts"), F.upper("event_type").alias("level"), F.regexp_replace(text, r"\[ ", "[").alias("message"))
    return journal.journal(lines)
