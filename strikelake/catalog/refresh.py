"""Refresh-job tables, decision features and the streaming forms, each equal to its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelake.catalog import register
from strikelake.catalog.timeseries import DAILY, HOURLY, r6
from strikelake.functions.scalar import round_half_up as r
from strikelake.operators import bars
from strikelake.plans import decision_features as DF, market_refresh as MR
from strikelake.session import scratch_path
from strikelake.sources.tables import DIM_MARKET, TICKS, dim_market, load, ticks
from strikelake.streaming import ticks as ST
from strikelake.streaming.state import KeyedTable, newer_only_sink, newest_sink

# Daily benchmark rows per contract, made at 21:00 UTC (16:00 in New York in January).
BENCH = """bench AS (SELECT DISTINCT d.ticker, d.threshold, d.expiry_date, CAST(e.ts AS DATE) AS snapshot_date, CAST(CAST(e.ts AS DATE) AS TIMESTAMP) + INTERVAL 21 HOUR AS asof_time,
  max(e.value) OVER (PARTITION BY d.ticker, d.threshold, d.expiry_date, CAST(e.ts AS DATE)) / 512.0::DOUBLE AS prn FROM events e JOIN dim_market d ON d.market_id = e.user_id WHERE e.event_type IN ('error', 'signup'))"""


def benchmark(spark, d):
    e = load(spark, d, "events").where(F.col("event_type").isin("error", "signup")).withColumnRenamed("user_id", "market_id")
    rows = e.join(dim_market(spark, d), "market_id")
    day = F.to_date("ts").alias("snapshot_date")
    out = rows.groupBy("ticker", "threshold", "expiry_date", day).agg((F.max("value") / 512.0).alias("pRN"))
    return out.withColumn("asof_time", F.timestamp_micros(F.unix_micros(F.col("snapshot_date").cast("timestamp")) + 75_600_000_000))


def dims(spark, d):
    end = F.timestamp_micros(F.unix_micros(F.col("expiry_date").cast("timestamp")) + 86_399_000_000)
    return dim_market(spark, d).withColumn("resolution_time_utc", end)


@register(
    "decision_features",
    TICKS,
    DIM_MARKET,
    DAILY,
    BENCH,
    """f1 AS (SELECT *, lag(close) OVER w AS pm_last, close / nullif(lag(close) OVER w, 0) - 1 AS ret,
  CASE WHEN close / nullif(lag(close) OVER w, 0) > 0 THEN ln(close / nullif(lag(close) OVER w, 0)) END AS lr FROM daily WINDOW w AS (PARTITION BY market_id ORDER BY d))""",
    "f2 AS (SELECT *, CASE WHEN count(lr) OVER t >= 3 THEN stddev_samp(lr) OVER t END AS vol FROM f1 WINDOW t AS (PARTITION BY market_id ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))",
    "f3 AS (SELECT *, lag(ret) OVER w AS mom, lag(vol) OVER w AS pv FROM f2 WINDOW w AS (PARTITION BY market_id ORDER BY d))",
    sql=f"""SELECT f.market_id, f.d AS decision_date, f.pm_last, {r6('f.mom')} AS pm_momentum_1d, {r6('f.pv')} AS pm_volatility, b.prn AS "pRN",
  {r6("(epoch_us(CAST(m.expiry_date AS TIMESTAMP)) + 86399000000 - epoch_us(CAST(f.d AS TIMESTAMP)) - 75601000000) / 1000000.0::DOUBLE / 86400.0::DOUBLE")} AS pm_time_to_resolution, true AS leak_check_passed
  FROM f3 f JOIN dim_market m USING (market_id) JOIN bench b ON b.ticker = m.ticker AND b.threshold = m.threshold AND b.expiry_date = m.expiry_date AND b.snapshot_date = f.d""",
)
def decision_features(spark, d):
    daily = bars.ohlc(ticks(spark, d), "1d", fill_gaps=False)
    out = DF.decision_features(daily, dims(spark, d), benchmark(spark, d), vol_window=10, vol_min=3)
    return out.select(
        "market_id", "decision_date", "pm_last", r(F.col("pm_momentum_1d"), 6).alias("pm_momentum_1d"), r(F.col("pm_volatility"), 6).alias("pm_volatility"),
        "pRN", r(F.col("pm_time_to_resolution"), 6).alias("pm_time_to_resolution"), "leak_check_passed",
    )


HOURTAB = (
    TICKS,
    DIM_MARKET,
    BENCH,
    """spine AS (SELECT market_id, ticker, threshold, expiry_date, unnest(generate_series(TIMESTAMP '2024-01-08 00:00:00',
    least(CAST(expiry_date AS TIMESTAMP) + INTERVAL 86399 SECOND, TIMESTAMP '2024-01-18 15:00:00'), INTERVAL 1 HOUR)) AS h FROM dim_market)""",
    "px AS (SELECT market_id, timestamp_utc AS ts, max_by(price, event_id) AS price FROM ticks WHERE token_role = 'yes' GROUP BY 1, 2)",
    "a AS (SELECT s.*, p.price FROM spine s ASOF LEFT JOIN px p ON s.market_id = p.market_id AND s.h >= p.ts)",
    """j AS (SELECT a.*, b.prn, b.asof_time FROM a ASOF LEFT JOIN bench b ON a.ticker = b.ticker AND a.threshold = b.threshold AND a.expiry_date = b.expiry_date AND a.h >= b.asof_time)""",
)


def _hourly(spark, d):
    at = lambda x: F.lit(x).cast("timestamp")
    return MR.hourly_market_table(
        dims(spark, d), ticks(spark, d), benchmark(spark, d).drop("snapshot_date"), at("2024-01-08"), at("2024-01-18 15:00:00")
    )


@register(
    "hourly_market_table",
    *HOURTAB,
    sql="""SELECT market_id, epoch_us(h) AS timestamp_utc, price AS pm_ask, price * (1 - 0.005::DOUBLE) AS pm_bid, prn AS "pRN", epoch_us(asof_time) AS prn_asof_time FROM j""",
)
def hourly_market_table(spark, d):
    return _hourly(spark, d).select(
        "market_id", F.unix_micros("timestamp_utc").alias("timestamp_utc"), "pm_ask", "pm_bid", "pRN",
        F.unix_micros("prn_asof_time").alias("prn_asof_time"),
    )


@register(
    "market_series_by_strike",
    *HOURTAB,
    "w AS (SELECT *, CAST(CAST(h AS DATE) - CAST(isodow(h) - 5 AS INT) AS DATE) AS wf FROM j)",
    sql="""SELECT ticker, threshold, wf AS week_friday, market_id, count(*) AS points, arg_min(price, h) AS first_ask, arg_max(prn, h) AS last_prn FROM (SELECT * FROM w) GROUP BY 1, 2, 3, 4""",
)
def market_series_by_strike(spark, d):
    s = MR.market_series(_hourly(spark, d))
    known = F.filter("points", lambda p: p["pRN"].isNotNull())
    asked = F.filter("points", lambda p: p["pm_ask"].isNotNull())
    return s.select(
        "ticker", "threshold", "week_friday", "market_id", F.size("points").cast("bigint").alias("points"),
        F.try_element_at(asked, F.lit(1))["pm_ask"].alias("first_ask"), F.try_element_at(known, F.lit(-1))["pRN"].alias("last_prn"),
    )


@register(
    "daily_market_snapshot",
    TICKS,
    DIM_MARKET,
    BENCH,
    "first_m AS (SELECT ticker, threshold, expiry_date, min(market_id) AS market_id FROM dim_market GROUP BY 1, 2, 3)",
    "b AS (SELECT * FROM bench JOIN first_m USING (ticker, threshold, expiry_date) WHERE snapshot_date = DATE '2024-01-19')",
    "l AS (SELECT market_id, token_role, max_by(price, (timestamp_utc, event_id)) AS p FROM ticks WHERE timestamp_utc <= TIMESTAMP '2024-01-19 21:00:00' GROUP BY 1, 2)",
    "v AS (SELECT market_id, max(CASE WHEN token_role = 'yes' THEN p END) AS y, max(CASE WHEN token_role = 'no' THEN p END) AS n FROM l GROUP BY 1)",
    sql="""SELECT b.market_id, b.prn AS "pRN", v.y AS "pPM_buy", v.n AS "qPM_buy", v.y IS NOT NULL OR v.n IS NOT NULL AS pm_ok, epoch_us(TIMESTAMP '2024-01-19 21:00:00') AS snapshot_time_utc
  FROM b LEFT JOIN v USING (market_id)""",
)
def daily_market_snapshot(spark, d):
    # Sunday the 21st: the last completed close is Friday the 19th.
    now = F.lit("2024-01-21 15:00:00").cast("timestamp")
    out = MR.daily_snapshot(dims(spark, d), ticks(spark, d), benchmark(spark, d), now)
    return out.select("market_id", "pRN", "pPM_buy", "qPM_buy", "pm_ok", F.unix_micros("snapshot_time_utc").alias("snapshot_time_utc"))


# --- streams --------------------------------------------------------------------------------------


def tick_stream(spark, d):
    e = ST.read_stream(spark, f"{d}/events.parquet")
    return e.select(
        "event_id", F.col("user_id").alias("market_id"), F.col("ts").alias("timestamp_utc"), (F.least("value", F.lit(400.0)) / 400.0).alias("price"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), "yes").otherwise("no").alias("token_role"),
        F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("ticker"), ((F.col("user_id") % 20) * 5).cast("double").alias("threshold"),
    )


@register(
    "stream_hourly_bars",
    TICKS,
    HOURLY,
    sql="SELECT market_id, epoch_us(h) AS timestamp_utc, open, high, low, close FROM hourly",
)
def stream_hourly_bars(spark, d):
    path, ck = scratch_path(spark, "stream"), scratch_path(spark, "ck")
    rows, table = ST.bars(tick_stream(spark, d)), KeyedTable(path, ("market_id", "timestamp_utc"), 16)
    ST.run_available(rows, newest_sink(table), ck)
    out = table.read(spark, rows.schema)
    return out.select("market_id", F.unix_micros("timestamp_utc").alias("timestamp_utc"), "open", "high", "low", "close")


@register(
    "stream_cleaned_ticks",
    TICKS,
    sql="SELECT DISTINCT market_id, token_role, epoch_us(timestamp_utc) AS timestamp_utc FROM ticks WHERE price BETWEEN 0 AND 1",
)
def stream_cleaned_ticks(spark, d):
    path, ck = scratch_path(spark, "stream"), scratch_path(spark, "ck")
    ST.run_available(ST.clean(tick_stream(spark, d), ["market_id", "token_role"]), ST.version_sink(path), ck, "append")
    return spark.read.parquet(path).select("market_id", "token_role", F.unix_micros("timestamp_utc").alias("timestamp_utc"))


@register(
    "stream_benchmark_enrichment",
    TICKS,
    DIM_MARKET,
    BENCH,
    "bb AS (SELECT ticker, threshold, asof_time, max(prn) AS prn FROM bench GROUP BY 1, 2, 3)",
    sql="""SELECT t.event_id, b.prn AS "pRN", epoch_us(b.asof_time) AS asof_time FROM ticks t ASOF LEFT JOIN bb b ON t.ticker = b.ticker AND t.threshold = b.threshold AND t.timestamp_utc > b.asof_time""",
)
def stream_benchmark_enrichment(spark, d):
    path, ck = scratch_path(spark, "stream"), scratch_path(spark, "ck")
    daily = benchmark(spark, d).groupBy("ticker", "threshold", "asof_time").agg(F.max("pRN").alias("pRN"))
    spans = ST.validity(daily, ["ticker", "threshold"], "asof_time", F.lit("2024-02-05").cast("timestamp"))
    ST.run_available(ST.enrich(tick_stream(spark, d), spans, ["ticker", "threshold"], ["pRN"]), ST.version_sink(path), ck, "append")
    return spark.read.parquet(path).select("event_id", "pRN", F.unix_micros("asof_time").alias("asof_time"))


@register(
    "stream_append_newer",
    TICKS,
    "stored AS (SELECT market_id, max(timestamp_utc) AS m FROM ticks WHERE event_id % 4 = 0 GROUP BY 1)",
    sql="SELECT t.event_id FROM ticks t LEFT JOIN stored s USING (market_id) WHERE s.m IS NULL OR t.timestamp_utc > s.m",
)
def stream_append_newer(spark, d):
    path, ck = scratch_path(spark, "stream"), scratch_path(spark, "ck")
    seed = ticks(spark, d).where(F.col("event_id") % 4 == 0).select("market_id", "timestamp_utc")
    marks = KeyedTable(scratch_path(spark, "marks"), ("market_id",), 16)
    ST.run_available(tick_stream(spark, d), newer_only_sink(path, marks, seed=seed), ck, "append")
    return spark.read.parquet(path).select("event_id")


@register(
    "stream_snapshot_upsert",
    TICKS,
    sql="""SELECT market_id, CAST(timestamp_utc AS DATE) AS day, max(event_id) AS event_id, max_by(price, event_id) AS price FROM ticks GROUP BY 1, 2""",
)
def stream_snapshot_upsert(spark, d):
    path, ck = scratch_path(spark, "stream"), scratch_path(spark, "ck")
    rows = tick_stream(spark, d).select("market_id", F.to_date("timestamp_utc").alias("day"), "event_id", "price")
    table = KeyedTable(path, ("market_id", "day"), 16)
    ST.run_available(rows, newest_sink(table, ["event_id"]), ck, "append")
    return table.read(spark, rows.schema)


@register(
    "stream_leak_quarantine",
    TICKS,
    sql="""SELECT CASE WHEN timestamp_utc <= TIMESTAMP '2024-01-20 00:00:00' THEN 'kept' ELSE 'quarantined' END AS outcome, count(*) AS n FROM ticks GROUP BY 1""",
)
def stream_leak_quarantine(spark, d):
    good, bad, ck = scratch_path(spark, "good"), scratch_path(spark, "bad"), scratch_path(spark, "ck")
    ok = F.col("timestamp_utc") <= F.lit("2024-01-20").cast("timestamp")
    ST.run_available(tick_stream(spark, d).select("event_id", "timestamp_utc"), ST.quarantine_sink(good, bad, ok), ck, "append")
    part = lambda path, name: spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(name).alias("outcome"), "n")
    return part(good, "kept").unionByName(part(bad, "quarantined"))
