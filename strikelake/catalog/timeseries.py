"""Ticks, bars, features, as-of joins and spines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strikelake.catalog import register
from strikelake.functions.scalar import round_half_up as r
from strikelake.operators import asof, bars
from strikelake.sources.tables import CLOSES, DIM_MARKET, TICKS, closes, dim_market, load, ticks


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"


def micros(name: str):
    return F.unix_micros(F.col(name)).alias(name)


DAILY = """daily AS (
SELECT market_id, CAST(timestamp_utc AS DATE) AS d, arg_min(price, (timestamp_utc, event_id)) AS open,
       max(price) AS high, min(price) AS low, arg_max(price, (timestamp_utc, event_id)) AS close
FROM ticks GROUP BY 1, 2)"""
HOURLY = """hourly AS (
SELECT market_id, date_trunc('hour', timestamp_utc) AS h, arg_min(price, (timestamp_utc, event_id)) AS open,
       max(price) AS high, min(price) AS low, arg_max(price, (timestamp_utc, event_id)) AS close
FROM ticks GROUP BY 1, 2)"""


@register(
    "tick_daily_features",
    TICKS,
    DAILY,
    """feats AS (
SELECT *, lag(close) OVER w AS pm_last, lag(d) OVER w AS pm_last_day,
       close / nullif(lag(close) OVER w, 0) - 1 AS ret, CASE WHEN close / nullif(lag(close) OVER w, 0) > 0
       THEN ln(close / nullif(lag(close) OVER w, 0)) END AS log_ret
FROM daily WINDOW w AS (PARTITION BY market_id ORDER BY d))""",
    """vols AS (
SELECT *, CASE WHEN count(log_ret) OVER t >= 3 THEN stddev_samp(log_ret) OVER t END AS vol
FROM feats WINDOW t AS (PARTITION BY market_id ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""",
    sql=f"""SELECT market_id, d AS day, open, high, low, close, pm_last, pm_last_day,
 {r6('lag(ret) OVER w')} AS pm_momentum, {r6('lag(vol) OVER w')} AS pm_volatility
FROM vols WINDOW w AS (PARTITION BY market_id ORDER BY d)""",
)
def tick_daily_features(spark: SparkSession, d: str) -> DataFrame:
    daily = bars.ohlc(ticks(spark, d), "1d", fill_gaps=False)
    out = bars.bar_features(daily, vol_window=10, vol_min=3)
    return out.select(
        "market_id",
        F.to_date("timestamp_utc").alias("day"),
        "open",
        "high",
        "low",
        "close",
        "pm_last",
        F.to_date("pm_last_time").alias("pm_last_day"),
        r(F.col("pm_momentum_1h"), 6).alias("pm_momentum"),
        r(F.col("pm_volatility"), 6).alias("pm_volatility"),
    )


@register(
    "ohlc_bars_hourly",
    TICKS,
    HOURLY,
    "span AS (SELECT market_id, min(h) AS lo, max(h) AS hi FROM hourly GROUP BY 1)",
    "grid AS (SELECT market_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS h FROM span)",
    sql="""SELECT epoch_us(g.h) AS timestamp_utc, g.market_id, b.open, b.high, b.low, b.close
FROM grid g LEFT JOIN hourly b ON g.market_id = b.market_id AND g.h = b.h""",
)
def ohlc_bars_hourly(spark, d):
    return bars.ohlc(ticks(spark, d), "1h").select(
        micros("timestamp_utc"), "market_id", "open", "high", "low", "close"
    )


@register(
    "ohlc_bars_daily",
    TICKS,
    DAILY,
    "span AS (SELECT market_id, min(d) AS lo, max(d) AS hi FROM daily GROUP BY 1)",
    "grid AS (SELECT market_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span)",
    sql="""SELECT g.d AS day, g.market_id, b.open, b.high, b.low, b.close
FROM grid g LEFT JOIN daily b ON g.market_id = b.market_id AND g.d = b.d""",
)
def ohlc_bars_daily(spark, d):
    return bars.ohlc(ticks(spark, d), "1d").select(
        F.to_date("timestamp_utc").alias("day"), "market_id", "open", "high", "low", "close"
    )


@register(
    "lagged_hourly_features",
    TICKS,
    HOURLY,
    """f1 AS (SELECT *, lag(close) OVER w AS pm_last, epoch_us(lag(h) OVER w) AS pm_last_time,
  close / nullif(lag(close) OVER w, 0) - 1 AS ret,
  CASE WHEN close / nullif(lag(close) OVER w, 0) > 0 THEN ln(close / nullif(lag(close) OVER w, 0)) END AS lr
  FROM hourly WINDOW w AS (PARTITION BY market_id ORDER BY h))""",
    """f2 AS (SELECT *, CASE WHEN count(lr) OVER t >= 4 THEN stddev_samp(lr) OVER t END AS vol
  FROM f1 WINDOW t AS (PARTITION BY market_id ORDER BY h ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""",
    sql=f"""SELECT market_id, epoch_us(h) AS timestamp_utc, pm_last, pm_last_time,
 CASE WHEN pm_last IS NOT NULL THEN least(greatest(pm_last * (1 - 0.005::DOUBLE), 0), 1) END AS pm_bid,
 CASE WHEN pm_last IS NOT NULL THEN least(greatest(pm_last * (1 + 0.005::DOUBLE), 0), 1) END AS pm_ask,
 {r6('lag(ret) OVER w')} AS pm_momentum_1h, {r6('lag(vol) OVER w')} AS pm_volatility
FROM f2 WINDOW w AS (PARTITION BY market_id ORDER BY h)""",
)
def lagged_hourly_features(spark, d):
    f = bars.bar_features(bars.ohlc(ticks(spark, d), "1h", fill_gaps=False), vol_window=12, vol_min=4)
    return f.select(
        "market_id",
        micros("timestamp_utc"),
        "pm_last",
        micros("pm_last_time"),
        "pm_bid",
        "pm_ask",
        r(F.col("pm_momentum_1h"), 6).alias("pm_momentum_1h"),
        r(F.col("pm_volatility"), 6).alias("pm_volatility"),
    )


@register(
    "momentum_five_minute",
    TICKS,
    """fives AS (SELECT market_id, time_bucket(INTERVAL 5 MINUTE, timestamp_utc) AS b,
  arg_max(price, (timestamp_utc, event_id)) AS close FROM ticks GROUP BY 1, 2)""",
    """rets AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, lag(b) OVER w AS pb
  FROM fives WINDOW w AS (PARTITION BY market_id ORDER BY b))""",
    sql=f"""SELECT market_id, epoch_us(b) AS timestamp_utc, {r6('lag(ret) OVER w')} AS pm_momentum_5m,
  epoch_us(pb) AS pm_momentum_5m_time FROM rets WINDOW w AS (PARTITION BY market_id ORDER BY b)""",
)
def momentum_five_minute(spark, d):
    m = bars.momentum(bars.ohlc(ticks(spark, d), "5m", fill_gaps=False), "pm_momentum_5m")
    return m.select(
        "market_id", micros("timestamp_utc"), r(F.col("pm_momentum_5m"), 6).alias("pm_momentum_5m"),
        micros("pm_momentum_5m_time"),
    )


@register(
    "last_bar_per_day",
    TICKS,
    HOURLY,
    """lastbar AS (SELECT market_id, CAST(h AS DATE) AS day, max(h) AS h, arg_max(close, h) AS close
  FROM hourly GROUP BY 1, 2)""",
    """rets AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, lag(h) OVER w AS ph
  FROM lastbar WINDOW w AS (PARTITION BY market_id ORDER BY h))""",
    sql=f"""SELECT market_id, day, epoch_us(h) AS timestamp_utc, close, {r6('lag(ret) OVER w')} AS pm_momentum_1d,
  epoch_us(ph) AS pm_momentum_1d_time FROM rets WINDOW w AS (PARTITION BY market_id ORDER BY h)""",
)
def last_bar_per_day(spark, d):
    daily = bars.last_bar_per_day(bars.ohlc(ticks(spark, d), "1h", fill_gaps=False))
    return bars.momentum(daily, "pm_momentum_1d").select(
        "market_id", F.col("date").alias("day"), micros("timestamp_utc"), "close",
        r(F.col("pm_momentum_1d"), 6).alias("pm_momentum_1d"), micros("pm_momentum_1d_time"),
    )


SINGLE = """single AS (SELECT market_id, timestamp_utc, max(event_id) AS event_id, arg_max(price, event_id) AS price
  FROM ticks GROUP BY 1, 2)"""


@register(
    "despiked_prices",
    TICKS,
    SINGLE,
    """nb AS (SELECT *, lag(price) OVER w AS pp, lead(price) OVER w AS np FROM single
  WINDOW w AS (PARTITION BY market_id ORDER BY timestamp_utc))""",
    """sp AS (SELECT *, coalesce(abs(price - pp) >= 0.15::DOUBLE AND abs(price - np) >= 0.15::DOUBLE
  AND abs(np - pp) <= 0.05::DOUBLE, false) AS hit FROM nb)""",
    sql="""SELECT market_id, event_id, price AS price_raw, hit AS despiked,
  CASE WHEN hit THEN (pp + np) * 0.5::DOUBLE ELSE price END AS price FROM sp""",
)
def despiked_prices(spark, d):
    return bars.despike(ticks(spark, d), 0.15, 0.05).select("market_id", "event_id", "price_raw", "despiked", "price")


@register(
    "downsampled_series",
    TICKS,
    """b AS (SELECT market_id, min(epoch_us(timestamp_utc)) AS lo, max(epoch_us(timestamp_utc)) AS hi, count(*) AS n
  FROM ticks GROUP BY 1)""",
    """k AS (SELECT t.market_id, t.event_id, t.price, epoch_us(t.timestamp_utc) AS us, n,
  CASE WHEN n > 20 THEN floor((epoch_us(t.timestamp_utc) - lo) / ((hi - lo) / 20.0::DOUBLE)) ELSE t.event_id + 100 END AS bucket
  FROM ticks t JOIN b USING (market_id))""",
    sql="""SELECT market_id, max_by(event_id, (us, event_id)) AS event_id, max_by(price, (us, event_id)) AS price
  FROM k GROUP BY market_id, bucket""",
)
def downsampled_series(spark, d):
    return bars.downsample(ticks(spark, d), 20, ["market_id"], tiebreak=["event_id"]).select(
        "market_id", "event_id", "price"
    )


@register(
    "last_price_at_cutoff",
    TICKS,
    sql="""SELECT market_id, token_role, max_by(event_id, (timestamp_utc, event_id)) AS event_id,
  max_by(price, (timestamp_utc, event_id)) AS price FROM ticks
  WHERE timestamp_utc <= TIMESTAMP '2024-01-20 21:00:00' GROUP BY 1, 2""",
)
def last_price_at_cutoff(spark, d):
    cut = F.lit("2024-01-20 21:00:00").cast("timestamp")
    out = bars.last_at_or_before(ticks(spark, d), cut, ["market_id", "token_role"], tiebreak=["event_id"])
    return out.select("market_id", "token_role", "event_id", "price")


# Hour-truncated times on both sides make exact ties common.
ASOF_SIDES = (
    TICKS,
    """buys AS (SELECT event_id, market_id, date_trunc('hour', timestamp_utc) AS ts FROM ticks WHERE event_type = 'purchase')""",
    """views AS (SELECT market_id, date_trunc('hour', timestamp_utc) AS ts, max_by(price, event_id) AS price
  FROM ticks WHERE event_type = 'view' GROUP BY 1, 2)""",
)


def _sides(spark, d):
    t = ticks(spark, d).withColumn("ts", F.date_trunc("hour", "timestamp_utc"))
    buys = t.where(F.col("event_type") == "purchase").select("event_id", "market_id", "ts")
    views = t.where(F.col("event_type") == "view").select("market_id", "ts", "price", "event_id")
    return buys, views.withColumnRenamed("event_id", "view_id")


def _asof(spark, d, **kw):
    buys, views = _sides(spark, d)
    out = asof.asof_join(buys, views, ["market_id"], "ts", "ts", ["price"], tiebreak=["view_id"], **kw)
    return out.select("event_id", "market_id", micros("matched_ts"), "price")


@register(
    "asof_backward_exact",
    *ASOF_SIDES,
    sql="""SELECT b.event_id, b.market_id, epoch_us(v.ts) AS matched_ts, v.price
  FROM buys b ASOF LEFT JOIN views v ON b.market_id = v.market_id AND b.ts >= v.ts""",
)
def asof_backward_exact(spark, d):
    return _asof(spark, d)


@register(
    "asof_backward_strict",
    *ASOF_SIDES,
    sql="""SELECT b.event_id, b.market_id, epoch_us(v.ts) AS matched_ts, v.price
  FROM buys b ASOF LEFT JOIN views v ON b.market_id = v.market_id AND b.ts > v.ts""",
)
def asof_backward_strict(spark, d):
    return _asof(spark, d, exact=False)


@register(
    "asof_nearest",
    TICKS,
    "buys AS (SELECT event_id, market_id, timestamp_utc AS ts FROM ticks WHERE event_type = 'purchase')",
    """views AS (SELECT market_id, timestamp_utc AS ts, max_by(price, event_id) AS price
  FROM ticks WHERE event_type = 'view' GROUP BY 1, 2)""",
    """bk AS (SELECT b.*, v.ts AS bts, v.price AS bp FROM buys b ASOF LEFT JOIN views v ON b.market_id = v.market_id AND b.ts >= v.ts)""",
    """fw AS (SELECT b.*, v.ts AS fts, v.price AS fp FROM bk b ASOF LEFT JOIN views v ON b.market_id = v.market_id AND b.ts <= v.ts)""",
    sql="""SELECT event_id, market_id,
  epoch_us(CASE WHEN bts IS NOT NULL AND (fts IS NULL OR epoch_us(ts) - epoch_us(bts) <= epoch_us(fts) - epoch_us(ts)) THEN bts ELSE fts END) AS matched_ts,
  CASE WHEN bts IS NOT NULL AND (fts IS NULL OR epoch_us(ts) - epoch_us(bts) <= epoch_us(fts) - epoch_us(ts)) THEN bp ELSE fp END AS price FROM fw""",
)
def asof_nearest(spark, d):
    t = ticks(spark, d).withColumnRenamed("timestamp_utc", "ts")
    buys = t.where(F.col("event_type") == "purchase").select("event_id", "market_id", "ts")
    views = t.where(F.col("event_type") == "view").select("market_id", "ts", "price", F.col("event_id").alias("view_id"))
    out = asof.asof_join(
        buys, views, ["market_id"], "ts", "ts", ["price"], tiebreak=["view_id"], direction="nearest"
    )
    return out.select("event_id", "market_id", micros("matched_ts"), "price")


@register(
    "hourly_price_spine",
    TICKS,
    DIM_MARKET,
    """spine AS (SELECT market_id, unnest(generate_series(TIMESTAMP '2024-01-02 00:00:00',
    least(CAST(expiry_date AS TIMESTAMP) + INTERVAL 86399 SECOND, TIMESTAMP '2024-01-19 21:30:00'), INTERVAL 1 HOUR)) AS h FROM dim_market)""",
    """px AS (SELECT market_id, timestamp_utc AS ts, max_by(price, event_id) AS price FROM ticks
    WHERE token_role = 'yes' GROUP BY 1, 2)""",
    sql="""SELECT s.market_id, epoch_us(s.h) AS timestamp_utc, epoch_us(p.ts) AS price_time, p.price
  FROM spine s ASOF LEFT JOIN px p ON s.market_id = p.market_id AND s.h >= p.ts""",
)
def hourly_price_spine(spark, d):
    end = F.timestamp_micros(F.unix_micros(F.col("expiry_date").cast("timestamp")) + 86_399_000_000)
    series = bars.hourly_series(
        dim_market(spark, d).select("market_id", F.least(end, F.lit("2024-01-19 21:30:00").cast("timestamp")).alias("_end")),
        ticks(spark, d).where(F.col("token_role") == "yes"),
        F.lit("2024-01-02 00:00:00").cast("timestamp"),
        F.col("_end"),
    )
    return series.select("market_id", micros("timestamp_utc"), micros("price_time"), "price")


@register(
    "high_water_marks",
    TICKS,
    sql="""SELECT market_id, token_role, epoch_us(max(timestamp_utc)) AS last_ts,
 epoch_us(greatest(max(timestamp_utc) + INTERVAL 1 SECOND, TIMESTAMP '2024-01-22 00:00:00')) AS fetch_from
 FROM ticks GROUP BY 1, 2""",
)
def high_water_marks(spark, d):
    t = ticks(spark, d)
    roles = t.select("market_id", "token_role").distinct()
    out = bars.resume_points(roles, t, F.lit("2024-01-22 00:00:00").cast("timestamp"))
    return out.select("market_id", "token_role", micros("last_ts"), micros("fetch_from"))


@register(
    "append_only_newer",
    TICKS,
    "stored AS (SELECT market_id, max(timestamp_utc) AS m FROM ticks WHERE event_id % 3 = 0 GROUP BY 1)",
    sql="""SELECT t.event_id, t.market_id FROM ticks t LEFT JOIN stored s ON t.market_id = s.market_id
  WHERE t.event_id % 3 <> 0 AND (s.m IS NULL OR t.timestamp_utc > s.m)""",
)
def append_only_newer(spark, d):
    t = ticks(spark, d)
    stored, incoming = t.where(F.col("event_id") % 3 == 0), t.where(F.col("event_id") % 3 != 0)
    return bars.newer_than_stored(incoming, stored, ["market_id"]).select("event_id", "market_id")


@register(
    "replace_range_append",
    TICKS,
    DAILY,
    """stored AS (SELECT market_id, d, close, 0 AS src FROM daily
  WHERE NOT (d BETWEEN DATE '2024-01-10' AND DATE '2024-01-15'))""",
    "fresh AS (SELECT market_id, d, open AS close, 1 AS src FROM daily WHERE d >= DATE '2024-01-12')",
    "u AS (SELECT * FROM stored UNION ALL SELECT * FROM fresh)",
    sql="SELECT market_id, d AS day, max_by(close, src) AS close FROM u GROUP BY 1, 2",
)
def replace_range_append(spark, d):
    daily = bars.ohlc(ticks(spark, d), "1d", fill_gaps=False).withColumn("day", F.to_date("timestamp_utc"))
    fresh = daily.where(F.col("day") >= F.lit("2024-01-12")).select("market_id", "day", F.col("open").alias("close"))
    lo, hi = F.lit("2024-01-10").cast("date"), F.lit("2024-01-15").cast("date")
    return bars.replace_range(daily.select("market_id", "day", "close"), fresh, ["market_id", "day"], F.col("day"), lo, hi)


@register(
    "decision_time_view",
    TICKS,
    HOURLY,
    sql="""SELECT market_id, epoch_us(h) AS timestamp_utc, close FROM hourly
  WHERE h >= TIMESTAMP '2024-01-05 00:00:00' AND h <= TIMESTAMP '2024-01-09 12:00:00'""",
)
def decision_time_view(spark, d):
    b = bars.ohlc(ticks(spark, d), "1h", fill_gaps=False)
    return time_view(b, "2024-01-05 00:00:00", "2024-01-09 12:00:00").select("market_id", micros("timestamp_utc"), "close")


def time_view(df: DataFrame, time_min: str | None, time_max: str | None, history: bool = False) -> DataFrame:
    """Decision view hides everything after `time_max`; the history view ignores that bound."""
    if time_min:
        df = df.where(F.col("timestamp_utc") >= F.lit(time_min).cast("timestamp"))
    if time_max and not history:
        df = df.where(F.col("timestamp_utc") <= F.lit(time_max).cast("timestamp"))
    return df


@register(
    "bars_by_strike",
    TICKS,
    "t AS (SELECT * FROM ticks WHERE token_role = 'yes')",
    """b AS (SELECT ticker, threshold, market_id, min(epoch_us(timestamp_utc)) AS lo, max(epoch_us(timestamp_utc)) AS hi, count(*) AS n
  FROM t GROUP BY 1, 2, 3)""",
    """k AS (SELECT t.ticker, t.threshold, t.market_id, t.event_id, t.price, epoch_us(t.timestamp_utc) AS us, n,
  CASE WHEN n > 10 THEN floor((epoch_us(t.timestamp_utc) - lo) / ((hi - lo) / 10.0::DOUBLE)) ELSE t.event_id + 100 END AS bucket
  FROM t JOIN b USING (ticker, threshold, market_id))""",
    """z AS (SELECT ticker, threshold, market_id, n, max_by(event_id, (us, event_id)) AS event_id, max_by(price, (us, event_id)) AS price, max(us) AS us
  FROM k GROUP BY ticker, threshold, market_id, n, bucket)""",
    sql="""SELECT ticker, threshold, CAST(CAST(threshold AS BIGINT) AS VARCHAR) AS strike_label, market_id, n AS total_points,
  count(*) AS returned_points, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY us, event_id) AS points FROM z GROUP BY 1, 2, 3, 4, 5""",
)
def bars_by_strike(spark, d):
    t = ticks(spark, d).where(F.col("token_role") == "yes")
    keys = ["ticker", "threshold", "market_id"]
    totals = t.groupBy(*keys).agg(F.count("*").alias("total_points"))
    thin = bars.downsample(t, 10, keys, tiebreak=["event_id"])
    # At most N+1 points per series are left, so the list per group is small.
    point = F.struct("timestamp_utc", "event_id")
    series = thin.groupBy(*keys).agg(
        F.count("*").alias("returned_points"), F.sort_array(F.collect_list(point)).alias("_pts")
    )
    whole = F.col("threshold") == F.floor("threshold")
    label = F.when(whole, F.col("threshold").cast("bigint").cast("string")).otherwise(F.format_string("%.2f", "threshold"))
    return series.join(totals, keys).select(
        *keys, label.alias("strike_label"), "total_points", "returned_points",
        F.array_join(F.transform("_pts", lambda p: p["event_id"].cast("string")), ",").alias("points"),
    )


@register(
    "market_summary",
    TICKS,
    sql="""SELECT ticker, threshold, count(*) AS points, epoch_us(max(timestamp_utc)) AS last_ts,
  arg_min(market_id, (timestamp_utc, event_id)) AS market_id,
  bool_or(token_role = 'yes') AS has_market, bool_or(price > 0.9::DOUBLE) AS has_prn FROM ticks GROUP BY 1, 2""",
)
def market_summary(spark, d):
    t = ticks(spark, d)
    return t.groupBy("ticker", "threshold").agg(
        F.count("*").alias("points"),
        F.unix_micros(F.max("timestamp_utc")).alias("last_ts"),
        F.min_by("market_id", F.struct("timestamp_utc", "event_id")).alias("market_id"),
        F.bool_or(F.col("token_role") == "yes").alias("has_market"),
        F.bool_or(F.col("price") > 0.9).alias("has_prn"),
    )


@register(
    "realized_vol_trailing",
    CLOSES,
    """rets AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS lr
  FROM closes WINDOW w AS (PARTITION BY ticker ORDER BY date))""",
    """v AS (SELECT ticker, date, CASE WHEN count(lr) OVER t >= 20 THEN sqrt(252.0::DOUBLE) * stddev_samp(lr) OVER t END AS rv
  FROM rets WINDOW t AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
    sql=f"SELECT ticker, date, {r6('rv')} AS rv20 FROM v",
)
def realized_vol_trailing(spark, d):
    from strikelake.operators.lookups import realized_vol

    return realized_vol(closes(spark, d), 20).select("ticker", "date", r(F.col("rv20"), 6).alias("rv20"))


@register(
    "last_snapshot_local_date",
    sql="""SELECT CAST(max(ts) - INTERVAL 5 HOUR AS DATE) AS last_snapshot_date FROM events""",
)
def last_snapshot_local_date(spark, d):
    from strikelake.functions.calendar import local_time

    return load(spark, d, "events").agg(F.to_date(local_time(F.max("ts"))).alias("last_snapshot_date"))
