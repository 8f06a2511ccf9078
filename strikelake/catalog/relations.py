"""Joins, lookups, dedupes, overrides, labels and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelake.catalog import register
from strikelake.functions import keys as K, scalar as S
from strikelake.functions.scalar import round_half_up as r
from strikelake.operators import lookups, relational as R
from strikelake.operators.ranks import with_running_sum
from strikelake.sources.tables import (
    CLOSES, DIM_MARKET, DIVIDENDS, LABELLED, SPLITS, TICKS, TITLES, closes, dim_market, dividends, labelled, load,
    splits, ticks, titles,
)


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"


# --- bounded lookups and calendar ranges ----------------------------------------------------------

QUERIES_SQL = """q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 10 AS ticker, CAST(l_shipdate AS DATE) AS day FROM lineitem)"""
# Closes with holes and a non-positive value now and then.
HOLEY = """hc AS (SELECT ticker, date, CASE WHEN CAST(floor(close) AS BIGINT) % 11 = 0 THEN -1.0::DOUBLE ELSE close END AS close
  FROM closes WHERE (CAST(epoch(date) AS BIGINT) // 86400 + ticker) % 3 = 0)"""


def _queries(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 10).alias("ticker"), F.to_date("l_shipdate").alias("day")
    )


def _holey(spark, d):
    c = closes(spark, d).where((F.unix_date("date") + F.col("ticker")) % 3 == 0)
    return c.withColumn("close", F.when(F.floor("close").cast("bigint") % 11 == 0, -1.0).otherwise(F.col("close")))


def _nearest_sql(sign: str) -> str:
    return f"""SELECT q.l_orderkey, q.l_linenumber, q.l_partkey, q.ticker, q.day, c.close AS close_px, c.date AS close_date,
  CAST(abs(date_diff('day', q.day, c.date)) AS INT) AS close_lag
  FROM q LEFT JOIN (SELECT q2.ticker, q2.day, hc.date, hc.close,
     row_number() OVER (PARTITION BY q2.ticker, q2.day ORDER BY abs(date_diff('day', q2.day, hc.date))) AS rn
     FROM (SELECT DISTINCT ticker, day FROM q) q2 JOIN hc ON hc.ticker = q2.ticker AND hc.close > 0
      AND date_diff('day', q2.day, hc.date) * {sign} BETWEEN 0 AND 3) c
  ON c.ticker = q.ticker AND c.day = q.day AND c.rn = 1"""


@register("nearest_close_forward", CLOSES, HOLEY, QUERIES_SQL, sql=_nearest_sql("1"))
def nearest_close_forward(spark, d):
    return lookups.nearest_close(_queries(spark, d), _holey(spark, d), "forward", 3)


@register("nearest_close_backward", CLOSES, HOLEY, QUERIES_SQL, sql=_nearest_sql("-1"))
def nearest_close_backward(spark, d):
    return lookups.nearest_close(_queries(spark, d), _holey(spark, d), "backward", 3)


@register(
    "trailing_dividend_sum",
    CLOSES,
    DIVIDENDS,
    sql="""SELECT c.ticker, c.date, coalesce(sum(v.amount), 0.0::DOUBLE) AS div_sum
  FROM closes c LEFT JOIN dividends v ON v.ticker = c.ticker AND v.date BETWEEN c.date - INTERVAL 365 DAY AND c.date
  GROUP BY 1, 2""",
)
def trailing_dividend_sum(spark, d):
    out = lookups.window_total(closes(spark, d), dividends(spark, d), "amount", -365, 0, "div_sum", "date")
    return out.select("ticker", "date", "div_sum")


@register(
    "split_factor",
    CLOSES,
    SPLITS,
    sql=f"""SELECT c.ticker, c.date, {r6('coalesce(exp(sum(ln(s.ratio))), 1.0::DOUBLE)')} AS split_factor
  FROM closes c LEFT JOIN splits s ON s.ticker = c.ticker AND s.date > c.date GROUP BY 1, 2""",
)
def split_factor(spark, d):
    out = lookups.split_factor(closes(spark, d), splits(spark, d), day="date")
    return out.select("ticker", "date", r(F.col("split_factor"), 6).alias("split_factor"))


@register(
    "split_state_inference",
    CLOSES,
    SPLITS,
    """ev AS (SELECT s.ticker, s.date, s.ratio,
   (SELECT max_by(c.close, c.date) FROM closes c WHERE c.ticker = s.ticker AND c.date < s.date) AS pre,
   (SELECT min_by(c.close, c.date) FROM closes c WHERE c.ticker = s.ticker AND c.date >= s.date) AS post FROM splits s)""",
    """vd AS (SELECT *, CASE WHEN pre > 0 AND post > 0 THEN CASE WHEN abs(pre / post - ratio) / ratio <= 0.25::DOUBLE THEN false
   WHEN abs(pre / post - 1.0) <= 0.25::DOUBLE THEN true END END AS v FROM ev)""",
    "st AS (SELECT ticker, min_by(v, (date, ratio)) AS v FROM vd WHERE v IS NOT NULL GROUP BY 1)",
    sql="""SELECT t.ticker, st.v AS already_adjusted FROM (SELECT DISTINCT ticker FROM closes) t LEFT JOIN st USING (ticker)""",
)
def split_state_inference(spark, d):
    return lookups.closes_already_adjusted(closes(spark, d), splits(spark, d))


@register(
    "splits_between_dates",
    QUERIES_SQL,
    SPLITS,
    "qq AS (SELECT *, CAST(day + CAST(l_linenumber * 30 - 40 AS INT) AS DATE) AS expiry FROM q)",
    """n AS (SELECT x.ticker, x.day, x.expiry, count(s.date) AS n FROM (SELECT DISTINCT ticker, day, expiry FROM qq) x
   LEFT JOIN splits s ON s.ticker = x.ticker AND s.date BETWEEN x.day AND x.expiry GROUP BY 1, 2, 3)""",
    sql="""SELECT qq.l_orderkey, qq.l_linenumber, qq.l_partkey, qq.ticker, CASE WHEN qq.day <= qq.expiry THEN n.n END AS splits
  FROM qq JOIN n ON n.ticker = qq.ticker AND n.day = qq.day AND n.expiry = qq.expiry""",
)
def splits_between_dates(spark, d):
    q = _queries(spark, d).withColumn("expiry", F.date_add("day", F.col("l_linenumber") * 30 - 40))
    out = lookups.count_between(q, splits(spark, d), "day", "expiry", "splits")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "ticker", "splits")


@register(
    "trailing_dividend_yield",
    CLOSES,
    HOLEY,
    DIVIDENDS,
    """u AS (SELECT DISTINCT l_suppkey % 10 AS ticker, CAST(l_shipdate AS DATE) AS day FROM lineitem)""",
    """s AS (SELECT u.ticker, u.day, count(v.date) AS n, coalesce(sum(v.amount), 0.0::DOUBLE) AS total FROM u
  LEFT JOIN dividends v ON v.ticker = u.ticker AND v.date BETWEEN u.day - INTERVAL 365 DAY AND u.day GROUP BY 1, 2)""",
    """p AS (SELECT s.*, c.close FROM s ASOF LEFT JOIN (SELECT ticker, date, close / 100 AS close FROM hc) c
  ON s.ticker = c.ticker AND s.day >= c.date)""",
    "o AS (SELECT *, CASE WHEN n > 0 AND close > 0 THEN total / close END AS own, day_of_month / 20.0::DOUBLE AS ref FROM (SELECT *, extract(day FROM day) AS day_of_month FROM p))",
    sql=f"""SELECT ticker, day, {r6('CASE WHEN own BETWEEN 0.0 AND 0.2::DOUBLE THEN own WHEN ref BETWEEN 0.0 AND 1.0 THEN ref END')} AS dividend_yield FROM o""",
)
def trailing_dividend_yield(spark, d):
    q = _queries(spark, d).select("ticker", "day").distinct().withColumn("ref_yield", F.dayofmonth("day") / F.lit(20.0))
    px = _holey(spark, d).withColumn("close", F.col("close") / 100)
    out = lookups.trailing_yield(q, dividends(spark, d), px)
    return out.select("ticker", "day", r(F.col("dividend_yield"), 6).alias("dividend_yield"))


@register(
    "spot_asof_cascade",
    TICKS,
    """mins AS (SELECT ticker, timestamp_utc - CASE WHEN ticker > 'T3' THEN INTERVAL 3650 DAY ELSE INTERVAL 0 DAY END AS ts, max_by(price, event_id) AS px FROM ticks
  WHERE event_type = 'click' GROUP BY 1, 2)""",
    """daily AS (SELECT ticker, CAST(timestamp_utc - INTERVAL 5 HOUR AS DATE) + CASE WHEN ticker = 'T9' THEN 3650 ELSE 0 END AS date, max_by(price, (timestamp_utc, event_id)) AS close
  FROM ticks WHERE event_type = 'view' GROUP BY 1, 2)""",
    """qs AS (SELECT event_id, ticker, timestamp_utc AS ts, CAST(timestamp_utc - INTERVAL 5 HOUR AS DATE) AS ld FROM ticks WHERE event_type = 'purchase')""",
    """i AS (SELECT q.*, m.ts AS mts, m.px FROM qs q ASOF LEFT JOIN mins m ON q.ticker = m.ticker AND q.ts >= m.ts)""",
    """j AS (SELECT event_id, ticker, ts, ld, CASE WHEN epoch_us(ts) - epoch_us(mts) <= 432000000000 THEN px END AS px,
   CASE WHEN epoch_us(ts) - epoch_us(mts) <= 432000000000 THEN mts END AS mts FROM i)""",
    """k AS (SELECT j.*, d.date AS dd, d.close FROM j ASOF LEFT JOIN daily d ON j.ticker = d.ticker AND j.ld > d.date)""",
    sql="""SELECT event_id, coalesce(px, close) AS spot,
  CASE WHEN px IS NOT NULL THEN 'intraday_1m' WHEN close IS NOT NULL THEN 'prev_close' ELSE 'none' END AS spot_source,
  coalesce(epoch_us(mts), epoch_us(CAST(dd AS TIMESTAMP))) AS spot_ts FROM k""",
)
def spot_asof_cascade(spark, d):
    t = ticks(spark, d)
    # Minutes of tickers after T3 are stale by ten years, closes of T9 lie ten years ahead: the later steps of the cascade.
    stale = F.when(F.col("ticker") > "T3", F.col("timestamp_utc") - F.expr("INTERVAL 3650 DAYS")).otherwise(F.col("timestamp_utc"))
    minutes = t.where(F.col("event_type") == "click").select(
        "ticker", stale.alias("minute_ts"), F.col("price").alias("minute_px"), F.col("event_id").alias("minute_tie")
    )
    daily = (
        t.where(F.col("event_type") == "view")
        .groupBy("ticker", F.date_add(F.to_date(F.from_utc_timestamp("timestamp_utc", "America/New_York")), F.when(F.col("ticker") == "T9", 3650).otherwise(0)).alias("date"))
        .agg(F.max_by("price", F.struct("timestamp_utc", "event_id")).alias("close"))
    )
    q = t.where(F.col("event_type") == "purchase").select("event_id", "ticker", F.col("timestamp_utc").alias("ts"))
    return lookups.spot_asof(q, minutes, daily).select("event_id", "spot", "spot_source", F.unix_micros("spot_ts").alias("spot_ts"))


@register(
    "robust_volatility_cascade",
    """c AS (SELECT o_custkey % 700 AS ticker, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_custkey % 700 = 3 THEN 10.0::DOUBLE ELSE max(o_totalprice) END AS close FROM orders GROUP BY 1, 2)""",
    """q AS (SELECT DISTINCT o_custkey % 710 AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM orders)""",
    "a AS (SELECT q.*, c.date AS ad FROM q ASOF LEFT JOIN c ON q.ticker = c.ticker AND q.day >= c.date)",
    """h AS (SELECT a.ticker, a.day, c.date, c.close, row_number() OVER w AS back, count(*) OVER p AS n,
   lag(c.close) OVER f AS prev FROM a JOIN c ON c.ticker = a.ticker AND c.date BETWEEN a.ad - INTERVAL 400 DAY AND a.ad
   WINDOW w AS (PARTITION BY a.ticker, a.day ORDER BY c.date DESC), p AS (PARTITION BY a.ticker, a.day),
     f AS (PARTITION BY a.ticker, a.day ORDER BY c.date))""",
    """s AS (SELECT ticker, day, max(n) AS n, stddev_samp(ln(close / prev)) FILTER (WHERE back <= 19 AND n >= 20) AS near,
   stddev_samp(ln(close / prev)) AS far FROM h GROUP BY 1, 2)""",
    """v AS (SELECT q.ticker, q.day, s.n, CASE WHEN near > 1e-12 THEN near END AS near, CASE WHEN far > 1e-12 THEN far END AS far,
   CASE WHEN q.ticker % 2 = 0 THEN 0.4::DOUBLE END AS iv FROM q LEFT JOIN s USING (ticker, day))""",
    sql=f"""SELECT ticker, day,
  {r6("CASE WHEN near IS NOT NULL THEN least(near * sqrt(252.0::DOUBLE), 10.0) WHEN n >= 2 AND far IS NOT NULL THEN least(far * sqrt(252.0::DOUBLE) * CASE WHEN n < 20 THEN sqrt(20.0::DOUBLE / n) ELSE 1.0 END, 10.0) WHEN iv IS NOT NULL THEN iv ELSE 0.3::DOUBLE END")} AS rv20,
  CASE WHEN near IS NOT NULL THEN 'realized_20d' WHEN n >= 2 AND far IS NOT NULL THEN concat('realized_', CAST(n AS VARCHAR), 'd_scaled')
    WHEN iv IS NOT NULL THEN 'implied_atm' ELSE 'fallback' END AS rv20_source,
  CAST(CASE WHEN near IS NOT NULL THEN 20 WHEN n >= 2 AND far IS NOT NULL THEN n ELSE 0 END AS INT) AS rv20_window,
  near IS NULL AND NOT coalesce(n >= 2 AND far IS NOT NULL, false) AND iv IS NULL AS is_missing_rv20 FROM v""",
)
def robust_volatility_cascade(spark, d):
    o = load(spark, d, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("date"), "o_totalprice", F.to_date(F.date_trunc("month", "o_orderdate")).alias("day")
    )
    c = o.groupBy((F.col("o_custkey") % 700).alias("ticker"), "date").agg(F.max("o_totalprice").alias("close"))
    c = c.withColumn("close", F.when(F.col("ticker") == 3, 10.0).otherwise(F.col("close")))
    q = o.select((F.col("o_custkey") % 710).alias("ticker"), "day").distinct()
    q = q.withColumn("atm_iv", F.when(F.col("ticker") % 2 == 0, 0.4))
    out = lookups.robust_vol(q, c)
    return out.select("ticker", "day", r(F.col("rv20"), 6).alias("rv20"), "rv20_source", "rv20_window", "is_missing_rv20")


# --- dimension, semi/anti joins, overlaps ---------------------------------------------------------


@register(
    "attach_dimension",
    "ticks AS (SELECT event_id, user_id AS market_id FROM events)",
    DIM_MARKET,
    sql="""SELECT t.event_id, t.market_id, d.ticker, d.threshold, d.expiry_date FROM ticks t LEFT JOIN dim_market d
   ON t.market_id = d.market_id AND d.market_id % 7 <> 0""",
)
def attach_dimension(spark, d):
    dim = dim_market(spark, d).where(F.col("market_id") % 7 != 0)
    return R.many_to_one(ticks(spark, d).select("event_id", "market_id"), dim, ["market_id"], check=False).select(
        "event_id", "market_id", "ticker", "threshold", "expiry_date"
    )


PRN = """prn AS (SELECT user_id % 10 AS tk, CAST((user_id % 20) * 5 AS DOUBLE) + 0.00000004 AS threshold, CAST(ts AS DATE) AS snap,
  max(value) / 500.0 AS prn FROM events WHERE event_type = 'error' GROUP BY 1, 2, 3)"""


def prn_daily(spark, d):
    e = load(spark, d, "events").where(F.col("event_type") == "error")
    return e.groupBy(
        F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("ticker"),
        (((F.col("user_id") % 20) * 5).cast("double") + 0.00000004).alias("threshold"),
        F.to_date("ts").alias("day"),
    ).agg((F.max("value") / 500.0).alias("prn"))


@register(
    "join_on_rounded_threshold",
    TICKS,
    PRN,
    sql="""SELECT t.event_id, p.prn FROM ticks t JOIN prn p ON t.ticker = concat('T', CAST(p.tk AS VARCHAR))
   AND round(t.threshold, 6) = round(p.threshold, 6) AND CAST(t.timestamp_utc AS DATE) = p.snap""",
)
def join_on_rounded_threshold(spark, d):
    t = ticks(spark, d).withColumn("day", F.to_date("timestamp_utc")).withColumn("threshold", F.round("threshold", 6))
    p = prn_daily(spark, d).withColumn("threshold", F.round("threshold", 6))
    key = ["ticker", "threshold", "day"]
    return t.dropna(subset=key).join(p.dropna(subset=key), key).select("event_id", "prn")


@register(
    "market_benchmark_merge",
    DIM_MARKET,
    """bench AS (SELECT ticker, threshold + 0.00001 AS K, expiry_date AS event_date, max(threshold) / 100.0 AS prn FROM dim_market
   WHERE market_id % 3 <> 0 GROUP BY 1, 2, 3)""",
    sql="""SELECT m.market_id, b.prn FROM dim_market m LEFT JOIN bench b ON m.ticker = b.ticker AND m.expiry_date = b.event_date
   AND round(m.threshold, 4) = round(b.K, 4)""",
)
def market_benchmark_merge(spark, d):
    m = dim_market(spark, d)
    bench = m.where(F.col("market_id") % 3 != 0).groupBy(
        "ticker", (F.col("threshold") + 0.00001).alias("K"), F.col("expiry_date").alias("event_date")
    ).agg((F.max("threshold") / 100.0).alias("prn"))
    left = m.select("market_id", "ticker", F.col("threshold").alias("K"), F.col("expiry_date").alias("event_date"))
    return R.rounded_key_join(left, bench).select("market_id", "prn")


@register(
    "restricted_scan",
    TICKS,
    DIM_MARKET,
    sql="""SELECT event_id FROM ticks WHERE ticker IN (SELECT ticker FROM dim_market WHERE expiry_date = DATE '2024-01-12')
   AND threshold IN (SELECT threshold FROM dim_market WHERE expiry_date > DATE '2024-01-19')
   AND CAST(timestamp_utc AS DATE) IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'error' AND value > 300)""",
)
def restricted_scan(spark, d):
    t = ticks(spark, d).withColumn("day", F.to_date("timestamp_utc"))
    m = dim_market(spark, d)
    days = load(spark, d, "events").where((F.col("event_type") == "error") & (F.col("value") > 300)).select(F.to_date("ts"))
    return R.restrict_to(
        t,
        ticker=m.where(F.col("expiry_date") == F.lit("2024-01-12")).select("ticker"),
        threshold=m.where(F.col("expiry_date") > F.lit("2024-01-19")).select("threshold"),
        day=days,
    ).select("event_id")


@register(
    "common_dates",
    LABELLED,
    CLOSES,
    sql="SELECT asof_date FROM labelled INTERSECT SELECT date AS asof_date FROM closes",
)
def common_dates(spark, d):
    return R.common_values(labelled(spark, d), closes(spark, d).withColumnRenamed("date", "asof_date"), "asof_date")


@register(
    "purge_shared_groups",
    LABELLED,
    sql="""SELECT group_id, l_linenumber, l_partkey, asof_date FROM labelled WHERE asof_date < DATE '2000-01-01'
  AND group_id NOT IN (SELECT group_id FROM labelled WHERE asof_date >= DATE '2000-01-01')""",
)
def purge_shared_groups(spark, d):
    x = labelled(spark, d)
    cut = F.lit("2000-01-01").cast("date")
    train, test = x.where(F.col("asof_date") < cut), x.where(F.col("asof_date") >= cut)
    return R.drop_shared_groups(train, test, "group_id").select("group_id", "l_linenumber", "l_partkey", "asof_date")


@register(
    "split_overlap_counts",
    LABELLED,
    "a AS (SELECT * FROM labelled WHERE asof_date < DATE '2000-01-01')",
    "b AS (SELECT * FROM labelled WHERE asof_date >= DATE '2000-01-01')",
    sql="""SELECT 'group_id' AS key, count(*) AS shared FROM (SELECT group_id FROM a INTERSECT SELECT group_id FROM b)
 UNION ALL SELECT 'ticker', count(*) FROM (SELECT ticker FROM a INTERSECT SELECT ticker FROM b)
 UNION ALL SELECT 'l_partkey', count(*) FROM (SELECT l_partkey FROM a INTERSECT SELECT l_partkey FROM b)""",
)
def split_overlap_counts(spark, d):
    x = labelled(spark, d)
    cut = F.lit("2000-01-01").cast("date")
    return R.overlap_counts(
        x.where(F.col("asof_date") < cut), x.where(F.col("asof_date") >= cut), ["group_id", "ticker", "l_partkey"]
    )


# --- overrides and labels -------------------------------------------------------------------------

DIM_TITLES = """dim AS (SELECT CAST(market_id AS VARCHAR) AS market_id, condition_id, slug, concat('T', CAST(market_id % 10 AS VARCHAR)) AS ticker,
  CAST(market_id % 50 AS DOUBLE) AS threshold, 'auto' AS source, 0.8::DOUBLE AS mapping_confidence FROM titles)"""
OVERRIDES = """ov AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS market_id,
  CASE WHEN c_custkey % 3 = 1 THEN concat('c', CAST(c_custkey % 700 AS VARCHAR)) ELSE '' END AS condition_id,
  CASE WHEN c_custkey % 3 = 2 THEN concat('other-', CAST(c_custkey % 50 AS VARCHAR)) ELSE '' END AS slug,
  CASE WHEN c_custkey % 2 = 0 THEN concat('X', CAST(c_custkey AS VARCHAR)) ELSE '' END AS ticker,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 90 AS DOUBLE) END AS threshold, c_custkey AS line FROM customer)"""


@register(
    "override_precedence",
    TITLES,
    DIM_TITLES,
    OVERRIDES,
    "bm AS (SELECT market_id AS k, max(line) AS line FROM ov WHERE market_id <> '' GROUP BY 1)",
    "bc AS (SELECT condition_id AS k, max(line) AS line FROM ov WHERE condition_id <> '' GROUP BY 1)",
    "bs AS (SELECT slug AS k, max(line) AS line FROM ov WHERE slug <> '' GROUP BY 1)",
    """j AS (SELECT d.*, coalesce(bm.line, bc.line, bs.line) AS line FROM dim d LEFT JOIN bm ON d.market_id = bm.k
    LEFT JOIN bc ON d.condition_id = bc.k LEFT JOIN bs ON d.slug = bs.k)""",
    sql="""SELECT coalesce(nullif(o.market_id, ''), j.market_id) AS market_id, coalesce(nullif(o.condition_id, ''), j.condition_id) AS condition_id,
  coalesce(nullif(o.slug, ''), j.slug) AS slug, coalesce(nullif(o.ticker, ''), j.ticker) AS ticker, coalesce(o.threshold, j.threshold) AS threshold,
  CASE WHEN j.line IS NOT NULL THEN 'manual' ELSE j.source END AS source,
  CASE WHEN j.line IS NOT NULL THEN 1.0::DOUBLE ELSE j.mapping_confidence END AS mapping_confidence
  FROM j LEFT JOIN ov o ON o.line = j.line""",
)
def override_precedence(spark, d):
    key = F.col("market_id")
    dim = titles(spark, d).select(
        key.cast("string").alias("market_id"), "condition_id", "slug",
        F.concat(F.lit("T"), (key % 10).cast("string")).alias("ticker"), (key % 50).cast("double").alias("threshold"),
        F.lit("auto").alias("source"), F.lit(0.8).alias("mapping_confidence"),
    )
    c = F.col("c_custkey")
    none = F.lit("")
    ov = load(spark, d, "customer").select(
        F.when(c % 3 == 0, c.cast("string")).otherwise(none).alias("market_id"),
        F.when(c % 3 == 1, F.concat(F.lit("c"), (c % 700).cast("string"))).otherwise(none).alias("condition_id"),
        F.when(c % 3 == 2, F.concat(F.lit("other-"), (c % 50).cast("string"))).otherwise(none).alias("slug"),
        F.when(c % 2 == 0, F.concat(F.lit("X"), c.cast("string"))).otherwise(none).alias("ticker"),
        F.when(c % 5 == 0, None).otherwise((c % 90).cast("double")).alias("threshold"),
        c.alias("line"),
    )
    return R.apply_overrides(dim, ov)


@register(
    "payout_labels",
    """m AS (SELECT o_orderkey AS market_id, concat('c', CAST(o_orderkey % 5000 AS VARCHAR)) AS condition_id,
   concat('y', CAST(o_orderkey AS VARCHAR)) AS yt, concat('n', CAST(o_orderkey AS VARCHAR)) AS nt FROM orders)""",
    """c AS (SELECT concat('c', CAST(p_partkey AS VARCHAR)) AS id, CAST(p_partkey % 3 AS VARCHAR) AS a, CAST(p_size % 3 AS VARCHAR) AS b,
   p_partkey % 11 = 0 AS one, CASE WHEN p_partkey % 13 = 0 THEN '0' WHEN p_partkey % 17 = 0 THEN NULL ELSE '2' END AS den FROM part)""",
    """p AS (SELECT o_orderkey AS k, concat('c', CAST(o_orderkey % 5000 AS VARCHAR)) AS condition_id, o_orderkey % 2 AS iy, 1 - o_orderkey % 2 AS ino FROM orders WHERE o_orderkey % 4 = 0)""",
    """j AS (SELECT m.market_id, c.*, coalesce(p.iy, 0) AS iy, coalesce(p.ino, 1) AS ino FROM m JOIN c ON m.condition_id = c.id LEFT JOIN p ON p.k = m.market_id
   WHERE c.den IS NOT NULL AND CAST(c.den AS DOUBLE) <> 0 AND NOT c.one)""",
    """z AS (SELECT market_id, CAST(CASE WHEN iy = 0 THEN a ELSE b END AS DOUBLE) AS py, CAST(CASE WHEN ino = 0 THEN a ELSE b END AS DOUBLE) AS pn FROM j)""",
    sql="SELECT market_id, CASE WHEN py > pn THEN 1 WHEN py < pn THEN 0 END AS label FROM z",
)
def payout_labels(spark, d):
    o = load(spark, d, "orders")
    key = F.col("o_orderkey")
    cond = F.concat(F.lit("c"), (key % 5000).cast("string"))
    dim = o.select(
        key.alias("market_id"), cond.alias("condition_id"),
        F.concat(F.lit("y"), key.cast("string")).alias("outcome_yes_token_id"),
        F.concat(F.lit("n"), key.cast("string")).alias("outcome_no_token_id"),
    )
    p = F.col("p_partkey")
    a, b = (p % 3).cast("string"), (F.col("p_size") % 3).cast("string")
    conditions = load(spark, d, "part").select(
        F.concat(F.lit("c"), p.cast("string")).alias("id"),
        F.when(p % 11 == 0, F.array(a)).otherwise(F.array(a, b)).alias("payout_numerators"),
        F.when(p % 13 == 0, "0").when(p % 17 == 0, None).otherwise("2").alias("payout_denominator"),
    )
    quarter = o.where(key % 4 == 0)
    side = lambda tag, idx: quarter.select(
        F.concat(F.lit(tag), key.cast("string")).alias("id"), cond.alias("condition"), idx.alias("outcome_index")
    )
    positions = side("y", key % 2).unionByName(side("n", 1 - key % 2))
    return R.payout_labels(dim, conditions, positions)


# --- dedupes, unions, columns ---------------------------------------------------------------------


@register(
    "keep_last_per_key",
    TICKS,
    """k AS (SELECT *, row_number() OVER (PARTITION BY market_id, date_trunc('hour', timestamp_utc), token_role ORDER BY timestamp_utc DESC, event_id DESC) AS rn FROM ticks)""",
    sql="SELECT market_id, epoch_us(date_trunc('hour', timestamp_utc)) AS hour, token_role, event_id, price FROM k WHERE rn = 1",
)
def keep_last_per_key(spark, d):
    t = ticks(spark, d).select("market_id", F.unix_micros(F.date_trunc("hour", "timestamp_utc")).alias("hour"), "token_role", "event_id", "price", "timestamp_utc")
    return R.keep_last(t, ["market_id", "hour", "token_role"], ["timestamp_utc", "event_id"]).drop("timestamp_utc")


@register(
    "best_source_dedupe",
    """rows AS (SELECT l_partkey AS row_id, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_linenumber % 3 END AS af,
  CAST(l_quantity AS BIGINT) % 3 AS ef, CASE CAST(l_quantity AS BIGINT) % 4 WHEN 0 THEN 'BIDASK_MID' WHEN 1 THEN 'close_fallback' WHEN 2 THEN 'other' END AS qs,
  CASE WHEN l_discount > 0.08 THEN NULL ELSE CAST(l_quantity AS INT) END AS n, CASE WHEN l_tax > 0.06 THEN NULL ELSE l_tax END AS sp FROM lineitem)""",
    """k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY coalesce(af, 1e9), coalesce(ef, 1e9),
    CASE lower(qs) WHEN 'bidask_mid' THEN 0 WHEN 'close_fallback' THEN 1 ELSE 9 END, coalesce(n, -1) DESC, coalesce(sp, 1e9), l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rn FROM rows)""",
    sql="SELECT row_id, l_orderkey, l_linenumber, l_suppkey, qs AS quote_source, n AS n_chain_used FROM k WHERE rn = 1",
)
def best_source_dedupe(spark, d):
    q = F.col("l_quantity").cast("bigint")
    rows = load(spark, d, "lineitem").select(
        F.col("l_partkey").alias("row_id"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice",
        F.when(F.col("l_linenumber") % 4 == 0, None).otherwise(F.col("l_linenumber") % 3).alias("asof_fallback_days"),
        (q % 3).alias("expiry_fallback_days"),
        F.when(q % 4 == 0, "BIDASK_MID").when(q % 4 == 1, "close_fallback").when(q % 4 == 2, "other").alias("quote_source"),
        F.when(F.col("l_discount") > 0.08, None).otherwise(F.col("l_quantity").cast("int")).alias("n_chain_used"),
        F.when(F.col("l_tax") > 0.06, None).otherwise(F.col("l_tax")).alias("rel_spread_median"),
    )
    out = R.best_source(rows, tiebreak=["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    return out.select("row_id", "l_orderkey", "l_linenumber", "l_suppkey", "quote_source", "n_chain_used")


@register(
    "duplicate_row_ids",
    """ids AS (SELECT substr(sha1(concat_ws('|', strftime(date_trunc('month', l_shipdate), '%Y-%m-%d'), CAST(l_suppkey AS VARCHAR), '2000-01-07', printf('%.7f', l_quantity), 'call')), 1, 16) AS row_id FROM lineitem)""",
    sql="SELECT row_id, count(*) AS copies FROM ids GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_row_ids(spark, d):
    ids = load(spark, d, "lineitem").select(
        K.row_id(
            F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd"), F.col("l_suppkey").cast("string"),
            F.lit("2000-01-07"), F.col("l_quantity"), F.lit("call"),
        ).alias("row_id")
    )
    return R.duplicate_keys(ids, ["row_id"])


@register(
    "union_differing_columns",
    sql="""SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::BIGINT AS nation FROM customer
  UNION ALL SELECT s_suppkey, s_name, NULL, CAST(s_nationkey AS BIGINT) FROM supplier""",
)
def union_differing_columns(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("bigint").alias("nation"))
    return R.union_all(c, s).select("id", "name", "balance", "nation")


@register(
    "rare_ticker_folding",
    LABELLED,
    "s AS (SELECT ticker, count(*) AS n FROM labelled WHERE asof_date < DATE '1996-01-01' GROUP BY 1)",
    "m AS (SELECT approx AS x FROM (SELECT CAST(floor(avg(n)) AS BIGINT) AS approx FROM s))",
    sql="""SELECT CASE WHEN s.n >= (SELECT x FROM m) OR l.ticker IN (1, 2) THEN CAST(l.ticker AS VARCHAR) ELSE 'OTHER' END AS ticker_scoped, count(*) AS n
  FROM labelled l LEFT JOIN s ON l.ticker = s.ticker GROUP BY 1""",
)
def rare_ticker_folding(spark, d):
    x = labelled(spark, d)
    fit = F.col("asof_date") < F.lit("1996-01-01").cast("date")
    mean = x.where(fit).groupBy("ticker").count().agg(F.floor(F.avg("count"))).first()[0]
    return R.fold_rare(x, "ticker", mean, fit, preserve=["1", "2"]).groupBy("ticker_scoped").agg(F.count("*").alias("n"))


@register(
    "column_fill_and_variance",
    LABELLED,
    sql=f"""SELECT 'w' AS "column", count(w) AS non_null, {r6('var_pop(w)')} AS variance FROM labelled
 UNION ALL SELECT 'tax', count(tax), {r6('var_pop(tax)')} FROM labelled
 UNION ALL SELECT 'flat', count(*), 0.0 FROM labelled UNION ALL SELECT 'empty', 0, NULL FROM labelled GROUP BY 1""",
)
def column_fill_and_variance(spark, d):
    x = labelled(spark, d).withColumn("flat", F.lit(3.0)).withColumn("empty", F.lit(None).cast("double"))
    out = R.column_fill(x, ["w", "tax", "flat", "empty"])
    return out.select("column", "non_null", r(F.col("variance"), 6).alias("variance"))


@register(
    "useful_features",
    LABELLED,
    sql=f"""SELECT ticker, count(*) AS n, {r6('avg(w)')} AS w, {r6('avg(tax)')} AS tax FROM labelled GROUP BY 1""",
)
def useful_features(spark, d):
    """Features that are empty or near-constant on the fit rows leave the whole table; one that varies only later leaves too."""
    x = labelled(spark, d).withColumns({
        "empty": F.lit(None).cast("double"), "flat": F.lit(0.1), "late": F.when(F.col("asof_date") >= F.lit("2000-01-01"), F.col("w")).otherwise(F.lit(5.0)),
    })
    features = ["w", "tax", "empty", "flat", "late"]
    empty, flat = R.droppable_features(x.where(F.col("asof_date") < F.lit("2000-01-01")), features)
    kept = [f for f in features if f not in (*empty, *flat)]
    return x.groupBy("ticker").agg(F.count("*").alias("n"), *[r(F.avg(f), 6).alias(f) for f in kept])


@register(
    "ordered_dataset",
    LABELLED,
    "od AS (SELECT asof_date AS d, concat('S', CAST(ticker AS VARCHAR)) AS t, CAST(l_partkey % 50 AS DOUBLE) AS k FROM labelled)",
    "ra AS (SELECT *, row_number() OVER (ORDER BY d, t, k) AS place FROM od)",
    sql="SELECT d AS snapshot_date, t AS ticker, min(place) AS first_place, max(place) AS last_place FROM ra GROUP BY 1, 2",
)
def ordered_dataset(spark, d):
    """Places of each day and ticker in the written order of a dataset."""
    x = labelled(spark, d).select(
        F.col("asof_date").alias("snapshot_date"), F.concat(F.lit("S"), F.col("ticker").cast("string")).alias("ticker"), (F.col("l_partkey") % 50).cast("double").alias("K")
    )
    # Ids of an ordered result grow with its partitions; equal rows of the order are interchangeable.
    placed = with_running_sum(R.output_order(x).withColumn("_id", F.monotonically_increasing_id()), [], ["_id"], F.lit(1).cast("long"), "place")
    return placed.groupBy("snapshot_date", "ticker").agg(F.min("place").alias("first_place"), F.max("place").alias("last_place"))


@register(
    "first_available_label",
    LABELLED,
    sql="""SELECT 'outcome' AS label_column, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM labelled WHERE y IN (0, 1)""",
)
def first_available_label(spark, d):
    x = labelled(spark, d).withColumn("label", F.lit(None).cast("double")).withColumnRenamed("y", "outcome")
    x = x.withColumn("outcome_ST_gt_K", F.lit(7.0))
    name = R.label_column(x)
    return x.where(F.col(name).isin(0, 1)).agg(
        F.lit(name).alias("label_column"), F.count("*").alias("n"), F.sum(name).alias("positives")
    )


@register(
    "dataset_backfill",
    CLOSES,
    "a AS (SELECT concat(CAST(ticker AS VARCHAR), '|', strftime(date, '%Y-%m-%d')) AS row_id, close FROM closes WHERE date < DATE '1998-01-01')",
    "b AS (SELECT concat(CAST(ticker AS VARCHAR), '|', strftime(date, '%Y-%m-%d')) AS row_id, -close AS close FROM closes WHERE date >= DATE '1997-06-01')",
    sql="SELECT row_id, close FROM a UNION ALL SELECT row_id, close FROM b WHERE row_id NOT IN (SELECT row_id FROM a)",
)
def dataset_backfill(spark, d):
    c = closes(spark, d)
    rid = F.concat(F.col("ticker").cast("string"), F.lit("|"), F.date_format("date", "yyyy-MM-dd")).alias("row_id")
    a = c.where(F.col("date") < F.lit("1998-01-01").cast("date")).select(rid, "close")
    b = c.where(F.col("date") >= F.lit("1997-06-01").cast("date")).select(rid, (-F.col("close")).alias("close"))
    return R.backfill(a, b)


@register(
    "missing_column_defaults",
    sql="""SELECT c_custkey, c_acctbal, 0.3::DOUBLE AS rv20, 'raw' AS spot_scale_used, 0 AS expiry_fallback_days, NULL::DOUBLE AS forward_price FROM customer""",
)
def missing_column_defaults(spark, d):
    base = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    return R.ensure_columns(
        base,
        {
            "c_acctbal": F.lit(-1.0), "rv20": F.lit(0.3), "spot_scale_used": F.lit("raw"), "expiry_fallback_days": F.lit(0),
            "forward_price": F.lit(None).cast("double"),
        },
    )
