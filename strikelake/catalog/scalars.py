"""Scalar functions, keys, filters, calendar rules, titles and the feature catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelake.catalog import register
from strikelake.functions import calendar as C, features, keys as K, scalar as S, sessions as Se, text as T
from strikelake.functions.scalar import round_half_up as r
from strikelake.operators import filters as P
from strikelake.sources.tables import LABELLED, TICKS, TITLES, labelled, load, ticks, titles


def r9(expr: str) -> str:
    return f"floor(({expr}) * 1000000000.0::DOUBLE + 0.5) / 1000000000.0::DOUBLE"


def r9c(name: str):
    return r(F.col(name), 9).alias(name)


@register(
    "coerced_numbers",
    """raw AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'abc' WHEN 1 THEN 'inf' WHEN 2 THEN 'NaN' WHEN 3 THEN '-inf' WHEN 4 THEN '' ELSE CAST(value AS VARCHAR) END AS t FROM events)""",
    """n AS (SELECT event_id, TRY_CAST(t AS DOUBLE) AS x FROM raw)""",
    sql="SELECT event_id, CASE WHEN isfinite(x) THEN x END AS x, CASE WHEN isfinite(x) AND event_id % 5 <> 0 THEN x / (event_id % 5) END AS ratio FROM n",
)
def coerced_numbers(spark, d):
    i = F.col("event_id")
    t = (
        F.when(i % 8 == 0, "abc").when(i % 8 == 1, "inf").when(i % 8 == 2, "NaN").when(i % 8 == 3, "-inf").when(i % 8 == 4, "")
        .otherwise(F.col("value").cast("string"))
    )
    e = load(spark, d, "events").select("event_id", S.to_number(t).alias("x"))
    return e.withColumn("ratio", S.safe_divide(F.col("x"), i % 5))


@register(
    "probability_filters",
    LABELLED,
    sql="""SELECT group_id, l_linenumber, l_partkey, price FROM labelled WHERE p_model > 0.2 AND p_model < 0.999999::DOUBLE AND abs(ln(price / 50000.0)) <= 0.9
   AND l_linenumber = 2 AND isodow(asof_date) = 2 AND ticker NOT IN (7, 8) AND y IN (0, 1)""",
)
def probability_filters(spark, d):
    x = labelled(spark, d).withColumn("log_m", F.ln(F.col("price") / 50000.0)).withColumn("T_days", F.col("l_linenumber"))
    x = P.near_money(x.where(P.inside_tails(F.col("p_model"), below=0.2)), 0.9)
    x = x.where(P.horizon_is(2) & P.asof_weekday_in(F.col("asof_date"), P.parse_weekdays("tue")))
    x = x.where(P.ticker_in("ticker", ["7", " 8"], exclude=True) & P.binary_label("y"))
    return x.select("group_id", "l_linenumber", "l_partkey", "price")


@register(
    "tradeable_markets",
    """m AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN '["a"]' WHEN 1 THEN 'none' WHEN 2 THEN '["a",""]' ELSE '["a","b"]' END AS tok, CASE o_custkey % 5 WHEN 0 THEN 'false' WHEN 1 THEN NULL ELSE 'TRUE' END AS ob,
   o_orderstatus = 'F' AS closed, CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS archived, CASE WHEN o_custkey % 11 = 0 THEN 'no' ELSE 'yes' END AS active FROM orders)""",
    sql="""SELECT o_orderkey, CASE WHEN tok NOT LIKE '["a","b"]' THEN 'missing_clob_tokens' WHEN ob = 'false' THEN 'orderbook_disabled' WHEN closed THEN 'closed'
   WHEN archived = 1 THEN 'archived' WHEN active = 'no' THEN 'inactive' ELSE 'ok' END AS reason FROM m""",
)
def tradeable_markets(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = load(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 9 == 0, '["a"]').when(k % 9 == 1, "none").when(k % 9 == 2, '["a",""]').otherwise('["a","b"]').alias("clobTokenIds"),
        F.when(c % 5 == 0, "false").when(c % 5 == 1, None).otherwise("TRUE").alias("enableOrderBook"),
        (F.col("o_orderstatus") == "F").alias("closed"), F.when(c % 7 == 0, 1).otherwise(0).alias("archived"),
        F.when(c % 11 == 0, "no").otherwise("yes").alias("active"),
    )
    return m.select("o_orderkey", P.tradeable_reason(m.columns).alias("reason"))


@register(
    "two_sided_market_quotes",
    """q AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 512 END AS yb, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (user_id % 64) / 64.0::DOUBLE END AS ys,
   CASE WHEN event_id % 2 = 0 THEN NULL ELSE value / 1024 END AS nb FROM events)""",
    "b AS (SELECT *, least(yb, ys) AS bid, greatest(yb, ys) AS ask FROM q)",
    sql="""SELECT event_id, ask AS pPM_buy, nb AS qPM_buy, (bid + ask) * 0.5::DOUBLE AS pPM_mid, ask - bid AS yes_spread, ask IS NOT NULL OR nb IS NOT NULL AS pm_ok,
  CASE WHEN ask IS NOT NULL OR nb IS NOT NULL THEN 'ok' ELSE 'no_clob_price' END AS pm_reason FROM b""",
)
def two_sided_market_quotes(spark, d):
    i = F.col("event_id")
    q = load(spark, d, "events").select(
        "event_id", F.when(i % 3 == 0, None).otherwise(F.col("value") / 512).alias("yes_buy"),
        F.when(i % 5 == 0, None).otherwise(F.col("user_id") % 64 / F.lit(64.0)).alias("yes_sell"),
        F.when(i % 2 == 0, None).otherwise(F.col("value") / 1024).alias("no_buy"), F.lit(None).cast("double").alias("no_sell"),
    )
    return P.two_sided_market(q).select("event_id", "pPM_buy", "qPM_buy", "pPM_mid", "yes_spread", "pm_ok", "pm_reason")


@register(
    "row_and_contract_keys",
    LABELLED,
    sql="""SELECT group_id AS order_id, l_linenumber, l_partkey, price, substr(sha1(concat_ws('|', strftime(asof_date, '%Y-%m-%dT00:00:00Z'), CAST(ticker AS VARCHAR), strftime(asof_date + 4, '%Y-%m-%d'),
   printf('%.7f', w), 'call')), 1, 16) AS row_id, concat_ws('|', CAST(ticker AS VARCHAR), strftime(asof_date, '%Y-%m-%d'), strftime(asof_date + 4, '%Y-%m-%d')) AS chain_id,
   concat_ws('|', CAST(ticker AS VARCHAR), strftime(asof_date + 4, '%Y-%m-%d'), CAST(w AS VARCHAR)) AS contract_id,
   concat_ws('|', CAST(ticker AS VARCHAR), strftime(asof_date + 4, '%Y-%m-%d'), printf('%.7f', w)) AS cluster_strike FROM labelled""",
)
def row_and_contract_keys(spark, d):
    x = labelled(spark, d).withColumn("expiry_date", F.date_add("asof_date", 4))
    stamp = F.concat(F.date_format("asof_date", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    t, e = F.col("ticker").cast("string"), F.col("expiry_date").cast("string")
    return x.select(
        F.col("group_id").alias("order_id"), "l_linenumber", "l_partkey", "price", K.row_id(stamp, t, e, F.col("w"), F.lit("call")).alias("row_id"),
        K.chain_id(x.columns).alias("chain_id"), K.contract_id(t, e, F.col("w")).alias("contract_id"),
        K.cluster_strike(t, e, F.col("w")).alias("cluster_strike"),
    )


FX = """fx AS (SELECT group_id AS order_id, l_linenumber, l_partkey, price, discount, tax AS pRN, discount AS pRN_raw, w AS K, 25.0::DOUBLE AS S, l_linenumber AS T_days, 0.03::DOUBLE AS r, discount / 4 AS dy,
  tax * 5 AS rv20, ticker % 9 AS used, ticker % 11 AS raw, ticker % 3 AS fb FROM labelled)"""
_CLIPPED = "least(greatest(pRN, 0.000001::DOUBLE), 0.999999::DOUBLE)"
_X = f"ln({_CLIPPED} / (1.0 - {_CLIPPED}))"
_FWD = "S * exp((r - dy) * (T_days / 365.0::DOUBLE))"


@register(
    "engineered_features",
    LABELLED,
    FX,
    f"f AS (SELECT *, {_X} AS x, ln(K / S) AS lm, {_FWD} AS fwd, sqrt(T_days / 365.0::DOUBLE) AS st FROM fx)",
    sql=f"""SELECT order_id, l_linenumber, l_partkey, price, {r9('x')} AS x_logit_prn, {r9('lm')} AS log_m, {r9('ln(K / fwd)')} AS log_m_fwd, {r9('abs(ln(K / fwd))')} AS abs_log_m_fwd,
  {r9('ln(1.0 + T_days)')} AS "log_T_days", {r9('rv20 * st')} AS "rv20_sqrtT", {r9('lm / nullif(rv20 * st, 0)')} AS "log_m_over_volT", {r9('used::DOUBLE / nullif(raw, 0)')} AS chain_used_frac,
  CASE WHEN fb <> 0 THEN 1.0::DOUBLE ELSE 0.0 END AS fallback_any, {r9('pRN - pRN_raw')} AS prn_raw_gap, {r9('x * T_days')} AS x_prn_x_tdays, {r9('x * ln(K / fwd)')} AS x_m FROM f""",
)
def engineered_features(spark, d):
    x = labelled(spark, d).select(
        F.col("group_id").alias("order_id"), "l_linenumber", "l_partkey", "price", F.col("tax").alias("pRN"), F.col("discount").alias("pRN_raw"),
        F.col("w").alias("K"), F.lit(25.0).alias("S_asof_close"), F.col("l_linenumber").alias("T_days"), F.lit(0.03).alias("r"),
        (F.col("discount") / 4).alias("dividend_yield"), (F.col("tax") * 5).alias("rv20"), (F.col("ticker") % 9).alias("n_chain_used"),
        (F.col("ticker") % 11).alias("n_chain_raw"), (F.col("ticker") % 3).alias("asof_fallback_days"),
    )
    names = [
        "x_logit_prn", "log_m", "log_m_fwd", "abs_log_m_fwd", "log_T_days", "rv20_sqrtT", "log_m_over_volT", "chain_used_frac", "fallback_any",
        "prn_raw_gap", "x_prn_x_tdays", "x_m",
    ]
    out = features.with_features(x, names)
    return out.select("order_id", "l_linenumber", "l_partkey", "price", *[r9c(n) for n in names])


@register(
    "enriched_snapshot",
    """s AS (SELECT event_id, ts, CASE WHEN value > 300 THEN NULL ELSE value / 301 END AS pRN, CAST(user_id % 40 + 80 AS DOUBLE) AS K, 100.0::DOUBLE AS S, (user_id % 5)::DOUBLE AS T_days,
   CASE WHEN event_id % 2 = 0 THEN 'intraday_1m' ELSE 'prev_close' END AS src FROM events)""",
    "e AS (SELECT *, least(greatest(pRN, 0.000001::DOUBLE), 0.999999::DOUBLE) + CASE WHEN pRN IS NULL THEN NULL ELSE 0 END AS pc, CASE WHEN T_days > 0 THEN S * exp((0.03::DOUBLE - 0.0) * (T_days / 365.0::DOUBLE)) END AS fwd FROM s)",
    sql=f"""SELECT event_id, CAST(ts AS DATE) AS expiry_date, CAST(ts - INTERVAL 5 HOUR AS DATE) AS asof_date, {r9('T_days / 365.0::DOUBLE')} AS "T_years", {r9('ln(pc / (1 - pc))')} AS x_logit_prn,
  {r9('ln(K / S)')} AS log_m, {r9('fwd')} AS forward_price, {r9('ln(K / fwd)')} AS log_m_fwd, {r9('ln(K / S) / nullif(0.3::DOUBLE * sqrt(T_days / 365.0::DOUBLE), 0)')} AS "log_m_over_volT",
  CASE WHEN src = 'intraday_1m' THEN 0.0::DOUBLE ELSE 1.0 END AS asof_fallback_days, 'raw' AS spot_scale_used FROM e""",
)
def enriched_snapshot(spark, d):
    u = F.col("user_id")
    s = load(spark, d, "events").select(
        "event_id", F.col("ts").alias("snapshot_time_utc"), F.col("ts").alias("event_endDate"),
        F.when(F.col("value") > 300, None).otherwise(F.col("value") / 301).alias("pRN"), (u % 40 + 80).cast("double").alias("K"), F.lit(100.0).alias("S"),
        (u % 5).cast("double").alias("T_days"), F.when(F.col("event_id") % 2 == 0, "intraday_1m").otherwise("prev_close").alias("spot_source"),
    )
    out = features.enrich_snapshot(s)
    return out.select(
        "event_id", "expiry_date", "asof_date", *[r9c(c) for c in ("T_years", "x_logit_prn", "log_m", "forward_price", "log_m_fwd", "log_m_over_volT")],
        "asof_fallback_days", "spot_scale_used",
    )


@register(
    "pricing_functions",
    LABELLED,
    sql=f"""SELECT group_id AS order_id, l_linenumber, l_partkey, price,
  {r9('CASE WHEN l_linenumber > 1 AND discount <= 0.06 THEN w * exp((tax - discount) * ((l_linenumber - 1) / 365.25::DOUBLE)) END')} AS forward_price,
  {r9('CASE WHEN w > 0 THEN (price * (365.25::DOUBLE / 365)) / w ELSE 0 END')} AS dividend_yield,
  {r9('CASE WHEN y = 1 THEN least(greatest(p_model * 1.0075::DOUBLE, 0), 1) ELSE least(greatest(p_model * 0.9925::DOUBLE, 0), 1) END')} AS exec_price,
  round_even(w / 8, 0) AS half_even, {r9('1.0::DOUBLE / (1.0 + exp(-discount))')} AS expit FROM labelled""",
)
def pricing_functions(spark, d):
    x = labelled(spark, d)
    q = F.when(F.col("discount") <= 0.06, F.col("discount")).otherwise(F.lit(5.0))
    t = (F.col("l_linenumber") - 1) / 365.25
    side = F.when(F.col("y") == 1, "buy").otherwise("sell")
    return x.select(
        F.col("group_id").alias("order_id"), "l_linenumber", "l_partkey", "price",
        r(S.forward_price(F.col("w"), F.col("tax"), q, t), 9).alias("forward_price"),
        r(S.dividend_yield(F.col("price"), F.col("w"), 365), 9).alias("dividend_yield"),
        r(S.execution_price(F.col("p_model"), side, 50, 25), 9).alias("exec_price"),
        S.round_half_even(F.col("w") / 8, 0).alias("half_even"), r(S.expit(F.col("discount")), 9).alias("expit"),
    )


@register(
    "execution_delay",
    sql="SELECT event_id, epoch_us(ts) + 250000 AS exec_us FROM events",
)
def execution_delay(spark, d):
    return load(spark, d, "events").select("event_id", F.unix_micros(S.execution_time(F.col("ts"), 250)).alias("exec_us"))


@register(
    "friday_rules",
    "x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)",
    "w AS (SELECT day, isodow(day) - 1 AS wd FROM x)",
    sql="""SELECT day, CAST(day - CAST(wd AS INT) AS DATE) AS monday, CAST(day + CAST((4 - wd + 7) % 7 AS INT) AS DATE) AS next_friday, CAST(day + CAST(4 - wd AS INT) AS DATE) AS display_friday,
  CAST(day - CAST(wd AS INT) + 4 AS DATE) AS iso_friday, CAST(day + CAST(4 - wd AS INT) + 2 AS DATE) AS sunday FROM w""",
)
def friday_rules(spark, d):
    x = load(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    day = F.col("day")
    return x.select(
        "day", C.week_monday(day).alias("monday"), C.next_friday(day).alias("next_friday"), C.display_friday(day).alias("display_friday"),
        C.iso_week_friday(day).alias("iso_friday"), C.week_sunday(C.display_friday(day)).alias("sunday"),
    )


# Second Sunday of March to first Sunday of November is daylight time (after 2006); before that
# April/October rules apply, so the SQL checks the years from 2007 on, shifted from the order dates.
@register(
    "close_time_in_utc",
    "x AS (SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) + 365 * 13 AS DATE) AS day FROM orders)",
    """b AS (SELECT day, make_date(year(day), 3, 8) AS m, make_date(year(day), 11, 1) AS n FROM x)""",
    "s AS (SELECT day, m + CAST((7 - isodow(m)) % 7 AS INT) AS dst_on, n + CAST((7 - isodow(n)) % 7 AS INT) AS dst_off FROM b)",
    sql="SELECT day, epoch_us(CAST(day AS TIMESTAMP)) // 1000000 + CASE WHEN day >= dst_on AND day < dst_off THEN 72000 ELSE 75600 END AS close_utc FROM s",
)
def close_time_in_utc(spark, d):
    x = load(spark, d, "orders").select(F.date_add(F.to_date("o_orderdate"), 365 * 13).alias("day")).distinct()
    return x.select("day", F.unix_seconds(C.close_time_utc(F.col("day"))).alias("close_utc"))


@register(
    "session_classes",
    "l AS (SELECT event_id, ts - INTERVAL 5 HOUR AS lt FROM events)",
    "s AS (SELECT event_id, epoch_us(lt) - epoch_us(date_trunc('day', lt)) AS us FROM l)",
    sql="SELECT event_id, CASE WHEN us < 34200000000 THEN 'PRE' WHEN us <= 57600000000 THEN 'REG' ELSE 'POST' END AS session FROM s",
)
def session_classes(spark, d):
    return load(spark, d, "events").select("event_id", C.session_class(F.col("ts")).alias("session"))


@register(
    "last_completed_close",
    "l AS (SELECT event_id, ts, ts - INTERVAL 5 HOUR AS lt FROM events)",
    "a AS (SELECT *, CAST(CASE WHEN hour(lt) < 16 THEN CAST(lt AS DATE) - 1 ELSE CAST(lt AS DATE) END AS DATE) AS dd FROM l)",
    "b AS (SELECT *, CAST(dd - CAST(greatest(isodow(dd) - 5, 0) AS INT) AS DATE) AS td, CAST(CAST(lt AS DATE) + CAST(5 - isodow(lt) AS INT) AS DATE) AS fri FROM a)",
    sql="""SELECT event_id, epoch_us(CAST(td AS TIMESTAMP) + INTERVAL 21 HOUR) AS last_close, epoch_us(CASE WHEN isodow(lt) >= 6 THEN CAST(fri AS TIMESTAMP) + INTERVAL 21 HOUR
  ELSE date_trunc('hour', ts) END) AS cutoff FROM b""",
)
def last_completed_close(spark, d):
    ts = F.col("ts")
    friday = C.display_friday(F.to_date(C.local_time(ts)))
    return load(spark, d, "events").select(
        "event_id", F.unix_micros(C.last_completed_close(ts)).alias("last_close"), F.unix_micros(C.refresh_cutoff(ts, friday)).alias("cutoff")
    )


@register(
    "weekday_labels",
    """x AS (SELECT event_id, CAST(ts AS DATE) AS day, CASE event_id % 6 WHEN 0 THEN CAST(event_id % 9 AS VARCHAR) WHEN 1 THEN ' tuesday' WHEN 2 THEN 'Fri' WHEN 3 THEN 'holiday' WHEN 4 THEN NULL ELSE '-1' END AS raw FROM events)""",
    "n AS (SELECT *, upper(substr(trim(raw), 1, 3)) AS t, TRY_CAST(raw AS INT) AS k, ['MON','TUE','WED','THU','FRI','SAT','SUN'] AS names FROM x)",
    sql="SELECT event_id, CASE WHEN k BETWEEN 0 AND 6 THEN names[k + 1] WHEN k IS NULL AND list_contains(names, t) THEN t ELSE names[isodow(day)] END AS dow FROM n",
)
def weekday_labels(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 6 == 0, (i % 9).cast("string")).when(i % 6 == 1, " tuesday").when(i % 6 == 2, "Fri").when(i % 6 == 3, "holiday").when(i % 6 == 4, None).otherwise("-1")
    return load(spark, d, "events").select("event_id", C.weekday_label(raw, F.to_date("ts")).alias("dow"))


@register(
    "snapshot_schedule",
    "b AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders)",
    "ds AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)",
    "w AS (SELECT d AS week_monday, CAST(d + 4 AS DATE) AS expiry FROM ds WHERE isodow(d) = 1)",
    "r AS (SELECT w.*, CAST(week_monday + o AS DATE) AS asof_day FROM w, (SELECT unnest([0, 1, 2, 3, 5]) AS o))",
    sql="""SELECT week_monday, expiry, asof_day AS asof, CASE WHEN asof_day > expiry THEN 'after_expiry' WHEN asof_day < lo OR asof_day > hi THEN 'out_of_range' ELSE 'kept' END AS status FROM r, b""".replace(
        "asof_day AS asof", 'asof_day AS "asof"'
    ),
)
def snapshot_schedule(spark, d):
    o = load(spark, d, "orders").select(F.to_date("o_orderdate").alias("d"))
    lo, hi = o.agg(F.min("d"), F.max("d")).first()
    return C.schedule_from_days(o.distinct(), lo, hi, asof_weekdays=(0, 1, 2, 3, 5))


@register(
    "expiry_schedule_by_dte",
    "ds AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)",
    "r AS (SELECT CAST(d - CAST(isodow(d) - 1 AS INT) AS DATE) AS week_monday, d AS expiry, CAST(d - o AS DATE) AS asof_day FROM ds, (SELECT unnest([1, 2, 3, 7]) AS o) WHERE isodow(d) IN (3, 5))",
    sql="""SELECT week_monday, expiry, asof_day AS "asof", 'kept' AS status FROM r""",
)
def expiry_schedule_by_dte(spark, d):
    o = load(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return C.schedule_from_days(
        o, F.lit(None).cast("date"), F.lit(None).cast("date"), "expiry_range", (2, 4), dte=C.parse_dte("1-3,7,2")
    )


# Rules of the exchange's closed and half days over a table ds (d), Easter by Gauss' formula for 1900 to 2099.
SESSIONS = (
    "ea AS (SELECT d, year(d) AS y, month(d) AS m, day(d) AS k, isodow(d) AS w, (19 * (year(d) % 19) + 24) % 30 AS gd FROM ds)",
    "eb AS (SELECT *, (2 * (y % 4) + 4 * (y % 7) + 6 * gd + 5) % 7 AS ge FROM ea)",
    """ec AS (SELECT *, CAST(make_date(y, 3, 22) + CAST(gd + ge - CASE WHEN ge = 6 AND (gd = 29 OR (gd = 28 AND y % 19 > 10)) THEN 7 ELSE 0 END AS INT) AS DATE) AS easter,
   CASE w WHEN 5 THEN strftime(d + INTERVAL 1 DAY, '%m%d') WHEN 1 THEN strftime(d - INTERVAL 1 DAY, '%m%d') ELSE '' END AS moved, strftime(d, '%m%d') AS md FROM eb)""",
    """hd AS (SELECT *, md IN ('0101', '0704', '1225') OR moved IN ('0704', '1225') OR (w = 1 AND moved = '0101') OR (y >= 2022 AND (md = '0619' OR moved = '0619'))
   OR (w = 1 AND ((m = 1 AND k BETWEEN 15 AND 21 AND y >= 1998) OR (m = 2 AND k BETWEEN 15 AND 21) OR (m = 5 AND k > 24) OR (m = 9 AND k < 8)))
   OR (w = 4 AND m = 11 AND k BETWEEN 22 AND 28) OR d = CAST(easter - 2 AS DATE) AS holiday FROM ec)""",
    "se AS (SELECT d, (m = 11 AND w = 5 AND k BETWEEN 23 AND 29) OR (md IN ('0703', '1224') AND w < 5) AS half FROM hd WHERE w < 6 AND NOT holiday)",
)
#: Half of the events move to the weeks of Thanksgiving and Christmas; all of them are in winter time, UTC - 5.
SEASON = "ev AS (SELECT event_id, ts + INTERVAL (330 * (event_id % 2)) DAY AS ts FROM events)"
SEASON_DAYS = "ds AS (SELECT DISTINCT CAST(unnest(generate_series((SELECT min(ts) FROM ev) - INTERVAL 15 DAY, (SELECT max(ts) FROM ev), INTERVAL 1 DAY)) AS DATE) AS d)"
HOURS = "ho AS (SELECT d, CAST(d AS TIMESTAMP) + INTERVAL 870 MINUTE AS o, CAST(d AS TIMESTAMP) + CASE WHEN half THEN INTERVAL 18 HOUR ELSE INTERVAL 21 HOUR END AS c FROM se)"


def season(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", (F.col("ts") + F.make_dt_interval((F.col("event_id") % 2 * 330).cast("int"))).alias("ts"))


@register(
    "market_calendar",
    "ds AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + CAST(y * 3653 AS INT) AS d FROM orders, (SELECT unnest([0, 1, 2, 3]) AS y))",
    *SESSIONS,
    sql="SELECT CAST(d AS DATE) AS session_date, half AS half_day FROM se",
)
def market_calendar(spark, d):
    days = load(spark, d, "orders").select(F.to_date("o_orderdate").alias("o")).distinct()
    days = days.select(F.explode(F.array(*[F.date_add("o", 3653 * y) for y in range(4)])).alias("d"))
    return Se.us_sessions(days).select("session_date", "half_day")


@register(
    "session_classes_by_calendar",
    SEASON,
    SEASON_DAYS,
    *SESSIONS,
    HOURS,
    "l AS (SELECT event_id, ts, CAST(ts - INTERVAL 5 HOUR AS DATE) AS ld FROM ev)",
    """x AS (SELECT event_id, ts, coalesce(o, CAST(ld AS TIMESTAMP) + INTERVAL 870 MINUTE) AS o, coalesce(c, CAST(ld AS TIMESTAMP) + INTERVAL 21 HOUR) AS c FROM l LEFT JOIN ho ON ho.d = ld)""",
    sql="SELECT event_id, CASE WHEN ts < o THEN 'PRE' WHEN ts <= c THEN 'REG' ELSE 'POST' END AS session, (SELECT epoch_us(max(c)) FROM ho WHERE ho.c <= x.ts) AS last_close FROM x",
)
def session_classes_by_calendar(spark, d):
    x = season(spark, d)
    sessions = Se.us_sessions(Se.day_span(x, "ts"))
    out = Se.with_last_close(Se.with_session_class(x, "ts", sessions), "ts", sessions)
    return out.select("event_id", "session", F.unix_micros("last_close").alias("last_close"))


@register(
    "schedule_with_closed_days",
    "os AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)",
    "ds AS (SELECT DISTINCT CAST(d - o AS DATE) AS d FROM os, (SELECT unnest([1, 3, 5, 7]) AS o))",
    *SESSIONS,
    "r AS (SELECT CAST(os.d - CAST(isodow(os.d) - 1 AS INT) AS DATE) AS week_monday, os.d AS expiry, CAST(os.d - o AS DATE) AS asof_day FROM os, (SELECT unnest([1, 3, 5, 7]) AS o) WHERE isodow(os.d) IN (3, 5))",
    sql="""SELECT week_monday, expiry, asof_day AS "asof", CASE WHEN se.d IS NULL THEN 'no_session' ELSE 'kept' END AS status FROM r LEFT JOIN se ON se.d = asof_day""",
)
def schedule_with_closed_days(spark, d):
    o = load(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    none = F.lit(None).cast("date")
    planned = C.schedule_from_days(o, none, none, "expiry_range", (2, 4), dte=C.dte_span(1, 7, 2))
    return Se.mark_closed_days(planned, Se.us_sessions(planned, "asof"))


_M = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


def _dt(col: str, pat: str) -> str:
    e = lambda g: f"regexp_extract({col}, '{pat}', {g}, 'i')"
    return f"""TRY_CAST(CASE WHEN {e(3)} <> '' THEN concat({e(3)}, '-', lpad(CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr({e(1)}, 1, 3))) + 2) // 3 AS VARCHAR), 2, '0'), '-', lpad({e(2)}, 2, '0')) END AS DATE)"""


_LONG = _M + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
_WEEK = r"week\s+(?:of|ending)\s+" + _M + r"\s+(\d{1,2})(?:-\d{1,2})?,?\s+(\d{4})"
_SLUG = _M + r"-(\d{1,2})-(\d{4})"
PARSED = f"""parsed AS (SELECT *, nullif(regexp_extract(slug, '^([a-z0-9]+)(?:-close)?-above', 1), '') AS prefix,
  TRY_CAST(replace(coalesce(nullif(regexp_extract(question, '\\$([0-9][0-9,]*(?:\\.\\d+)?)', 1), ''), nullif(regexp_extract(question, '\\babove\\s+([0-9][0-9,]*(?:\\.\\d+)?)\\b', 1, 'i'), '')), ',', '') AS DOUBLE) AS threshold,
  coalesce({_dt('question', _LONG)}, {_dt('question', _WEEK)}) AS qd, {_dt('slug', _SLUG)} AS sd FROM titles)"""
ALLOW = ["T3", "T1", "AAPL", "T7"]


@register(
    "parsed_titles",
    TITLES,
    PARSED,
    """t AS (SELECT *, CASE WHEN prefix IN ('t3', 't1', 'aapl', 't7') THEN upper(prefix) END AS a, CASE WHEN regexp_matches(upper(question), '\\bT3\\b') THEN 'T3' WHEN regexp_matches(upper(question), '\\bT1\\b') THEN 'T1'
   WHEN regexp_matches(upper(question), '\\bAAPL\\b') THEN 'AAPL' WHEN regexp_matches(upper(question), '\\bT7\\b') THEN 'T7' END AS b, CASE WHEN regexp_matches(lower(question), '\\bapple\\b') THEN 'AAPL' END AS c,
   nullif(regexp_extract(question, '\\b([A-Z]{1,6})\\b', 1), '') AS e FROM parsed)""",
    sql="""SELECT market_id, coalesce(a, b, c, upper(prefix), e) AS ticker, CASE WHEN a IS NOT NULL THEN 'slug' WHEN b IS NOT NULL THEN 'question' WHEN c IS NOT NULL THEN 'company_name' WHEN prefix IS NOT NULL THEN 'slug_fallback'
   WHEN e IS NOT NULL THEN 'question_fallback' ELSE 'none' END AS ticker_source, threshold, coalesce(qd, sd) AS expiry_date,
   epoch_us(coalesce(CASE WHEN regexp_matches(resolved_time, '^\\d+$') THEN make_timestamp(CASE WHEN CAST(resolved_time AS DOUBLE) > 1000000000000 THEN CAST(resolved_time AS BIGINT) * 1000 ELSE CAST(resolved_time AS BIGINT) * 1000000 END)
     ELSE TRY_CAST(resolved_time AS TIMESTAMP) END, CAST(coalesce(qd, sd) AS TIMESTAMP) + INTERVAL 86399 SECOND)) AS resolution_us,
   least(0.9::DOUBLE, CASE WHEN coalesce(a, b, c, upper(prefix), e) IS NULL THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN threshold IS NULL THEN 0.0::DOUBLE ELSE 0.4::DOUBLE END + CASE WHEN coalesce(qd, sd) IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END) AS mapping_confidence,
   (lower(question) LIKE '%week%' AND (lower(question) LIKE '%finish%' OR lower(question) LIKE '%ending%' OR lower(question) LIKE '%close%') AND (lower(question) LIKE '%above%' OR lower(question) LIKE '%over%' OR question LIKE '%$%'))
     OR slug LIKE '%-above-on-%' AS is_weekly, CASE WHEN token_ids LIKE '[%' THEN concat('y', CAST(market_id AS VARCHAR)) END AS yes_token FROM t""",
)
def parsed_titles(spark, d):
    from strikelake.plans.markets import dim_market_from_titles

    out = dim_market_from_titles(titles(spark, d), ALLOW)
    return out.select(
        "market_id", "ticker", "ticker_source", "threshold", "expiry_date", F.unix_micros("resolution_time_utc").alias("resolution_us"),
        "mapping_confidence", "is_weekly", F.col("outcome_yes_token_id").alias("yes_token"),
    )
