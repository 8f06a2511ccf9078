"""Scans, landed records, sinks and their round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelake.catalog import register
from strikelake.operators import bars
from strikelake.operators.skew import with_scalars
from strikelake.plans import markets as MK
from strikelake.session import scratch_path
from strikelake.sources import landing, readers, sinks
from strikelake.sources.tables import TICKS, TITLES, load, ticks, titles


@register(
    "scan_by_suffix",
    sql="""SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1""",
)
def scan_by_suffix(spark, d):
    o = readers.read_dataset(spark, f"{d}/orders.parquet")
    return o.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))


@register("csv_twin_fallback", sql="SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_twin_fallback(spark, d):
    path = scratch_path(spark, "customer")
    load(spark, d, "customer").write.option("header", True).csv(f"{path}.csv")
    schema = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    return readers.read_dataset(spark, f"{path}.parquet", schema).select("c_custkey", "c_name", "c_acctbal")


@register(
    "checked_csv_scan",
    sql="SELECT count(*) AS bad_lines, (SELECT count(*) FROM orders WHERE o_orderkey % 7 <> 0) AS good_lines FROM orders WHERE o_orderkey % 7 = 0",
)
def checked_csv_scan(spark, d):
    from pyspark.sql.types import StructType

    path = scratch_path(spark, "lines")
    k = F.col("o_orderkey")
    body = F.when(k % 7 == 0, F.concat(k.cast("string"), F.lit(",oops"))).otherwise(F.concat_ws(",", k.cast("string"), F.col("o_totalprice").cast("string")))
    load(spark, d, "orders").select(body.alias("value")).write.text(path)
    good, bad = readers.read_checked_csv(spark, path, StructType.fromDDL("k BIGINT, price DOUBLE"), header=False)
    return with_scalars(bad, good.agg(F.count("k").alias("good_lines")))


BENCH = """b AS (SELECT upper(concat('s', CAST(l_suppkey % 10 AS VARCHAR))) AS ticker, round(CAST(l_partkey % 50 AS DOUBLE) + 0.00000002::DOUBLE, 6) AS threshold,
   CAST(date_trunc('month', l_shipdate) AS DATE) AS expiry_date, CAST(l_shipdate AS DATE) AS ad, l_discount AS prn, l_tax AS rv FROM lineitem)"""


@register(
    "benchmark_scan",
    BENCH,
    "f AS (SELECT * FROM b WHERE ad BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' AND ticker IN ('S1', 'S2', 'S3', 'S4') AND threshold IN (SELECT CAST(p_size AS DOUBLE) FROM part))",
    sql="""SELECT ticker, threshold, expiry_date, ad AS snapshot_date, max_by(prn, (prn, rv)) AS "pRN", max_by(rv, (prn, rv)) AS rv20 FROM f GROUP BY 1, 2, 3, 4""",
)
def benchmark_scan(spark, d):
    s = load(spark, d, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string")).alias("ticker"), ((F.col("l_partkey") % 50) + 0.00000002).alias("K"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("option_expiration_used"), F.to_date("l_shipdate").alias("asof_date"),
        F.col("l_discount").alias("pRN"), F.col("l_tax").alias("rv20"), F.col("l_quantity").alias("unused"),
    )
    names = load(spark, d, "region").select(F.concat(F.lit("S"), F.col("r_regionkey").cast("string"))).where(F.col("r_regionkey") >= 1)
    sizes = load(spark, d, "part").select(F.col("p_size").cast("double")).distinct()
    out = readers.scan_benchmark(s, ["pRN", "rv20"], tickers=names, thresholds=sizes, start="1997-01-01", end="1999-12-31")
    return out.select("ticker", "threshold", "expiry_date", "snapshot_date", "pRN", "rv20")


HOURLY = """hourly AS (SELECT market_id, date_trunc('hour', timestamp_utc) AS h, arg_min(price, (timestamp_utc, event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (timestamp_utc, event_id)) AS close FROM ticks GROUP BY 1, 2)"""


@register(
    "partitioned_bar_scan",
    TICKS,
    HOURLY,
    sql="""SELECT market_id, epoch_us(h) AS timestamp_utc, open, close FROM hourly WHERE CAST(h AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-12'
   AND market_id IN (SELECT user_id FROM events WHERE event_type = 'error')""",
)
def partitioned_bar_scan(spark, d):
    path = scratch_path(spark, "bars")
    t = ticks(spark, d)
    sinks.write_bars(bars.ohlc(t, "1h"), path, "1h")
    sinks.write_bars(bars.ohlc(t, "1d"), path, "1d")
    wanted = t.where(F.col("event_type") == "error").select("market_id")
    out = readers.scan_bars(spark, path, "1h", wanted, "2024-01-08", "2024-01-12")
    return out.select("market_id", F.unix_micros("timestamp_utc").alias("timestamp_utc"), "open", "close")


@register(
    "bar_scan_past_bad_files",
    TICKS,
    HOURLY,
    sql="""SELECT CAST(h AS DATE) AS date, count(*) AS bars, 1::BIGINT AS skipped_files FROM hourly WHERE CAST(h AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-12' GROUP BY 1""",
)
def bar_scan_past_bad_files(spark, d):
    """Two broken files lie among the bars, one of them inside the range."""
    path = scratch_path(spark, "bars")
    sinks.write_bars(bars.ohlc(ticks(spark, d), "1h"), path, "1h")
    for day in ("2024-01-09", "2024-01-20"):
        load(spark, d, "region").select("r_name").coalesce(1).write.mode("append").text(f"{path}/freq=1h/date={day}")
    schema = "market_id bigint, timestamp_utc timestamp, close double"
    out, counted = readers.scan_bars_counted(spark, path, schema, "1h", start="2024-01-08", end="2024-01-12")
    return with_scalars(out.groupBy("date").agg(F.count("*").alias("bars")), counted.select("skipped_files"))


@register(
    "price_history_slice",
    TICKS,
    sql="""SELECT event_id, price FROM ticks WHERE token_role = 'no' AND timestamp_utc BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 12:00:00'
   AND market_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
)
def price_history_slice(spark, d):
    markets = load(spark, d, "supplier").where(F.col("s_acctbal") > 0).select("s_suppkey")
    at = lambda x: F.lit(x).cast("timestamp")
    return readers.price_slice(ticks(spark, d), markets, ["NO"], at("2024-01-05"), at("2024-01-25 12:00:00")).select("event_id", "price")


@register(
    "landed_trades",
    sql="""SELECT concat(CAST(event_id AS VARCHAR), '-', CAST(n AS VARCHAR)) AS trade_id, user_id AS market, epoch_us(date_trunc('second', ts)) AS timestamp_utc,
  CASE WHEN event_id % 10 <> 0 THEN value END AS price, CASE n WHEN 1 THEN 'buy' ELSE 'sell' END AS side, event_id AS block_number
  FROM events, (SELECT unnest([1, 2]) AS n)""",
)
def landed_trades(spark, d):
    path = scratch_path(spark, "trades")
    one = lambda n, side: F.struct(
        F.concat(F.col("event_id").cast("string"), F.lit(f"-{n}")).alias("id"), F.col("user_id").cast("string").alias("marketId"),
        F.when(F.col("event_id") % 10 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("price"), F.lit(side).alias("side"),
        F.unix_seconds("ts").cast("string").alias("timestamp"), F.col("event_id").cast("string").alias("blockNumber"),
    )
    load(spark, d, "events").select(F.array(one(1, "BUY"), one(2, "Sell")).alias("trades")).write.json(path)
    t = readers.normalize_trades(landing.load_entities(spark, path, "trades", multi_line=False))
    return t.select(
        "trade_id", F.col("market_id").cast("bigint").alias("market"), F.unix_micros("timestamp_utc").alias("timestamp_utc"), "price", "side", "block_number"
    )


@register(
    "landed_payout_conditions",
    sql="""SELECT concat('c', CAST(p_partkey AS VARCHAR)) AS id, CAST(p_size % 3 AS VARCHAR) AS first_payout, 2::BIGINT AS outcomes, CAST(p_size AS VARCHAR) AS "payoutDenominator" FROM part""",
)
def landed_payout_conditions(spark, d):
    path = scratch_path(spark, "conditions")
    row = F.struct(
        F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("id"),
        F.array((F.col("p_size") % 3).cast("string"), F.lit("1")).alias("payoutNumerators"), F.col("p_size").cast("string").alias("payoutDenominator"),
        F.lit("extra").alias("unknownField"),
    )
    load(spark, d, "part").select(F.array(row).alias("conditions")).write.json(path)
    c = landing.load_entities(spark, path, "pnlConditions", multi_line=False)
    return c.select("id", F.col("payoutNumerators")[0].alias("first_payout"), F.size("payoutNumerators").cast("bigint").alias("outcomes"), "payoutDenominator")


@register(
    "flattened_price_payload",
    "p AS (SELECT event_id, ts, value / 300.0 AS a, value / 600.0 AS b FROM events)",
    "u AS (SELECT event_id, epoch_us(date_trunc('second', ts)) AS us, a AS price FROM p UNION ALL SELECT event_id, epoch_us(date_trunc('second', ts)) + 60000000, b FROM p)",
    sql="SELECT event_id AS token_id, us AS timestamp_utc, price FROM u WHERE price BETWEEN 0 AND 1",
)
def flattened_price_payload(spark, d):
    s = F.unix_seconds("ts")
    point = lambda t, p: F.struct(t.alias("t"), p.alias("p"))
    body = F.to_json(
        F.struct(F.array(point(s, F.col("value") / 300.0), point(s + 60, F.col("value") / 600.0), point(s + 90, F.lit(-0.5))).alias("history"))
    )
    raw = load(spark, d, "events").select(F.col("event_id").alias("token_id"), body.alias("payload"))
    return readers.flatten_price_payload(raw).withColumn("timestamp_utc", F.unix_micros("timestamp_utc"))


@register(
    "weekly_markets_from_events",
    TITLES,
    """m AS (SELECT *, market_id // 4 AS ev, CAST(DATE '2024-01-01' + CAST(market_id % 60 AS INT) AS DATE) AS ed,
   upper(coalesce(nullif(regexp_extract(question, 'Will (T[0-9]+) finish', 1), ''), regexp_extract(slug, '^(t[0-9]+)-above', 1))) AS tk,
   TRY_CAST(replace(regexp_extract(question, 'above [$]?([0-9,]+([.][0-9]+)?)', 1), ',', '') AS DOUBLE) AS threshold FROM titles)""",
    sql="""SELECT market_id, ev AS event_id, tk AS ticker, threshold, ed AS event_end_date,
  CAST(ed - CAST(isodow(ed) - 1 AS INT) + 4 AS DATE) AS week_friday, CASE WHEN market_id % 6 <> 0 THEN concat('n', CAST(market_id AS VARCHAR)) END AS no_token FROM m
  WHERE threshold IS NOT NULL AND regexp_full_match(tk, 'T[0-8]')""",
)
def weekly_markets_from_events(spark, d):
    t = titles(spark, d)
    key = F.col("market_id")
    m = F.struct(
        key.cast("string").alias("id"), "question", "slug", F.col("condition_id").alias("conditionId"), F.col("token_ids").alias("clobTokenIds"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 60).cast("int")).cast("string").alias("endDate"),
    )
    # Four neighbouring market ids make one event, so an event is small whatever the table size.
    events = t.groupBy(F.floor(key / 4).alias("id")).agg(F.collect_list(m).alias("markets")).select(
        "id", F.lit("e").alias("slug"), F.lit("Event").alias("title"), F.lit(None).cast("string").alias("endDate"), "markets"
    )
    allow = [f"T{i}" for i in range(9)]
    out = MK.dimension_from_weekly(MK.weekly_markets(events, allow))
    weekly = MK.weekly_markets(events, allow).select("market_id", "event_id", "event_end_date", "week_friday")
    return out.join(weekly, "market_id").select(
        F.col("market_id").cast("bigint").alias("market_id"), "event_id", "ticker", "threshold", "event_end_date", "week_friday",
        F.col("outcome_no_token_id").alias("no_token"),
    )


@register(
    "append_with_new_columns",
    sql="""SELECT c_custkey, c_acctbal, NULL AS c_name, 0::BIGINT AS part FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, c_acctbal, c_name, 1 FROM customer WHERE c_custkey % 2 = 1""",
)
def append_with_new_columns(spark, d):
    path = scratch_path(spark, "append")
    c = load(spark, d, "customer").withColumn("part", F.col("c_custkey") % 2)
    sinks.append(c.where(F.col("part") == 0).select("c_custkey", "c_acctbal", "part"), path, ["part"])
    sinks.append(c.where(F.col("part") == 1).select("c_custkey", "c_acctbal", "c_name", "part"), path, ["part"], "c_custkey")
    return sinks.read_union(spark, path).select("c_custkey", "c_acctbal", "c_name", F.col("part").cast("bigint").alias("part"))


@register(
    "overwrite_touched_partitions",
    TICKS,
    "x AS (SELECT event_id, price, CAST(timestamp_utc AS DATE) AS day FROM ticks)",
    sql="""SELECT event_id, CASE WHEN day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' THEN -price ELSE price END AS price, day FROM x
  WHERE day NOT BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' OR event_id % 2 = 0""",
)
def overwrite_touched_partitions(spark, d):
    path = scratch_path(spark, "daily")
    x = ticks(spark, d).select("event_id", "price", F.to_date("timestamp_utc").alias("day"))
    sinks.append(x, path, ["day"], "event_id")
    redo = x.where(F.col("day").between(F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date")) & (F.col("event_id") % 2 == 0))
    sinks.overwrite_partitions(redo.withColumn("price", -F.col("price")), path, ["day"], "event_id")
    return spark.read.parquet(path)


@register(
    "weekly_partition_rebuild",
    TICKS,
    "x AS (SELECT event_id, market_id, CAST(CAST(timestamp_utc AS DATE) - CAST(isodow(timestamp_utc) - 5 AS INT) AS DATE) AS week_friday FROM ticks)",
    sql="""SELECT week_friday, count(*) AS rows, count(DISTINCT market_id) AS markets FROM x WHERE week_friday <> DATE '2024-01-12' OR event_id % 3 = 0 GROUP BY 1""",
)
def weekly_partition_rebuild(spark, d):
    from strikelake.functions.calendar import display_friday

    path = scratch_path(spark, "weeks")
    x = ticks(spark, d).select("event_id", "market_id", display_friday(F.to_date("timestamp_utc")).alias("week_friday"))
    sinks.append(x, path, ["week_friday"], "event_id")
    week = x.where((F.col("week_friday") == F.lit("2024-01-12").cast("date")) & (F.col("event_id") % 3 == 0))
    sinks.overwrite_partitions(week, path, ["week_friday"], "event_id")
    per = spark.read.parquet(path).groupBy("week_friday", "market_id").agg(F.count("*").alias("_n"))
    return per.groupBy("week_friday").agg(F.sum("_n").alias("rows"), F.count("market_id").alias("markets"))


@register(
    "contract_type_history",
    sql="""SELECT CASE WHEN o_orderstatus = 'F' THEN 'weekly' ELSE '1dte' END AS contract_type, count(*) AS rows FROM orders GROUP BY 1""",
)
def contract_type_history(spark, d):
    path = scratch_path(spark, "history")
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    sinks.append_history(o.where(F.col("o_orderstatus") == "F"), path, "Weekly")
    sinks.append_history(o.where(F.col("o_orderstatus") != "F"), path, "close_today")
    return spark.read.parquet(path).groupBy(F.col("contract_type").cast("string").alias("contract_type")).agg(F.count("*").alias("rows"))


@register(
    "dataset_preview_tail",
    sql="""(SELECT 'tail' AS mode, o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)
  UNION ALL (SELECT 'head', o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20)""",
)
def dataset_preview_tail(spark, d):
    o = load(spark, d, "orders")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    part = lambda tail: readers.preview(o, order, 20, tail).select(F.lit("tail" if tail else "head").alias("mode"), "o_orderkey", "o_totalprice")
    return part(True).unionByName(part(False))


@register(
    "trades_by_date",
    "t AS (SELECT CAST(ts AS DATE) AS date, value FROM events)",
    sql="SELECT date, count(*) AS n, max(value) AS top FROM t GROUP BY 1",
)
def trades_by_date(spark, d):
    path = scratch_path(spark, "fills")
    e = load(spark, d, "events").select(F.col("event_id").alias("trade_id"), F.col("ts").alias("timestamp_utc"), F.col("value").alias("price"))
    sinks.write_trades(e, path)
    return spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("n"), F.max("price").alias("top"))
