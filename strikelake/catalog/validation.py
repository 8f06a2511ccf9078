"""Summaries, profiles, coverage, contract checks and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelake.catalog import register
from strikelake.functions import calendar
from strikelake.functions.scalar import round_half_up as r
from strikelake.operators import bars, quality as Q
from strikelake.sources.tables import CLOSES, LABELLED, QUOTES, TICKS, closes, labelled, load, option_quotes, ticks


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"


@register(
    "dataset_summary",
    LABELLED,
    "w AS (SELECT count(DISTINCT CAST(asof_date + CAST((4 - (isodow(asof_date) - 1) + 7) % 7 AS INT) AS DATE)) AS n FROM labelled)",
    "t AS (SELECT DISTINCT upper(CAST(ticker AS VARCHAR)) AS t FROM labelled)",
    sql="""SELECT count(*) AS rows, min(asof_date) AS date_start, max(asof_date) AS date_end, (SELECT n FROM w) AS week_count,
  (SELECT count(*) FROM t) AS ticker_count, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT t FROM t ORDER BY t LIMIT 8)) AS ticker_sample FROM labelled""",
)
def dataset_summary(spark, d):
    return Q.dataset_summary(labelled(spark, d), "asof_date")


@register(
    "column_profile",
    "o AS (SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_orderstatus END AS status, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS cust FROM orders)",
    sql=f"""SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, 0.0::DOUBLE AS missing_pct, count(DISTINCT o_orderkey) AS n_unique FROM o
  UNION ALL SELECT 'status', 'string', {r6('100.0::DOUBLE * (count(*) - count(status)) / count(*)')}, count(DISTINCT status) FROM o
  UNION ALL SELECT 'cust', 'bigint', {r6('100.0::DOUBLE * (count(*) - count(cust)) / count(*)')}, count(DISTINCT cust) FROM o""",
)
def column_profile(spark, d):
    o = load(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 200000, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_custkey") % 3 == 0, None).otherwise(F.col("o_custkey")).alias("cust"),
    )
    return Q.column_profile(o).withColumn("missing_pct", r(F.col("missing_pct"), 6))


@register(
    "horizon_regime",
    "t AS (SELECT l_suppkey AS ticker, CASE WHEN l_suppkey % 3 = 0 THEN 1 WHEN l_suppkey % 3 = 1 THEN l_linenumber % 4 + 1 ELSE l_linenumber END AS t FROM lineitem)",
    "g AS (SELECT ticker, avg(CASE WHEN t = 1 THEN 1.0 ELSE 0 END) AS d, avg(CASE WHEN t BETWEEN 1 AND 4 THEN 1.0 ELSE 0 END) AS w, count(DISTINCT CASE WHEN t BETWEEN 1 AND 4 THEN t END) AS u FROM t GROUP BY 1)",
    sql="SELECT ticker, d >= 0.85 AS is_daily, w >= 0.95 AND u >= 2 AS is_weekly FROM g",
)
def horizon_regime(spark, d):
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    t = load(spark, d, "lineitem").select(
        s.alias("ticker"), F.when(s % 3 == 0, 1).when(s % 3 == 1, n % 4 + 1).otherwise(n).cast("double").alias("T_days")
    )
    return Q.tdays_regime(t, by=["ticker"])


@register(
    "regime_preview",
    LABELLED,
    "k AS (SELECT * FROM labelled WHERE l_linenumber IN (1, 2) AND isodow(asof_date) = 3)",
    sql="""SELECT l_linenumber AS t_days, count(*) AS rows, (SELECT count(*) FROM labelled) AS rows_before, (SELECT count(*) FROM k) AS rows_after,
  (SELECT count(DISTINCT ticker) FROM k) AS tickers_after FROM k GROUP BY 1""",
)
def regime_preview(spark, d):
    keep = F.col("l_linenumber").isin(1, 2) & (F.weekday("asof_date") == 2)
    return Q.regime_preview(labelled(spark, d), keep, "l_linenumber")


@register(
    "schema_null_fractions",
    "o AS (SELECT o_totalprice AS S, CASE WHEN o_custkey % 20 = 0 THEN o_custkey END AS pRN, CASE WHEN o_custkey % 10 < 4 THEN 1 END AS K FROM orders)",
    sql=f"""SELECT 'S' AS "column", {r6('avg(CASE WHEN S IS NULL THEN 1.0::DOUBLE ELSE 0.0 END)')} AS null_frac, 'ok' AS severity FROM o
  UNION ALL SELECT 'pRN', {r6('avg(CASE WHEN pRN IS NULL THEN 1.0::DOUBLE ELSE 0.0 END)')}, 'error' FROM o
  UNION ALL SELECT 'K', {r6('avg(CASE WHEN K IS NULL THEN 1.0::DOUBLE ELSE 0.0 END)')}, 'warning' FROM o
  UNION ALL SELECT 'rv20', 1.0, 'error'""",
)
def schema_null_fractions(spark, d):
    o = load(spark, d, "orders").select(
        F.col("o_totalprice").alias("S"), F.when(F.col("o_custkey") % 20 == 0, F.col("o_custkey")).alias("pRN"),
        F.when(F.col("o_custkey") % 10 < 4, 1).alias("K"),
    )
    return Q.schema_verdict(o, ["S", "pRN", "K", "rv20"]).withColumn("null_frac", r(F.col("null_frac"), 6))


@register(
    "date_coverage_gaps",
    CLOSES,
    "c AS (SELECT * FROM closes WHERE (CAST(epoch(date) AS BIGINT) // 86400 + ticker) % 9 <> 0)",
    """need AS (SELECT ticker, CAST(unnest(generate_series(DATE '1994-12-20', DATE '2001-08-20', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT DISTINCT ticker FROM c))""",
    "miss AS (SELECT n.* FROM need n LEFT JOIN c ON c.ticker = n.ticker AND c.date = n.d WHERE c.ticker IS NULL)",
    "g AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY ticker ORDER BY d) AS INT) AS grp FROM miss)",
    sql="SELECT ticker, min(d) AS gap_start, max(d) AS gap_end, count(*) AS days FROM g GROUP BY ticker, grp",
)
def date_coverage_gaps(spark, d):
    c = closes(spark, d).where((F.unix_date("date") + F.col("ticker")) % 9 != 0)
    return Q.date_gaps(c, F.lit("1994-12-20").cast("date"), F.lit("2001-08-20").cast("date"))


@register(
    "rows_per_bar_frequency",
    TICKS,
    sql="""SELECT '5m' AS freq, count(*) AS n FROM (SELECT DISTINCT market_id, time_bucket(INTERVAL 5 MINUTE, timestamp_utc) FROM ticks)
  UNION ALL SELECT '1h', count(*) FROM (SELECT DISTINCT market_id, date_trunc('hour', timestamp_utc) FROM ticks)
  UNION ALL SELECT '1d', count(*) FROM (SELECT DISTINCT market_id, CAST(timestamp_utc AS DATE) FROM ticks)""",
)
def rows_per_bar_frequency(spark, d):
    t = ticks(spark, d)
    parts = [bars.ohlc(t, f, fill_gaps=False).select(F.lit(f).alias("freq")) for f in ("5m", "1h", "1d")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("freq").agg(F.count("*").alias("n"))


RUNS = """runs AS (SELECT CASE WHEN l_linenumber < 3 THEN 'test' ELSE 'train' END AS split, concat('m', CAST(l_suppkey AS VARCHAR)) AS model, CAST(l_suppkey AS INT) AS run,
  avg(l_discount) AS logloss, sum(CAST(l_tax * 100 AS BIGINT)) AS ece FROM lineitem GROUP BY 1, 2, 3)"""


def _runs(spark, d):
    s = F.col("l_suppkey")
    return load(spark, d, "lineitem").groupBy(
        F.when(F.col("l_linenumber") < 3, "test").otherwise("train").alias("split"), F.concat(F.lit("m"), s.cast("string")).alias("model"),
        s.cast("int").alias("run"),
    ).agg(F.avg("l_discount").alias("logloss"), F.sum((F.col("l_tax") * 100).cast("bigint")).alias("ece"))


@register(
    "best_model_per_split",
    RUNS.replace("avg(l_discount)", "sum(CAST(round(l_discount * 100) AS BIGINT))"),
    sql="SELECT split, min(logloss) AS logloss, min_by(model, (logloss, model)) AS model FROM runs GROUP BY 1",
)
def best_model_per_split(spark, d):
    s = F.col("l_suppkey")
    runs = load(spark, d, "lineitem").groupBy(
        F.when(F.col("l_linenumber") < 3, "test").otherwise("train").alias("split"), F.concat(F.lit("m"), s.cast("string")).alias("model")
    ).agg(F.sum(F.round(F.col("l_discount") * 100).cast("bigint")).alias("logloss"))
    return Q.best_by_metric(runs, ["split"], "logloss", ["model"])


@register(
    "run_signal_heights",
    RUNS,
    "last AS (SELECT run, ece FROM runs WHERE split = 'test' ORDER BY run DESC LIMIT 10)",
    "b AS (SELECT min(ece) AS lo, max(ece) AS hi FROM last)",
    sql="SELECT run, ece, CAST(CASE WHEN hi = lo THEN 70 ELSE round_even(30 + 70 * ((hi - ece)::DOUBLE / (hi - lo)), 0) END AS INT) AS height FROM last, b",
)
def run_signal_heights(spark, d):
    test = _runs(spark, d).where(F.col("split") == "test").select("run", "ece")
    return bars.signal_heights(test, "ece", "run")


@register(
    "metric_table_parity",
    "l AS (SELECT l_suppkey AS split, l_linenumber AS model, min(l_discount) AS logloss, max(l_returnflag) AS tag, count(*) AS n FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1, 2)",
    """rt AS (SELECT l_suppkey AS split, l_linenumber AS model, min(l_discount) + CASE WHEN l_suppkey % 5 = 0 THEN 0.001 ELSE 0.0000000001 END AS logloss,
   CASE WHEN l_suppkey % 4 = 0 THEN 'X' ELSE max(l_returnflag) END AS tag, count(*) AS n FROM lineitem WHERE l_suppkey % 11 <> 0 GROUP BY 1, 2, l_suppkey)""",
    "j AS (SELECT l.split AS a, rt.split AS b, l.logloss AS x, rt.logloss AS y, l.tag AS s, rt.tag AS t, l.n AS n1, rt.n AS n2 FROM l FULL JOIN rt ON l.split = rt.split AND l.model = rt.model)",
    sql="""SELECT 'logloss' AS metric, CAST(count_if(a IS NULL OR b IS NULL OR abs(x - y) > 0.000001) AS BIGINT) AS mismatches FROM j
  UNION ALL SELECT 'tag', CAST(count_if(a IS NULL OR b IS NULL OR s <> t) AS BIGINT) FROM j UNION ALL SELECT 'n', CAST(count_if(a IS NULL OR b IS NULL OR n1 <> n2) AS BIGINT) FROM j""",
)
def metric_table_parity(spark, d):
    s = F.col("split")
    li = load(spark, d, "lineitem").withColumnsRenamed({"l_suppkey": "split", "l_linenumber": "model"})
    agg = lambda x: x.groupBy("split", "model").agg(F.min("l_discount").alias("logloss"), F.max("l_returnflag").alias("tag"), F.count("*").alias("n"))
    left = agg(li.where(s % 7 != 0))
    right = agg(li.where(s % 11 != 0)).withColumns(
        {"logloss": F.col("logloss") + F.when(s % 5 == 0, 0.001).otherwise(0.0000000001), "tag": F.when(s % 4 == 0, "X").otherwise(F.col("tag"))}
    )
    return Q.metric_parity(left, right, ["split", "model"], 1e-6)


@register(
    "drop_reason_counts",
    QUOTES,
    """g AS (SELECT ticker, asof_date, count(*) AS n, count(DISTINCT strike) AS k, min(close) AS c FROM option_quotes GROUP BY 1, 2)""",
    sql="""SELECT CASE WHEN n < 2 THEN 'empty_option_chain' WHEN k < 5 THEN 'cannot_build_curve' WHEN c < 3 THEN 'missing_S0' END AS drop_reason, count(*) AS dropped
  FROM g WHERE n < 2 OR k < 5 OR c < 3 GROUP BY 1""",
)
def drop_reason_counts(spark, d):
    per_strike = option_quotes(spark, d).groupBy("ticker", "asof_date", "strike").agg(F.count("*").alias("_n"), F.min("close").alias("_c"))
    g = per_strike.groupBy("ticker", "asof_date").agg(F.sum("_n").alias("n"), F.count("strike").alias("k"), F.min("_c").alias("c"))
    reason = F.when(F.col("n") < 2, "empty_option_chain").when(F.col("k") < 5, "cannot_build_curve").when(F.col("c") < 3, "missing_S0")
    return Q.drop_log(g, reason)[1]


SNAP = """snap AS (SELECT event_id, ts AS snapshot_time_utc, CASE WHEN event_id % 3 = 0 THEN ts ELSE ts - INTERVAL 1 HOUR END AS spot_asof_utc,
  CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN NULL ELSE 'intraday_1m' END AS spot_source, value - 5 AS T_days,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS expiry_ts_utc, CASE WHEN value > 150 THEN NULL ELSE value / 150 END AS pRN FROM events)"""


def snapshot_rows(spark, d):
    i, ts = F.col("event_id"), F.col("ts")
    return load(spark, d, "events").select(
        "event_id", ts.alias("snapshot_time_utc"), F.when(i % 3 == 0, ts).otherwise(ts - F.expr("INTERVAL 1 HOUR")).alias("spot_asof_utc"),
        F.when(i % 4 == 0, "none").when(i % 4 == 1, None).otherwise("intraday_1m").alias("spot_source"), (F.col("value") - 5).alias("T_days"),
        F.when(i % 50 == 0, None).otherwise(ts).alias("expiry_ts_utc"), F.when(F.col("value") > 150, None).otherwise(F.col("value") / 150).alias("pRN"),
    )


@register(
    "snapshot_row_rules",
    SNAP,
    sql="""SELECT 'spot_time_is_snapshot_time' AS rule, CAST(count_if(coalesce(spot_source, 'none') <> 'none' AND spot_asof_utc <> snapshot_time_utc) AS BIGINT) AS bad_rows FROM snap
  UNION ALL SELECT 'horizon_not_negative', CAST(count_if(T_days < 0) AS BIGINT) FROM snap UNION ALL SELECT 'expiry_present', CAST(count_if(expiry_ts_utc IS NULL) AS BIGINT) FROM snap
  UNION ALL SELECT 'prn_present', CAST(count_if(pRN IS NULL) AS BIGINT) FROM snap""",
)
def snapshot_row_rules(spark, d):
    s = snapshot_rows(spark, d)
    return Q.rule_report(s, Q.snapshot_rules(s.columns))


@register(
    "most_missing_columns",
    SNAP,
    sql=f"""SELECT * FROM (SELECT 'spot_source' AS "column", {r6('avg(CASE WHEN spot_source IS NULL THEN 1.0::DOUBLE ELSE 0.0 END)')} AS null_frac FROM snap
  UNION ALL SELECT 'pRN', {r6('avg(CASE WHEN pRN IS NULL THEN 1.0::DOUBLE ELSE 0.0 END)')} FROM snap UNION ALL SELECT 'expiry_ts_utc', {r6('avg(CASE WHEN expiry_ts_utc IS NULL THEN 1.0::DOUBLE ELSE 0.0 END)')} FROM snap)
  WHERE null_frac > 0 ORDER BY null_frac DESC, "column" LIMIT 2""",
)
def most_missing_columns(spark, d):
    s = snapshot_rows(spark, d)
    return Q.most_missing(s, s.columns, 2).withColumn("null_frac", r(F.col("null_frac"), 6))


@register(
    "fold_delta_statistics",
    LABELLED,
    """dl AS (SELECT CAST(ticker AS INT) AS trial_id, extract(year FROM asof_date) AS fold, avg((p_model - y) * (p_model - y)) - avg((p_base - y) * (p_base - y)) AS delta FROM labelled GROUP BY 1, 2)""",
    sql=f"""SELECT trial_id, count(*) AS n_folds, {r6('avg(delta)')} AS mean_delta, {r6('median(delta)')} AS median_delta, {r6('coalesce(stddev_samp(delta), 0)')} AS std_delta,
  {r6('coalesce(stddev_samp(delta), 0) / sqrt(count(*))')} AS se_delta, CAST(count_if(delta < 0) AS BIGINT) AS folds_improved, {r6('max(delta)')} AS worst_delta FROM dl GROUP BY 1""",
)
def fold_delta_statistics(spark, d):
    out = Q.fold_statistics(fold_deltas(spark, d), delta="delta")
    return out.select(
        "trial_id", "n_folds", "folds_improved", *[r(F.col(c), 6).alias(c) for c in ("mean_delta", "median_delta", "std_delta", "se_delta", "worst_delta")]
    )


def fold_deltas(spark, d):
    sq = lambda p: (F.col(p) - F.col("y")) * (F.col(p) - F.col("y"))
    return labelled(spark, d).groupBy(F.col("ticker").cast("int").alias("trial_id"), F.year("asof_date").alias("fold")).agg(
        (F.avg(sq("p_model")) - F.avg(sq("p_base"))).alias("delta")
    )


@register(
    "weekly_market_coverage",
    TICKS,
    sql="""SELECT CAST(timestamp_utc AS DATE) - CAST(isodow(timestamp_utc) - 5 AS INT) AS week_friday, count(DISTINCT market_id) AS markets, count(*) AS points
  FROM ticks GROUP BY 1""",
)
def weekly_market_coverage(spark, d):
    t = ticks(spark, d).withColumn("week_friday", calendar.display_friday(F.to_date("timestamp_utc")))
    per_market = t.groupBy("week_friday", "market_id").agg(F.count("*").alias("_n"))
    return per_market.groupBy("week_friday").agg(F.count("market_id").alias("markets"), F.sum("_n").alias("points"))


@register(
    "rows_per_stage",
    TICKS,
    sql="""SELECT 'ticks' AS stage, count(*) AS rows FROM ticks UNION ALL SELECT 'bars_1d', count(*) FROM (SELECT DISTINCT market_id, CAST(timestamp_utc AS DATE) FROM ticks)
  UNION ALL SELECT 'quotes', count(*) FROM lineitem""",
)
def rows_per_stage(spark, d):
    t = ticks(spark, d)
    return Q.stage_rows({"ticks": t, "bars_1d": bars.ohlc(t, "1d", fill_gaps=False), "quotes": option_quotes(spark, d)})


@register(
    "run_output_tables",
    sql="""SELECT o_orderstatus AS split, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1""",
)
def run_output_tables(spark, d):
    from strikelake.session import scratch_path
    from strikelake.sources import sinks

    path = scratch_path(spark, "run")
    table = load(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("split")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    sinks.write_run_outputs(path, {"metrics": table})
    return spark.read.schema("split STRING, n BIGINT, top DOUBLE").json(f"{path}/metrics")


@register(
    "base_weight_resolution",
    LABELLED,
    "b AS (SELECT ticker, CASE WHEN l_linenumber = 1 THEN -1.0::DOUBLE WHEN l_linenumber = 2 THEN NULL ELSE w END AS sw FROM labelled)",
    sql=f"SELECT ticker, {r6('sum(CASE WHEN sw > 0 THEN sw ELSE 1.0 END)')} AS total FROM b GROUP BY 1",
)
def base_weight_resolution(spark, d):
    from strikelake.operators.weights import base_weight

    n = F.col("l_linenumber")
    legacy = F.when(n == 1, -1.0).when(n == 2, None).otherwise(F.col("w"))
    x = labelled(spark, d).select("ticker", legacy.alias("sample_weight_final"))
    return base_weight(x, "weight_final").groupBy("ticker").agg(r(F.sum("w"), 6).alias("total"))
