"""Weights, splits, metrics, bootstrap, selection and edge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelake.catalog import register
from strikelake.functions import calendar
from strikelake.functions.scalar import round_half_up as r
from strikelake.operators import bootstrap as B, metrics as M, splits as P, weights as Wt
from strikelake.operators.percentiles import exact_percentiles
from strikelake.operators.skew import with_scalars
from strikelake.session import materialize
from strikelake.sources.tables import LABELLED, labelled


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"


# --- weights --------------------------------------------------------------------------------------


def weight_rows(spark, d):
    x = labelled(spark, d)
    return x.select(
        F.concat(F.lit("s"), F.col("ticker").cast("string")).alias("ticker"), F.col("asof_date").alias("snapshot_date"),
        F.date_add(F.col("asof_date"), 4 - F.weekday("asof_date")).alias("expiry_date"), (F.col("l_partkey") % 50).cast("double").alias("K"),
        F.col("group_id").alias("order_id"), "l_linenumber", "l_partkey", "price", "w",
    )


WROWS = """wr AS (SELECT concat('S', CAST(ticker AS VARCHAR)) AS t, asof_date AS s, CAST(asof_date + CAST(4 - (isodow(asof_date) - 1) AS INT) AS DATE) AS e,
  CAST(l_partkey % 50 AS DOUBLE) AS k, group_id AS order_id, l_linenumber, l_partkey, price, w FROM labelled)"""
WKEYS = """wk AS (SELECT *, concat_ws('|', t, strftime(e, '%Y-%m-%d'), strftime(s, '%Y-%m-%d'), upper(strftime(s, '%a'))) AS g FROM wr)"""


WEIGHTS = (
    LABELLED,
    WROWS,
    WKEYS,
    "gs AS (SELECT g, max(t) AS t, count(*) AS n FROM wk GROUP BY 1)",
    "ts AS (SELECT t, count(*) AS c FROM gs GROUP BY 1)",
    "al AS (SELECT t, c, least(greatest(sqrt((SELECT avg(c) FROM ts) / c), 0.97::DOUBLE), 1.02::DOUBLE) AS a, CASE WHEN t IN ('S3', 'S5') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS f FROM ts)",
    "raw AS (SELECT wk.*, gs.n, al.c, 1.0::DOUBLE / gs.n * al.a * al.f AS wraw FROM wk JOIN gs ON wk.g = gs.g JOIN al ON al.t = wk.t)",
)
WEIGHTS_SQL = f"""SELECT order_id, l_linenumber, l_partkey, price, g AS group_id, concat_ws('|', t, strftime(e, '%Y-%m-%d'), printf('%.7f', k)) AS cluster_strike,
  n::DOUBLE AS weight_group_size, c::DOUBLE AS weight_ticker_group_count, {r6('wraw / (SELECT avg(wraw) FROM raw)')} AS weight_final FROM raw"""


def weighted(rows):
    """The columns that are compared of weighted rows."""
    return rows.select(
        "order_id", "l_linenumber", "l_partkey", "price", "group_id", "cluster_strike", "weight_group_size", "weight_ticker_group_count",
        r(F.col("weight_final"), 6).alias("weight_final"),
    )


WEIGHTING = {"mode": "sqrt_inv", "alpha_min": 0.97, "alpha_max": 1.02, "beta": 1.5, "focus": "s3, S5", "probe": False}


@register("snapshot_weights", *WEIGHTS, sql=WEIGHTS_SQL)
def snapshot_weights(spark, d):
    return weighted(Wt.weighting_v3(weight_rows(spark, d).drop("w"), **WEIGHTING))


@register("backfill_with_weights", *WEIGHTS, sql=WEIGHTS_SQL)
def backfill_with_weights(spark, d):
    """The stored rows end in 1998 and carry old weights, the extra ones begin in 1997: the result is the whole table weighted anew."""
    from strikelake.plans.datasets import backfill_dataset

    x = weight_rows(spark, d).drop("w")
    x = x.withColumn("row_id", F.concat_ws("|", "order_id", "l_linenumber", "l_partkey", "price", "snapshot_date"))
    stored = Wt.weighting_v3(x.where(F.col("snapshot_date") < F.lit("1998-01-01")), **WEIGHTING).select(*x.columns, "weight_final", "weighting_version")
    extra = x.where(F.col("snapshot_date") >= F.lit("1997-01-01"))
    return weighted(backfill_dataset(materialize(stored, "stored"), extra, **WEIGHTING))


@register(
    "weight_migration_report",
    LABELLED,
    WROWS,
    WKEYS,
    "gs AS (SELECT g, count(*) AS n FROM wk GROUP BY 1)",
    "raw AS (SELECT 1.0::DOUBLE / gs.n AS wraw FROM wk JOIN gs ON wk.g = gs.g)",
    sql=f"""SELECT 'lineitem.parquet' AS file, 'processed' AS status, (SELECT count(*) FROM wk) AS rows, (SELECT count(*) FROM gs) AS weight_groups,
  {r6('min(wraw) / avg(wraw)')} AS weight_min, {r6('max(wraw) / avg(wraw)')} AS weight_max FROM raw""",
)
def weight_migration_report(spark, d):
    from strikelake.plans.datasets import migrate_weights

    raw = spark.read.parquet(f"{d}/lineitem.parquet").select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    day = F.to_date("l_shipdate")
    rows = raw.select(
        "file", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("ticker"), day.alias("snapshot_date"),
        F.date_add(day, 4 - F.weekday(day)).alias("expiry_date"), (F.col("l_partkey") % 50).cast("double").alias("K"),
        F.lit(9.0).alias("weight_final"),
    )
    _, report = migrate_weights(rows)
    return report.select(
        "file", "status", "rows", "weight_groups", r(F.col("weight_min"), 6).alias("weight_min"), r(F.col("weight_max"), 6).alias("weight_max")
    )


@register(
    "equalized_group_weights",
    LABELLED,
    "e AS (SELECT *, w / sum(w) OVER (PARTITION BY group_id) AS we FROM labelled)",
    sql=f"SELECT group_id, l_linenumber, l_partkey, price, {r6('we / (SELECT avg(we) FROM e)')} AS w FROM e",
)
def equalized_group_weights(spark, d):
    out = Wt.mean_one(Wt.equalize_groups(labelled(spark, d), "group_id"))
    return out.select("group_id", "l_linenumber", "l_partkey", "price", r(F.col("w"), 6).alias("w"))


POLICY_TICKERS = "1, 2, 3"
BALANCE = """bal AS (SELECT ticker, least(greatest(sqrt((SELECT avg(c) FROM (SELECT count(*) AS c FROM labelled GROUP BY ticker)) / count(*)), 0.5), 2.0) AS f
  FROM labelled GROUP BY 1)"""


@register(
    "training_weight_policy",
    LABELLED,
    BALANCE,
    "e AS (SELECT *, w / sum(w) OVER (PARTITION BY group_id) AS we FROM labelled)",
    """p AS (SELECT e.*, we * CASE WHEN ticker IN (1, 2, 3) THEN 1.5::DOUBLE ELSE 1.0 END * CASE WHEN ticker IN (3, 4) THEN 2.0::DOUBLE ELSE 1.0 END * f AS wp
  FROM e JOIN bal USING (ticker))""",
    "m AS (SELECT avg(wp) AS a, avg(wp) FILTER (WHERE asof_date < DATE '1999-01-01') AS b, avg(wp) FILTER (WHERE asof_date >= DATE '1999-01-01') AS c FROM p)",
    sql=f"""SELECT group_id, l_linenumber, l_partkey, price, {r6('wp / a')} AS w_train, CASE WHEN asof_date < DATE '1999-01-01' THEN {r6('wp / b')} END AS w_fit,
  CASE WHEN asof_date >= DATE '1999-01-01' THEN {r6('wp / c')} END AS w_val FROM p, m""",
)
def training_weight_policy(spark, d):
    x = labelled(spark, d)
    early = F.col("asof_date") < F.lit("1999-01-01").cast("date")
    out = Wt.training_weights(
        x, "group_id", foundation=POLICY_TICKERS, foundation_weight=1.5, universe="3,4", universe_weight=2.0, balance=True, fit=early, val=~early
    )
    return out.select("group_id", "l_linenumber", "l_partkey", "price", *[r(F.col(c), 6).alias(c) for c in ("w_train", "w_fit", "w_val")])


@register(
    "preview_weight_policy",
    LABELLED,
    BALANCE,
    "p AS (SELECT l.*, w * CASE WHEN ticker IN (3, 4) THEN 2.0::DOUBLE ELSE 1.0 END * f AS wp FROM labelled l JOIN bal USING (ticker))",
    "e AS (SELECT *, wp / sum(wp) OVER (PARTITION BY group_id) AS we FROM p)",
    "g AS (SELECT group_id, sum(we / (SELECT avg(we) FROM e)) AS s FROM e GROUP BY 1)",
    sql=f"""SELECT count(*) AS n_groups, {r6('min(s)')} AS min, {r6('avg(s)')} AS mean, {r6('max(s)')} AS max, max(s) / avg(s) > 4.0 AS imbalanced FROM g""",
)
def preview_weight_policy(spark, d):
    x = labelled(spark, d)
    out = Wt.preview_weights(x, "group_id", universe="3,4", universe_weight=2.0, balance=True)
    s = Wt.group_sum_summary(out, "group_id")
    return s.select("n_groups", *[r(F.col(c), 6).alias(c) for c in ("min", "mean", "max")], "imbalanced")


@register(
    "masked_group_reweight",
    LABELLED,
    "e AS (SELECT *, y = 1 AS inside FROM labelled)",
    "s AS (SELECT *, CASE WHEN inside THEN w / sum(w) OVER (PARTITION BY inside, group_id) ELSE w END AS w2 FROM e)",
    "m AS (SELECT avg(w) AS a, avg(w2) AS b FROM s WHERE inside)",
    sql=f"SELECT group_id, l_linenumber, l_partkey, price, {r6('CASE WHEN inside THEN w2 * a / b ELSE w END')} AS w FROM s, m",
)
def masked_group_reweight(spark, d):
    out = Wt.reweight_masked(labelled(spark, d), "group_id", F.col("y") == 1)
    return out.select("group_id", "l_linenumber", "l_partkey", "price", r(F.col("w"), 6).alias("w"))


@register(
    "weight_distribution",
    LABELLED,
    "s AS (SELECT *, CASE WHEN y = 1 THEN 'pos' ELSE 'neg' END AS split FROM labelled)",
    sql=f"""SELECT split, count(*) AS n, min(price) AS min, {r6('avg(price)')} AS mean, max(price) AS max,
  {r6('quantile_cont(price, 0.01)')} AS p01, {r6('quantile_cont(price, 0.99)')} AS p99 FROM s GROUP BY 1""",
)
def weight_distribution(spark, d):
    x = labelled(spark, d).withColumn("split", F.when(F.col("y") == 1, "pos").otherwise("neg"))
    base = x.groupBy("split").agg(F.count("*").alias("n"), F.min("price").alias("min"), r(F.avg("price"), 6).alias("mean"), F.max("price").alias("max"))
    q = exact_percentiles(x, ["split"], "price", [0.01, 0.99]).groupBy("split").agg(
        r(F.max(F.when(F.col("prob") == 0.01, F.col("value"))), 6).alias("p01"), r(F.max(F.when(F.col("prob") == 0.99, F.col("value"))), 6).alias("p99")
    )
    return base.join(q, "split")


# --- splits ---------------------------------------------------------------------------------------

WEEKS = (
    LABELLED,
    "lw AS (SELECT *, CAST(asof_date + CAST((4 - (isodow(asof_date) - 1) + 7) % 7 AS INT) AS DATE) AS week FROM labelled)",
    "wl AS (SELECT week, row_number() OVER (ORDER BY week) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM lw))",
)


def weekly(spark, d):
    return labelled(spark, d).withColumn("week", calendar.next_friday(F.col("asof_date")))


@register(
    "last_weeks_test_split",
    *WEEKS,
    "ts AS (SELECT week AS t FROM wl WHERE i = n - 20 + 1)",
    """tr AS (SELECT * FROM lw, ts WHERE week < t AND group_id NOT IN (SELECT group_id FROM lw, ts WHERE week >= t) AND asof_date < (SELECT min(asof_date) FROM lw, ts WHERE week >= t) - INTERVAL 10 DAY)""",
    "wt AS (SELECT week, row_number() OVER (ORDER BY week) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM tr))",
    "vs AS (SELECT week AS v FROM wt WHERE i = n - greatest(1, CAST(round_even(n * 0.2::DOUBLE, 0) AS INT)) + 1)",
    """lab AS (SELECT group_id, l_linenumber, l_partkey, price, 'test' AS split FROM lw, ts WHERE week >= t UNION ALL
   SELECT group_id, l_linenumber, l_partkey, price, 'val' FROM tr, vs WHERE week >= v UNION ALL
   SELECT group_id, l_linenumber, l_partkey, price, 'fit' FROM tr, vs WHERE week < v AND group_id NOT IN (SELECT group_id FROM tr, vs WHERE week >= v))""",
    sql="SELECT * FROM lab",
)
def last_weeks_test_split(spark, d):
    out = P.time_split(weekly(spark, d), "week", "asof_date", "group_id", 20, embargo=10)
    return out.select("group_id", "l_linenumber", "l_partkey", "price", "split")


@register(
    "split_composition",
    *WEEKS,
    "ts AS (SELECT week AS t FROM wl WHERE i = n - 20 + 1)",
    "s AS (SELECT *, CASE WHEN week >= t THEN 'test' ELSE 'train' END AS split FROM lw, ts)",
    sql="""SELECT split, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_pos, CAST(count(*) - sum(y) AS BIGINT) AS n_neg, count(DISTINCT y) AS class_count,
  min(week) AS week_start, max(week) AS week_end, count(DISTINCT ticker) AS n_tickers, count(DISTINCT group_id) AS n_group_id,
  count(DISTINCT (ticker, l_partkey)) AS n_contract_id FROM s GROUP BY 1""",
)
def split_composition(spark, d):
    from strikelake.operators.quality import composition

    train, test = P.split_test(weekly(spark, d), "week", 20)
    tag = lambda x, n: x.withColumn("split", F.lit(n))
    rows = tag(train, "train").unionByName(tag(test, "test"))
    rows = rows.withColumn("contract_id", F.concat_ws("|", "ticker", "l_partkey"))
    return composition(rows, "split", "y", "week", {"n_tickers": "ticker", "n_group_id": "group_id", "n_contract_id": "contract_id"})


@register(
    "validation_split_by_weeks",
    *WEEKS,
    "vs AS (SELECT week AS v FROM wl WHERE i = n - greatest(1, CAST(round_even(n * 0.2::DOUBLE, 0) AS INT)) + 1)",
    sql="SELECT CASE WHEN week >= v THEN 'val' ELSE 'fit' END AS split, count(*) AS n, min(week) AS lo, max(week) AS hi FROM lw, vs GROUP BY 1",
)
def validation_split_by_weeks(spark, d):
    fit, val = P.split_validation(weekly(spark, d), "week")
    part = lambda x, n: x.groupBy(F.lit(n).alias("split")).agg(F.count("*").alias("n"), F.min("week").alias("lo"), F.max("week").alias("hi"))
    return part(fit, "fit").unionByName(part(val, "val"))


@register(
    "walk_forward_folds",
    *WEEKS,
    """f AS (SELECT 5 - k AS fold, (SELECT max(n) FROM wl) - k * 12 AS ve FROM (SELECT unnest(range(0, 5)) AS k))""",
    """g AS (SELECT fold, (SELECT week FROM wl WHERE i = ve - 12 - 60 + 1) AS tlo, (SELECT week FROM wl WHERE i = ve - 12) AS thi,
   (SELECT week FROM wl WHERE i = ve - 12 + 1) AS vlo, (SELECT week FROM wl WHERE i = ve) AS vhi FROM f)""",
    "v AS (SELECT g.fold, l.* FROM lw l JOIN g ON l.week BETWEEN vlo AND vhi)",
    "vb AS (SELECT fold, min(asof_date) AS b FROM v GROUP BY 1)",
    """t AS (SELECT g.fold, l.* FROM lw l JOIN g ON l.week BETWEEN tlo AND thi JOIN vb ON vb.fold = g.fold
   WHERE l.asof_date < b - INTERVAL 5 DAY AND NOT EXISTS (SELECT 1 FROM v WHERE v.fold = g.fold AND v.group_id = l.group_id))""",
    sql="""SELECT CAST(fold AS INT) AS fold, 'val' AS role, count(*) AS n, min(asof_date) AS lo, max(asof_date) AS hi, CAST(sum(y) AS BIGINT) AS positives FROM v GROUP BY 1
  UNION ALL SELECT CAST(fold AS INT), 'train', count(*), min(asof_date), max(asof_date), CAST(sum(y) AS BIGINT) FROM t GROUP BY 1""",
)
def walk_forward_folds(spark, d):
    x = weekly(spark, d)
    folds = P.walk_forward(P.week_list(x, "week"), 5, 12, 60, expanding=False)
    rows = P.assign_folds(x, folds, "week", "group_id", embargo=5, date_col="asof_date")
    return rows.groupBy("fold", "role").agg(
        F.count("*").alias("n"), F.min("asof_date").alias("lo"), F.max("asof_date").alias("hi"), F.sum("y").alias("positives")
    )


@register(
    "walk_forward_fold_facts",
    *WEEKS,
    """f AS (SELECT 5 - k AS fold, (SELECT max(n) FROM wl) - k * 12 AS ve FROM (SELECT unnest(range(0, 5)) AS k))""",
    """g AS (SELECT fold, (SELECT week FROM wl WHERE i = ve - 12 - 60 + 1) AS tlo, (SELECT week FROM wl WHERE i = ve - 12) AS thi,
   (SELECT week FROM wl WHERE i = ve - 12 + 1) AS vlo, (SELECT week FROM wl WHERE i = ve) AS vhi FROM f)""",
    "v AS (SELECT g.fold, l.* FROM lw l JOIN g ON l.week BETWEEN vlo AND vhi)",
    "vb AS (SELECT fold, min(asof_date) AS b, count(*) AS n_val FROM v GROUP BY 1)",
    "vg AS (SELECT DISTINCT fold, group_id FROM v)",
    """t AS (SELECT g.fold, l.asof_date, vg.fold IS NOT NULL AS purged, vg.fold IS NULL AND NOT l.asof_date < b - INTERVAL 5 DAY AS late, b, n_val
   FROM lw l JOIN g ON l.week BETWEEN tlo AND thi JOIN vb ON vb.fold = g.fold LEFT JOIN vg ON vg.fold = g.fold AND vg.group_id = l.group_id)""",
    sql="""SELECT CAST(fold AS INT) AS fold, count_if(NOT purged AND NOT late)::BIGINT AS n_train, any_value(n_val) AS n_val, count_if(purged)::BIGINT AS n_purged, count_if(late)::BIGINT AS n_embargoed,
  max(asof_date) FILTER (WHERE NOT purged AND NOT late) AS last_train, any_value(b) AS first_val, CAST(date_diff('day', max(asof_date) FILTER (WHERE NOT purged AND NOT late), any_value(b)) AS INT) AS gap_days FROM t GROUP BY 1""",
)
def walk_forward_fold_facts(spark, d):
    x = weekly(spark, d)
    folds = P.walk_forward(P.week_list(x, "week"), 5, 12, 60, expanding=False)
    facts = P.fold_facts(P.fold_masks(x, folds, "week", "group_id", embargo=5, date_col="asof_date"), folds, "asof_date")
    P.require_whole_folds(facts)
    return facts


@register(
    "outer_test_folds",
    *WEEKS,
    "f AS (SELECT k + 1 AS fold, (SELECT max(n) FROM wl) - 20 - k * 12 AS te FROM (SELECT unnest(range(0, 3)) AS k))",
    "g AS (SELECT fold, (SELECT week FROM wl WHERE i = te - 10 - 2) AS thi, (SELECT week FROM wl WHERE i = te - 10 + 1) AS vlo, (SELECT week FROM wl WHERE i = te) AS vhi FROM f)",
    sql="""SELECT CAST(fold AS INT) AS fold, CASE WHEN week <= thi THEN 'train' ELSE 'val' END AS role, count(*) AS n, max(week) AS last_week FROM lw JOIN g
  ON week <= thi OR week BETWEEN vlo AND vhi GROUP BY 1, 2""",
)
def outer_test_folds(spark, d):
    x = weekly(spark, d)
    folds = P.outer_folds(P.week_list(x, "week"), 20, 3, 10, 2)
    return P.assign_folds(x, folds, "week").groupBy("fold", "role").agg(F.count("*").alias("n"), F.max("week").alias("last_week"))


@register(
    "calendar_walk_forward",
    LABELLED,
    "b AS (SELECT min(asof_date) AS s, max(asof_date) AS e FROM labelled)",
    "f AS (SELECT k + 1 AS fold, CAST(s + CAST(k * 200 AS INT) AS DATE) AS lo FROM b, (SELECT unnest(range(0, 4)) AS k) WHERE s + CAST(k * 200 + 365 + 90 AS INT) <= e)",
    sql="""SELECT CAST(fold AS INT) AS fold, CASE WHEN asof_date < lo + 365 THEN 'train' ELSE 'val' END AS role, count(*) AS n FROM labelled JOIN f
  ON asof_date >= lo AND (asof_date < lo + 365 - 7 OR (asof_date >= lo + 365 AND asof_date < lo + 455)) GROUP BY 1, 2""",
)
def calendar_walk_forward(spark, d):
    from dataclasses import replace
    from datetime import timedelta

    x = labelled(spark, d)
    lo, hi = x.agg(F.min("asof_date"), F.max("asof_date")).first()
    folds = P.calendar_walk(lo, hi, 365, 90, 200, max_splits=4)
    # The embargo shortens the training window itself.
    folds = [replace(f, train_hi=f.train_hi - timedelta(days=7)) for f in folds]
    return P.assign_folds(x, folds, "asof_date").groupBy("fold", "role").agg(F.count("*").alias("n"))


@register(
    "embargo_by_weeks",
    *WEEKS,
    "b AS (SELECT min(week) AS b FROM lw WHERE asof_date >= DATE '2000-06-01')",
    sql="""SELECT count(*) AS n, max(week) AS last_week, CAST(date_diff('day', max(week), any_value(b)) AS INT) AS gap_days FROM lw, b WHERE asof_date < DATE '2000-06-01' AND week < b - INTERVAL 14 DAY""",
)
def embargo_by_weeks(spark, d):
    x = weekly(spark, d)
    cut = F.lit("2000-06-01").cast("date")
    boundary = x.where(F.col("asof_date") >= cut)
    train = P.embargo_weeks(x.where(F.col("asof_date") < cut), boundary, 9, "week")
    stats = train.agg(F.count("*").alias("n"), F.max("week").alias("last_week"))
    return with_scalars(stats, P.gap_days(train, boundary, "week"))


@register(
    "fraction_time_boundary",
    sql="""SELECT epoch_us(ts) AS boundary FROM (SELECT ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i = floor(n * 0.7::DOUBLE)""",
)
def fraction_time_boundary(spark, d):
    from strikelake.sources.tables import load

    return P.fraction_boundary(load(spark, d, "events"), "ts", 0.7).select(F.unix_micros("boundary").alias("boundary"))


@register(
    "preview_split_labels",
    *WEEKS,
    sql="""SELECT CASE WHEN i > n - 20 THEN 'test' WHEN i > n - 28 THEN 'val' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT group_id) AS n_groups
  FROM lw JOIN wl USING (week) GROUP BY 1""",
)
def preview_split_labels(spark, d):
    out = P.preview_labels(weekly(spark, d), "week", 20, 8)
    return out.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("group_id").alias("n_groups"))


@register(
    "leak_mask",
    "e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)",
    """m AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN ts WHEN event_id % 10 = 1 THEN NULL ELSE prev END AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts - INTERVAL 1 SECOND END AS b, ts FROM e)""",
    sql="""SELECT event_id, coalesce(a < ts, false) AND coalesce(b < ts, false) AS strict_ok, (a IS NULL OR a < ts) AND (b IS NULL OR b < ts) AS lenient_ok,
  coalesce(ts < TIMESTAMP '2024-01-20 00:00:00', false) AS label_ok FROM m""",
)
def leak_mask(spark, d):
    from strikelake.operators.skew import time_slice, with_neighbours
    from strikelake.sources.tables import load

    e = load(spark, d, "events").withColumn("us", F.unix_micros("ts"))
    e = with_neighbours(e, ["user_id"], ["ts", "event_id"], time_slice(F.col("ts")), "us")
    ts, i = F.col("us"), F.col("event_id")
    a = F.when(i % 10 == 0, ts).when(i % 10 == 1, None).otherwise(F.col("prev_us"))
    b = F.when(i % 7 == 0, None).otherwise(ts - 1_000_000)
    m = e.select("event_id", a.alias("a"), b.alias("b"), "us", "ts")
    both = [F.col("a"), F.col("b")]
    return m.select(
        "event_id", P.times_before(F.col("us"), both, False).alias("strict_ok"), P.times_before(F.col("us"), both, True).alias("lenient_ok"),
        P.label_after_decision(F.col("ts"), F.lit("2024-01-20").cast("timestamp")).alias("label_ok"),
    )


# --- metrics --------------------------------------------------------------------------------------

LL = lambda p: f"-(CASE WHEN y = 1 THEN ln({p}) ELSE ln(1.0 - {p}) END)"


@register(
    "point_metrics",
    LABELLED,
    sql=f"""SELECT ticker % 5 AS bucket, count(*) AS n, {r6('avg(' + LL('p_model') + ')')} AS logloss, {r6('avg((p_model - y) * (p_model - y))')} AS brier,
  {r6('avg(abs(p_model - y))')} AS mae, {r6('sqrt(avg((p_model - y) * (p_model - y)))')} AS rmse FROM labelled GROUP BY 1""",
)
def point_metrics(spark, d):
    x = labelled(spark, d).withColumn("bucket", F.col("ticker") % 5)
    out = M.point_metrics(x, ["bucket"], "y", "p_model")
    return out.select("bucket", "n", *[r(F.col(c), 6).alias(c) for c in ("logloss", "brier", "mae", "rmse")])


@register(
    "weighted_logloss",
    LABELLED,
    sql=f"SELECT ticker, {r6('sum(w * ' + LL('p_model') + ') / sum(w)')} AS logloss FROM labelled GROUP BY 1",
)
def weighted_logloss(spark, d):
    out = M.weighted_logloss(labelled(spark, d), ["ticker"], "y", "p_model", "w")
    return out.select("ticker", r(F.col("logloss"), 6).alias("logloss"))


EDGES = [k / 10 if k != 3 and k != 6 and k != 7 else {3: 0.30000000000000004, 6: 0.6000000000000001, 7: 0.7000000000000001}[k] for k in range(1, 10)]
BIN = " + ".join(f"CASE WHEN p >= {e!r}::DOUBLE THEN 1 ELSE 0 END" for e in EDGES)
TALL = """tall AS (SELECT group_id, l_linenumber, l_partkey, asof_date, y, 'baseline_pRN' AS model, p_base AS p FROM labelled
  UNION ALL SELECT group_id, l_linenumber, l_partkey, asof_date, y, 'logit', p_model FROM labelled)"""
TIE_SQL = "md5(concat_ws('|', CAST(group_id AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR)))"


def tie():
    return F.md5(F.concat_ws("|", F.col("group_id").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")))


@register(
    "calibration_error_equal_width",
    LABELLED,
    TALL,
    f"b AS (SELECT model, {BIN} AS bin, count(*) AS c, sum(p) AS sp, sum(y) AS sy FROM tall GROUP BY 1, 2)",
    sql=f"SELECT model, {r6('sum(abs(sp - sy)) / sum(c)')} AS ece FROM b GROUP BY 1",
)
def calibration_error_equal_width(spark, d):
    tall = M.stack_models(labelled(spark, d), [], "y", "p_model", "p_base")
    return M.ece(tall, ["model"], "y", "p").select("model", r(F.col("ece"), 6).alias("ece"))


@register(
    "calibration_error_equal_mass",
    LABELLED,
    TALL,
    f"o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, {TIE_SQL}, y) AS rn, count(*) OVER (PARTITION BY model) AS n FROM tall)",
    "b AS (SELECT model, least(6, floor((rn - 1) / greatest(1, floor(n / 7)))) AS bin, count(*) AS c, sum(p) AS sp, sum(y) AS sy FROM o GROUP BY 1, 2)",
    sql=f"SELECT model, {r6('sum(abs(sp - sy)) / sum(c)')} AS ece_q FROM b GROUP BY 1",
)
def calibration_error_equal_mass(spark, d):
    tall = M.stack_models(labelled(spark, d), [], "y", "p_model", "p_base")
    return M.ece_equal_mass(tall, ["model"], "y", "p", tie(), 7).select("model", r(F.col("ece_q"), 6).alias("ece_q"))


@register(
    "split_metrics",
    LABELLED,
    TALL,
    "st AS (SELECT *, CASE WHEN asof_date < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS split FROM tall)",
    f"o AS (SELECT *, {BIN} AS bin, row_number() OVER (PARTITION BY split, model ORDER BY p, {TIE_SQL}, y) AS rn, count(*) OVER (PARTITION BY split, model) AS n FROM st)",
    "e1 AS (SELECT split, model, sum(d) / sum(c) AS ece FROM (SELECT split, model, bin, count(*) AS c, abs(sum(p) - sum(y)) AS d FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2)",
    """e2 AS (SELECT split, model, sum(d) / sum(c) AS ece_q FROM (SELECT split, model, least(9, floor((rn - 1) / greatest(1, floor(n / 10)))) AS bin, count(*) AS c, abs(sum(p) - sum(y)) AS d
   FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2)""",
    f"m AS (SELECT split, model, count(*) AS n, avg({LL('p')}) AS logloss, avg((p - y) * (p - y)) AS brier FROM st GROUP BY 1, 2)",
    sql=f"SELECT split, model, n, {r6('logloss')} AS logloss, {r6('brier')} AS brier, {r6('ece')} AS ece, {r6('ece_q')} AS ece_q FROM m JOIN e1 USING (split, model) JOIN e2 USING (split, model)",
)
def split_metrics(spark, d):
    x = labelled(spark, d).withColumn("split", F.when(F.col("asof_date") < F.lit("2000-01-01"), "train").otherwise("test"))
    out = M.split_metrics(x, ["split"], "y", "p_model", "p_base", tie())
    return out.select("split", "model", "n", *[r(F.col(c), 6).alias(c) for c in ("logloss", "brier", "ece", "ece_q")])


@register(
    "bootstrap_metric_intervals",
    LABELLED,
    "lu AS (SELECT *, strftime(asof_date, '%Y-%m-%d') AS u FROM labelled)",
    "ix AS (SELECT u, row_number() OVER (ORDER BY md5(u), u) - 1 AS i, count(*) OVER () AS g FROM (SELECT DISTINCT u FROM lu))",
    "reps AS (SELECT unnest(range(0, 200)) AS rep)",
    "dr AS (SELECT rep, CAST(('0x' || substr(md5(concat('7|', CAST(rep AS VARCHAR), '|', CAST(i AS VARCHAR))), 1, 8)) AS BIGINT) * g // 4294967296 AS i FROM ix, reps)",
    "mu AS (SELECT rep, i, count(*) AS m FROM dr GROUP BY 1, 2)",
    "cp AS (SELECT rep, u, m FROM mu JOIN ix USING (i))",
    f"""ls AS (SELECT rep, sum(m * ({LL('p_model')} - ({LL('p_base')}))) / sum(m) AS dl, sum(m * ((p_model - y) * (p_model - y) - (p_base - y) * (p_base - y))) / sum(m) AS db
   FROM lu JOIN cp USING (u) GROUP BY 1)""",
    """tl AS (SELECT rep, m, group_id, l_linenumber, l_partkey, y, 1 AS sg, p_model AS p FROM lu JOIN cp USING (u)
   UNION ALL SELECT rep, m, group_id, l_linenumber, l_partkey, y, -1, p_base FROM lu JOIN cp USING (u))""",
    f"ew AS (SELECT rep, sg, sum(d) / sum(c) AS ece FROM (SELECT rep, sg, {BIN} AS bin, sum(m) AS c, abs(sum(m * p) - sum(m * y)) AS d FROM tl GROUP BY 1, 2, 3) GROUP BY 1, 2)",
    "ex AS (SELECT *, unnest(range(0, m)) AS cpy FROM tl)",
    f"o AS (SELECT *, row_number() OVER (PARTITION BY rep, sg ORDER BY p, {TIE_SQL}, y) AS rn, count(*) OVER (PARTITION BY rep, sg) AS n FROM ex)",
    "eq AS (SELECT rep, sg, sum(d) / sum(c) AS ece_q FROM (SELECT rep, sg, least(9, floor((rn - 1) / greatest(1, floor(n / 10)))) AS bin, count(*) AS c, abs(sum(p) - sum(y)) AS d FROM o GROUP BY 1, 2, 3) GROUP BY 1, 2)",
    "cal AS (SELECT rep, sum(sg * ece) AS de, sum(sg * ece_q) AS dq FROM ew JOIN eq USING (rep, sg) GROUP BY 1)",
    sql="SELECT "
    + ", ".join(
        f"{r6(f'quantile_cont({c}, {q})')} AS {n}_ci_{t}"
        for c, n in (("dl", "delta_logloss"), ("db", "delta_brier"), ("de", "delta_ece"), ("dq", "delta_ece_q"))
        for t, q in (("lo", 0.025), ("hi", 0.975))
    )
    + ", count(*) AS bootstrap_b, (SELECT max(g) FROM ix) AS bootstrap_n_groups FROM ls JOIN cal USING (rep)",
)
def bootstrap_metric_intervals(spark, d):
    x = labelled(spark, d)
    unit, _ = M.bootstrap_group(x, "day")
    deltas = B.bootstrap_deltas(x.withColumn("_unit", unit), "_unit", "y", "p_model", "p_base", tie(), replicates=200)
    out = M.bootstrap_intervals(deltas)
    return out.select(*[r(F.col(c), 6).alias(c) for c in out.columns if c.startswith("delta_")], "bootstrap_b", "bootstrap_n_groups")


@register("bootstrap_row_intervals")
def bootstrap_row_intervals(spark, d):
    """No SQL (64-bit generator): every row is its own unit, with Poisson counts; tested against weighted rows in numpy."""
    x = labelled(spark, d)
    deltas = B.bootstrap_deltas(x.withColumn("_unit", tie()), "_unit", "y", "p_model", "p_base", tie(), replicates=200, resampling="poisson")
    out = M.bootstrap_intervals(deltas)
    return out.select(*[r(F.col(c), 6).alias(c) for c in out.columns if c.startswith("delta_")], "bootstrap_b", "bootstrap_n_groups")


@register(
    "row_tail_split",
    "x AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)",
    sql="SELECT event_id, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'fit' ELSE 'val' END AS split FROM x",
)
def row_tail_split(spark, d):
    from strikelake.sources.tables import load

    e = load(spark, d, "events").select("event_id", "ts")
    fit, val, _ = P.resolve_validation(e, "week", ["ts", "event_id"])
    part = lambda x, name: x.select("event_id", F.lit(name).alias("split"))
    return part(fit, "fit").unionByName(part(val, "val"))


@register(
    "test_split_without_weeks",
    "x AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)",
    sql="SELECT event_id, CASE WHEN rn <= greatest(1, floor(n * 0.8::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM x",
)
def test_split_without_weeks(spark, d):
    from strikelake.sources.tables import load

    train, test = P.split_test(load(spark, d, "events").select("event_id", "ts"), "week", 20, ["ts", "event_id"])
    part = lambda x, name: x.select("event_id", F.lit(name).alias("split"))
    return part(train, "train").unionByName(part(test, "test"))


@register(
    "weighted_calibration_error",
    LABELLED,
    "tw AS (SELECT 'baseline_pRN' AS model, p_base AS p, y, w, group_id, l_linenumber, l_partkey FROM labelled UNION ALL SELECT 'logit', p_model, y, w, group_id, l_linenumber, l_partkey FROM labelled)",
    f"pw AS (SELECT model, p, y, CAST(w AS DECIMAL(20, 9)) AS w, {TIE_SQL} AS t FROM tw)",
    "cw AS (SELECT *, sum(w) OVER (PARTITION BY model ORDER BY p, t, y ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY model) AS total FROM pw WHERE w > 0)",
    """ed AS (WITH RECURSIVE e AS (SELECT model, max(total) AS total, 0 AS b, CAST(0 AS DECIMAL(38, 9)) AS lo, CAST(0 AS DECIMAL(38, 9)) AS hi FROM cw GROUP BY model
   UNION ALL SELECT e.model, any_value(e.total), any_value(e.b) + 1, any_value(e.hi),
     CASE WHEN any_value(e.b) = 6 THEN any_value(e.total) ELSE coalesce(max(CASE WHEN (c.upto - e.hi) * 7 <= e.total THEN c.upto END), min(c.upto), any_value(e.hi)) END
   FROM e LEFT JOIN cw c ON c.model = e.model AND c.upto > e.hi WHERE e.b < 7 GROUP BY e.model) SELECT * FROM e WHERE b > 0)""",
    "bw AS (SELECT c.model, b, sum(w::DOUBLE * p) AS sp, sum(w::DOUBLE * y) AS sy, any_value(c.total)::DOUBLE AS total FROM cw c JOIN ed ON c.model = ed.model AND c.upto > lo AND c.upto <= hi GROUP BY 1, 2)",
    sql=f"SELECT model, {r6('sum(abs(sp - sy)) / any_value(total)')} AS ece_w FROM bw GROUP BY 1",
)
def weighted_calibration_error(spark, d):
    tall = M.stack_models(labelled(spark, d), [], "y", "p_model", "p_base")
    return M.ece_equal_mass(tall, ["model"], "y", "p", tie(), 7, weight="w").select("model", r(F.col("ece_q"), 6).alias("ece_w"))
