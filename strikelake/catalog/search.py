"""Trial and C search queries, from the grid to the leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelake.catalog import register
from strikelake.catalog.scoring import WEEKS, r6, weekly
from strikelake.functions.scalar import logit, round_half_up as r
from strikelake.models import logistic as L, search as R, selection as S
from strikelake.operators import quality as Q, splits as P

HOT = ("S3", "S5")  # the trading universe
FOUNDATION = ("S1", "S2")
# The standard grid of the C search.
C_GRID = (0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0)
STEPS = 25  # Newton steps of the SQL; both sides are converged long before


def rows(spark, d):
    """Labelled rows with sector, the features of the default grid and the week."""
    x = weekly(spark, d)
    return x.withColumns({
        "sector": F.concat(F.lit("S"), (F.col("ticker") % 10).cast("string")), "x_logit_prn": logit(F.col("p_base")), "rv20": F.col("w") / 50.0,
        "abs_log_m_fwd": F.abs(F.col("discount") - 0.05), "log_rel_spread": F.ln(F.lit(1.0) + F.col("tax")),
    })


def leaderboard(trials, deltas):
    """One row per trial with its fold statistics, the gates it fails and whether it is the selected one, in leaderboard order."""
    stats = Q.fold_statistics(deltas, delta="delta").withColumn("score", F.col("median_delta")).join(trials, "trial_id")
    judged = S.acceptance(stats, min_improved=0.75, worst_cap=0.005)
    chosen = S.choose_trial(judged, S.simplicity_key()).select(F.col("trial_id").alias("_id"))
    marked = judged.join(chosen, F.col("trial_id") == F.col("_id"), "left")
    return S.leaderboard(marked.select("*", F.col("_id").isNotNull().alias("selected"))).select(
        "trial_id", "n_folds", *[r(F.col(c), 6).alias(c) for c in ("score", "mean_delta", "worst_delta")],
        F.array_join("rejected_because", ",").alias("rejected_because"), "selected",
    )


@register("outer_fold_trial_search")
def outer_fold_trial_search(spark, d):
    """No SQL (Platt, four features, ticker intercepts): the default grid of 900 trials over three outer folds. Its steps are tested
    against dense numpy fits; `small_trial_search` has SQL."""
    x = rows(spark, d)
    trials = S.trial_table(spark, R.DEFAULT_FEATURE_SETS, **R.DEFAULT_AXES)
    folds = P.outer_folds(P.week_list(x, "week"), 20, 3, 10, 2)
    sector = F.col("sector")
    deltas = R.search_trials(
        x, trials, folds, "week", y="y", baseline="p_base", group="group_id", w="w", universe=sector.isin(*HOT), foundation=sector.isin(*FOUNDATION), level=sector
    )
    return leaderboard(trials, deltas)


def newton(cells: str, fits: str) -> str:
    """SQL: intercept a and slope b of each fit m over weighted cells (m, c, x, y, w), by Newton steps in a recursive statement."""
    return f"""{fits} AS (WITH RECURSIVE e AS (SELECT m, 0 AS step, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM (SELECT DISTINCT m FROM {cells})
   UNION ALL SELECT m, step + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
     SELECT m, any_value(step) AS step, any_value(a) AS a, any_value(b) AS b, sum(c * w * (p - y)) AS ga, sum(c * w * (p - y) * x) + any_value(b) AS gb,
       sum(c * w * p * (1 - p)) AS haa, sum(c * w * p * (1 - p) * x) AS hab, sum(c * w * p * (1 - p) * x * x) + 1 AS hbb
     FROM (SELECT e.m, step, a, b, c, x, y, w, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(a + b * x))) AS p FROM e JOIN {cells} s ON s.m = e.m WHERE step < {STEPS}) GROUP BY m))
   SELECT m, a, b FROM e WHERE step = {STEPS})"""


LOSS = lambda p: f"-avg(CASE WHEN y = 1 THEN ln({p}) ELSE ln(1.0::DOUBLE - {p}) END)"


@register(
    "small_trial_search",
    *WEEKS,
    "fo AS (SELECT k + 1 AS fold, (SELECT max(n) FROM wl) - 20 - k * 12 AS te FROM (SELECT unnest(range(0, 3)) AS k))",
    "fg AS (SELECT fold, (SELECT week FROM wl WHERE i = te - 10 - 2) AS thi, (SELECT week FROM wl WHERE i = te - 10 + 1) AS vlo, (SELECT week FROM wl WHERE i = te) AS vhi FROM fo)",
    """tv AS (SELECT fold, week <= thi AS tr, y, p_base, w::DOUBLE AS w, ticker % 10 IN (3, 5) AS hot, fi, CASE fi WHEN 0 THEN discount ELSE tax END::DOUBLE AS x
   FROM lw JOIN fg ON week <= thi OR week BETWEEN vlo AND vhi, (SELECT unnest([0, 1]) AS fi))""",
    "tz AS (SELECT fold, fi, avg(x) AS mu, stddev_pop(x) AS sd FROM tv WHERE tr GROUP BY 1, 2)",
    "uu AS (SELECT unnest([0, 1]) AS ui, unnest([1.0::DOUBLE, 1.5::DOUBLE]) AS uf)",
    "cc AS (SELECT unnest([0, 1]) AS ci, unnest([0.003::DOUBLE, 0.3::DOUBLE]) AS c)",
    "um AS (SELECT fold, fi, ui, uf, avg(w * CASE WHEN hot THEN uf ELSE 1 END) AS wm FROM tv, uu WHERE tr GROUP BY 1, 2, 3, 4)",
    """sc AS (SELECT tv.fold * 1000 + 1 + tv.fi * 4 + ci * 2 + ui AS m, c, (x - mu) / sd AS x, y, sum(w * CASE WHEN hot THEN uf ELSE 1 END / wm) AS w
   FROM tv JOIN tz ON tz.fold = tv.fold AND tz.fi = tv.fi JOIN um ON um.fold = tv.fold AND um.fi = tv.fi, cc WHERE tr GROUP BY 1, 2, 3, 4)""",
    newton("sc", "nt"),
    f"""de AS (SELECT m % 1000 AS trial_id, tv.fold, {LOSS('(1.0::DOUBLE / (1.0::DOUBLE + exp(-(a + b * (x - mu) / sd))))')} - ({LOSS('p_base')}) AS delta
   FROM nt JOIN tv ON tv.fold = m // 1000 AND tv.fi = (m % 1000 - 1) // 4 JOIN tz ON tz.fold = tv.fold AND tz.fi = tv.fi WHERE NOT tr GROUP BY 1, 2)""",
    "fs AS (SELECT trial_id, count(*) AS n_folds, median(delta) AS score, avg(delta) AS mean_delta, max(delta) AS worst, count_if(delta < 0) AS imp FROM de GROUP BY 1)",
    "ju AS (SELECT *, score > 0 AS g1, imp < ceil(0.75::DOUBLE * n_folds) AS g2, worst > 0.005::DOUBLE AS g3 FROM fs)",
    "ok AS (SELECT * FROM ju WHERE NOT g1 AND NOT g2 AND NOT g3 AND (SELECT min(score) FROM fs) <= 0.002::DOUBLE)",
    "ch AS (SELECT trial_id FROM ok WHERE score <= (SELECT min(score) FROM ok) + 0.002::DOUBLE ORDER BY (trial_id - 1) // 2 % 2, (trial_id - 1) % 2, trial_id LIMIT 1)",
    sql=f"""SELECT CAST(trial_id AS INT) AS trial_id, n_folds, {r6('score')} AS score, {r6('mean_delta')} AS mean_delta, {r6('worst')} AS worst_delta,
  concat_ws(',', CASE WHEN g1 THEN 'central_delta_above_limit' END, CASE WHEN g2 THEN 'too_few_folds_improved' END, CASE WHEN g3 THEN 'worst_delta_above_cap' END) AS rejected_because,
  trial_id IN (SELECT trial_id FROM ch) AS selected FROM ju ORDER BY score, mean_delta, trial_id""",
)
def small_trial_search(spark, d):
    x = rows(spark, d)
    trials = S.trial_table(
        spark, [("discount",), ("tax",)], C=[0.003, 0.3], trading_universe_upweight=[1.0, 1.5], foundation_weight=[1.0], ticker_intercepts=["off"], ticker_interactions=[False]
    )
    folds = P.outer_folds(P.week_list(x, "week"), 20, 3, 10, 2)
    deltas = R.search_trials(x, trials, folds, "week", y="y", baseline="p_base", w="w", universe=F.col("sector").isin(*HOT))
    return leaderboard(trials, deltas)


def walk(spark, d):
    x = rows(spark, d)
    return x, P.walk_forward(P.week_list(x, "week"), 5, 12, 60, expanding=False)


@register("c_search_over_folds")
def c_search_over_folds(spark, d):
    """No SQL (three features; `c_search_one_feature` has it): the standard grid over walk-forward folds, groups purged."""
    x, folds = walk(spark, d)
    return L.one_standard_error(R.c_search(x, C_GRID, ["w", "tax", "discount"], folds, "week", y="y", baseline="p_base", group="group_id"))


@register(
    "c_search_one_feature",
    *WEEKS,
    "fo AS (SELECT 5 - k AS fold, (SELECT max(n) FROM wl) - k * 12 AS ve FROM (SELECT unnest(range(0, 5)) AS k))",
    """fg AS (SELECT fold, (SELECT week FROM wl WHERE i = ve - 12 - 60 + 1) AS tlo, (SELECT week FROM wl WHERE i = ve - 12) AS thi,
   (SELECT week FROM wl WHERE i = ve - 12 + 1) AS vlo, (SELECT week FROM wl WHERE i = ve) AS vhi FROM fo)""",
    "va AS (SELECT fold, group_id, y, tax::DOUBLE AS x FROM lw JOIN fg ON week BETWEEN vlo AND vhi)",
    """tr AS (SELECT fold, y, tax::DOUBLE AS x FROM lw JOIN fg ON week BETWEEN tlo AND thi
   WHERE NOT EXISTS (SELECT 1 FROM va WHERE va.fold = fg.fold AND va.group_id = lw.group_id))""",
    "tz AS (SELECT fold, avg(x) AS mu, stddev_pop(x) AS sd FROM tr GROUP BY 1)",
    f"cc AS (SELECT unnest(range(0, {len(C_GRID)})) AS ci, unnest([{', '.join(f'{c!r}::DOUBLE' for c in C_GRID)}]) AS c)",
    "sc AS (SELECT tr.fold * 1000 + ci AS m, c, (x - mu) / sd AS x, y, count(*)::DOUBLE AS w FROM tr JOIN tz ON tz.fold = tr.fold, cc GROUP BY 1, 2, 3, 4)",
    newton("sc", "nt"),
    f"""sco AS (SELECT c, va.fold, {LOSS('(1.0::DOUBLE / (1.0::DOUBLE + exp(-(a + b * (x - mu) / sd))))')} AS score
   FROM nt JOIN va ON va.fold = m // 1000 JOIN tz ON tz.fold = va.fold JOIN cc ON ci = m % 1000 GROUP BY 1, 2)""",
    "pc AS (SELECT c, avg(score) AS m, stddev_samp(score) / sqrt(count(*)) AS se, count(*) AS n FROM sco GROUP BY 1)",
    "li AS (SELECT m + se + 1e-12::DOUBLE AS lim FROM pc ORDER BY m, c LIMIT 1)",
    sql=f"""SELECT c AS "C", {r6('m')} AS mean_score, {r6('se')} AS se_score, n AS n_folds, c = (SELECT min(c) FROM pc, li WHERE m <= lim) AS chosen FROM pc""",
)
def c_search_one_feature(spark, d):
    x, folds = walk(spark, d)
    scores = R.c_search(x, C_GRID, ["tax"], folds, "week", y="y", baseline="p_base", group="group_id")
    best = L.choose_c(scores, C_GRID, walk_forward=True)
    n = F.count("*")
    return scores.groupBy("C").agg(
        r(F.avg("score"), 6).alias("mean_score"), r(F.stddev_samp("score") / F.sqrt(n), 6).alias("se_score"), n.alias("n_folds")
    ).withColumn("chosen", F.col("C") == best)
