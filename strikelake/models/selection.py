"""Trial tables, acceptance gates, the simplest-within-margin rule, edges and verdicts."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strikelake.operators.filters import ticker_in
from strikelake.operators.skew import with_scalars

# Feature groups of the search, their policies, dependencies and modes.
FEATURE_GROUPS = (
    {"name": "volatility", "policy": "at_most_one", "options": ("rv20", "rv20_sqrtT"), "modes": ("option_only", "mixed")},
    {"name": "moneyness", "policy": "any_subset", "options": ("log_m_fwd", "abs_log_m_fwd"), "modes": ("option_only", "mixed")},
    {
        "name": "interactions", "policy": "any_subset", "options": ("x_m", "x_abs_m"), "modes": ("option_only", "mixed"),
        "dependencies": {"x_m": ("log_m_fwd",), "x_abs_m": ("abs_log_m_fwd",)},
    },
    {"name": "pm_signal", "policy": "required_if_mixed", "options": ("pm_mid",), "modes": ("mixed",)},
    {
        "name": "pm_auxiliary", "policy": "any_subset", "modes": ("mixed",),
        "options": ("pm_spread", "pm_liquidity_proxy", "pm_momentum_1h", "pm_momentum_1d", "pm_time_to_resolution"),
    },
)
BASE_FEATURES = ("x_logit_prn",)


def group_choices(policy: str, options: Sequence[str]) -> list[tuple[str, ...]]:
    if policy == "at_most_one":
        return [(), *[(o,) for o in options]]
    if policy == "any_subset":
        return [c for n in range(len(options) + 1) for c in itertools.combinations(options, n)]
    if policy in ("required", "required_if_mixed"):
        return [tuple(options)]
    raise ValueError(f"unknown policy {policy!r}")


def feature_sets(mode: str, groups: Sequence[Mapping] = FEATURE_GROUPS, empty: Sequence[str] = ()) -> list[tuple[str, ...]]:
    """Every allowed feature set of a mode; options without any value in the data (`empty`) are left out."""
    used = [g for g in groups if mode in g["modes"]]
    needs = {k: v for g in groups for k, v in g.get("dependencies", {}).items()}
    picks = [group_choices(g["policy"], [o for o in g["options"] if o not in empty]) for g in used]
    out = []
    for combo in itertools.product(*picks):
        chosen = [f for part in combo for f in part]
        if all(set(needs.get(f, ())) <= set(chosen) for f in chosen):
            out.append(tuple(dict.fromkeys([*BASE_FEATURES, *chosen])))
    return out


def trial_table(spark: SparkSession, sets: Sequence[Sequence[str]], **axes: Sequence) -> DataFrame:
    """Product of feature sets and settings, one numbered row per trial (driver-sized by nature)."""
    names = list(axes)
    rows = [(i, list(s), *values) for i, (s, *values) in enumerate(itertools.product(sets, *axes.values()), start=1)]
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}
    ddl = ", ".join(["trial_id int", "features array<string>", *[f"{n} {kinds[type(axes[n][0])]}" for n in names]])
    return spark.createDataFrame(rows, ddl)


def central(outer: bool = True) -> Column:
    names = ["outer_median_delta", "delta_logloss", "mean_delta", "score"] if outer else ["delta_logloss", "mean_delta", "score"]
    return F.coalesce(*[F.col(n) for n in names])


def acceptance(
    stats: DataFrame, delta_limit: float = 0.0, min_improved: float = 0.6, worst_cap: float = 0.02, n: str = "n_folds",
    improved: str = "folds_improved", worst: str = "worst_delta", middle: str = "median_delta",
) -> DataFrame:
    """`rejected_because`: the gates a trial fails (an empty list means accepted)."""
    need = F.ceil(F.lit(min_improved) * F.greatest(F.col(n), F.lit(1)))
    gates = F.array(
        F.when(F.col(middle).isNull(), "missing_central_delta_metric").when(F.col(middle) > delta_limit, "central_delta_above_limit"),
        F.when(F.col(improved) < need, "too_few_folds_improved"),
        F.when(F.col(worst).isNull(), "missing_worst_delta").when(F.col(worst) > worst_cap, "worst_delta_above_cap"),
    )
    return stats.withColumn("rejected_because", F.array_compact(gates))


def choose_trial(
    accepted: DataFrame, simplicity: Sequence[Column], score: str = "score", epsilon: float = 0.002, rule: str = "epsilon", se: str = "se_delta"
) -> DataFrame:
    """The simplest accepted trial whose score is within the margin of the best accepted one.

    Empty when even the best score of all trials is worse than the baseline by more than epsilon.
    """
    scored = accepted.where(F.col(score).isNotNull())
    overall = scored.agg(F.min(score).alias("_top"))
    pool = with_scalars(scored, overall).where((F.col("_top") <= epsilon) & (F.size("rejected_because") == 0)).drop("_top")
    margin = F.coalesce(F.col(f"_b.{se}"), F.lit(epsilon)) if rule == "one_se" else F.lit(epsilon)
    fields = [score, se] if rule == "one_se" else [score]
    best = pool.agg(F.min_by(F.struct(*fields), F.struct(score, "trial_id")).alias("_b"))
    short = with_scalars(pool, best).where(F.col(score) <= F.col(f"_b.{score}") + margin)
    rank = F.struct(*[s.alias(f"k{i}") for i, s in enumerate(simplicity)], "trial_id")
    return short.agg(F.min_by(F.struct(*pool.columns), rank).alias("_row")).where(F.col("_row").isNotNull()).select("_row.*")


def simplicity_key(features: str = "features", c: str = "C") -> list[Column]:
    return [
        F.size(features), F.when(F.col("ticker_intercepts") == "on", 1).otherwise(0), F.col("ticker_interactions").cast("int"), F.col(c),
        F.abs(F.col("trading_universe_upweight") - 1.0), F.abs(F.col("foundation_weight") - 1.0),
    ]


def leaderboard(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("score").asc_nulls_last(), F.col("mean_delta").asc_nulls_last(), "trial_id")


# --- edge -----------------------------------------------------------------------------------------


def with_edge(df: DataFrame, p_hat: str = "pHAT", yes: str = "pPM_buy", no: str = "qPM_buy", prn_range: tuple[float, float] | None = None) -> DataFrame:
    """Best of the two contracts (YES on ties); no edge outside the benchmark range the model saw."""
    inside = F.lit(True)
    if prn_range:
        inside = F.coalesce(F.col("pRN").between(*prn_range), F.lit(False))
    q = df.withColumn("qHAT", F.lit(1.0) - F.col(p_hat))
    empty = F.lit(None).cast("double")
    y = F.when(inside, F.col(p_hat) - F.col(yes)) if yes in df.columns else empty
    n = F.when(inside, F.col("qHAT") - F.col(no)) if no in df.columns else empty
    q = q.withColumns({"_y": y, "_n": n, "_in": inside})
    take_yes = F.col("_y").isNotNull() & (F.col("_n").isNull() | (F.col("_y") >= F.col("_n")))
    edge = F.when(take_yes, F.col("_y")).otherwise(F.col("_n"))
    source = F.when(~F.col("_in"), "pRN_out_of_range").when(take_yes, "yes contract").when(F.col("_n").isNotNull(), "no contract")
    return q.withColumns({"edge": edge, "edge_source": source}).drop("_y", "_n", "_in")


def top_edges(df: DataFrame, n: int = 10, exclude: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> DataFrame:
    out = df.where(ticker_in("ticker", exclude, exclude=True)) if exclude else df
    # NULL edges sort last and are dropped after the top-n: a filter on edge before the sort would be
    # pushed down and evaluate the whole model expression once more per row.
    return out.orderBy(F.col("edge").desc_nulls_last(), *tiebreak).limit(n).where(F.col("edge").isNotNull())


def probability_summary(df: DataFrame, column: str = "pHAT") -> DataFrame:
    c = F.col(column)
    return df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"))


# Names of the lower and upper bound in run metadata.
RANGE_BOUNDS = (("min_prn_train", "max_prn_train"), ("prn_train_min", "prn_train_max"))


def _is_range(values: Sequence) -> bool:
    return len(values) == 2 and all(isinstance(v, (int, float)) for v in values) and 0.0 <= values[0] < values[1] <= 1.0


def training_range(metadata: Mapping) -> tuple[float, float] | None:
    """Benchmark range from run metadata: explicit bounds, a pair, or the tail filter's epsilon."""
    tails = metadata.get("optional_filters") or {}
    eps = tails.get("prn_eps", 1e-4) if tails.get("drop_prn_extremes") else None
    rules = [
        *[[metadata.get(name) for name in names] for names in RANGE_BOUNDS],
        list(metadata.get("prn_train_range") or ()),
        [eps, 1.0 - eps] if eps else [],
    ]
    return next(((float(r[0]), float(r[1])) for r in rules if _is_range(r)), None)


def verdicts(metrics: DataFrame) -> DataFrame:
    """Per split: model minus baseline for every metric, and a verdict by the sign of the log-loss delta."""
    names = [c for c in ("logloss", "brier", "ece", "ece_q") if c in metrics.columns]
    base, mod = F.col("model").startswith("baseline"), F.col("model") == "logit"
    wide = metrics.groupBy("split").agg(
        *[F.max(F.when(base, F.col(n))).alias(f"baseline_{n}") for n in names], *[F.max(F.when(mod, F.col(n))).alias(f"model_{n}") for n in names]
    )
    both = wide.where(F.col("baseline_logloss").isNotNull() & F.col("model_logloss").isNotNull())
    out = both.withColumns({f"delta_{n}": F.col(f"model_{n}") - F.col(f"baseline_{n}") for n in names})
    return out.withColumn("status", F.when(F.col("delta_logloss") < 0, "good").otherwise("unusable"))
