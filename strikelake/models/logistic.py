"""L2 logistic regression, Platt scaling, offset fits, C search and literal-coefficient scoring."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from strikelake.functions.scalar import EPS, clip, expit, logit
from strikelake.models.preprocess import Preprocessor, fit_preprocessor
from strikelake.operators import metrics
from strikelake.operators.skew import with_scalars
from strikelake.operators.weights import upper_ticker

MIN_PLATT_ROWS = 50


@dataclass(frozen=True)
class Platt:
    slope: float
    intercept: float

    def probability(self, eta: Column) -> Column:
        return expit(eta * self.slope + self.intercept)


@dataclass(frozen=True)
class LogitModel:
    prep: Preprocessor
    intercept: float
    coefficients: tuple[float, ...]
    platt: Platt | None = None

    def eta(self) -> Column:
        total = F.lit(float(self.intercept))
        for x, b in zip(self.prep.columns(), self.coefficients):
            total = total + x * F.lit(float(b))
        return total

    def probability(self, calibrated: bool = True) -> Column:
        eta = self.eta()
        p = self.platt.probability(eta) if (self.platt and calibrated) else expit(eta)
        return clip(p, EPS, 1.0 - EPS)


def _fit(df: DataFrame, features: Sequence[Column], y: str, w: str | None, c: float) -> tuple[float, tuple[float, ...]]:
    """min C * sum(w * loss) + |b|^2 / 2 with a free intercept, by Spark ML's distributed L-BFGS."""
    names = [f"_f{i}" for i in range(len(features))]
    weight = F.col(w) if w else F.lit(1.0)
    rows = df.select(F.col(y).cast("double").alias("_y"), weight.cast("double").alias("_w"), *[f.alias(n) for f, n in zip(features, names)])
    total = rows.agg(F.sum("_w")).first()[0]
    data = VectorAssembler(inputCols=names, outputCol="_x").transform(rows).select("_y", "_w", "_x")
    lr = LogisticRegression(
        featuresCol="_x", labelCol="_y", weightCol="_w", standardization=False, elasticNetParam=0.0,
        regParam=1.0 / (c * total), tol=1e-12, maxIter=500,
    )
    model = lr.fit(data)
    return float(model.intercept), tuple(float(v) for v in model.coefficients.toArray())


def fit_logit(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), y: str = "y", w: str | None = None, c: float = 1.0,
    prep: Preprocessor | None = None,
) -> LogitModel:
    prep = prep or fit_preprocessor(df, numeric, categorical)
    intercept, coefs = _fit(df, prep.columns(), y, w, c)
    return LogitModel(prep, intercept, coefs)


def fit_platt(df: DataFrame, eta: Column, y: str = "y", w: str | None = None) -> Platt | None:
    """Calibration on held-out logits; None below 50 rows or with a single class."""
    n, classes = df.agg(F.count("*"), F.count_distinct(y)).first()
    if n < MIN_PLATT_ROWS or classes < 2:
        return None
    intercept, (slope,) = _fit(df, [eta], y, w, 1e6)
    return Platt(slope, intercept)


def fit_calibrated(
    fit: DataFrame, val: DataFrame, train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), *,
    y: str = "y", w_fit: str | None = None, w_val: str | None = None, w_train: str | None = None, c: float = 1.0, platt: bool = True,
) -> LogitModel:
    """The calibration is learned on the fit model's validation logits and used on the final model's."""
    probe = fit_logit(fit, numeric, categorical, y, w_fit, c)
    final = fit_logit(train, numeric, categorical, y, w_train, c)
    return replace(final, platt=fit_platt(val, probe.eta(), y, w_val) if platt else None)


# --- offset fit -----------------------------------------------------------------------------------


def fit_offset(df: DataFrame, features: Sequence[Column], y: str, offset: Column, w: str | None = None, c: float = 1.0, steps: int = 25, tol: float = 1e-10) -> tuple[float, np.ndarray]:
    """Newton steps for sum(w * loss(eta + offset)) + |b|^2 / (2C), intercept free.

    Each step is one distributed pass: tasks add up their share of gradient and Hessian with numpy,
    Spark sums the shares entry by entry, and only p^2 sums reach the driver. Rows with a NULL or NaN feature, label, offset or
    weight are an error, as is a last step of `tol` or more: a fit over part of the rows or an unfinished one is no result.
    """
    names = [f"_f{i}" for i in range(len(features))]
    p = len(names) + 1
    weight = F.col(w) if w else F.lit(1.0)
    rows = df.select(
        F.col(y).cast("double").alias("_y"), weight.cast("double").alias("_w"), offset.cast("double").alias("_o"),
        *[f.cast("double").alias(n) for f, n in zip(features, names)],
    )
    holes = rows.agg(*[F.count_if(F.col(f"{n}").isNull() | F.isnan(n)).alias(n) for n in rows.columns]).first().asDict()
    if any(holes.values()):
        raise ValueError(f"NULL values to impute or drop before the offset fit: { {n: k for n, k in holes.items() if k} }")
    schema = StructType([StructField("k", LongType()), StructField("v", DoubleType())])
    beta = np.zeros(p)
    penalty = np.append(np.full(p - 1, 1.0 / c if c > 0 else 0.0), 0.0)
    for _ in range(steps):
        at = beta.copy()

        def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(p * p + p)
            for b in batches:
                x = np.column_stack([b[names].to_numpy(), np.ones(len(b))])
                prob = 1.0 / (1.0 + np.exp(-(x @ at + b["_o"].to_numpy())))
                wt = b["_w"].to_numpy()
                total[: p * p] += ((x * (wt * prob * (1 - prob))[:, None]).T @ x).ravel()
                total[p * p :] += x.T @ (wt * (prob - b["_y"].to_numpy()))
            yield pd.DataFrame({"k": np.arange(total.size), "v": total})

        sums = rows.mapInPandas(shares, schema).groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        flat = np.array([r["v"] for r in sums])
        hess = flat[: p * p].reshape(p, p) + np.diag(penalty)
        step = np.linalg.solve(hess, flat[p * p :] + penalty * beta)
        beta = beta - step
        if np.max(np.abs(step)) < tol:
            return float(beta[-1]), beta[:-1]
    raise ValueError(f"the offset fit has not converged after {steps} steps: the last one was {np.max(np.abs(step)):.3g}")


# --- selection of C -------------------------------------------------------------------------------


def objective(df: DataFrame, p: Column, y: str, name: str, tie: Column | None = None) -> float:
    rows = df.select(F.col(y).alias("_y"), p.alias("_p"), (tie if tie is not None else F.lit("")).alias("_t"))
    if name == "brier":
        return float(metrics.point_metrics(rows, [], "_y", "_p").first()["brier"])
    if name == "ece_q":
        return float(metrics.ece_equal_mass(rows, [], "_y", "_p", F.col("_t")).first()["ece_q"])
    return float(metrics.point_metrics(rows, [], "_y", "_p").first()["logloss"])


def c_scores(
    folds: Sequence[tuple[int, DataFrame, DataFrame]], grid: Sequence[float], numeric: Sequence[str], categorical: Sequence[str] = (),
    y: str = "y", w: str | None = None, name: str = "logloss", tie: Column | None = None,
) -> list[tuple[float, int, float]]:
    """(C, fold, score); folds lacking a class on either side are left out. One Spark ML job per fit."""
    out = []
    for fold, train, val in folds:
        if any(part.select(y).distinct().limit(2).count() < 2 for part in (train, val)):
            continue
        prep = fit_preprocessor(train, numeric, categorical)  # the same for every C
        for c in grid:
            model = fit_logit(train, numeric, categorical, y, w, c, prep)
            out.append((float(c), fold, objective(val, model.probability(), y, name, tie)))
    return out


def scores_table(spark: SparkSession, scores: Sequence[tuple[float, int, float]]) -> DataFrame:
    return spark.createDataFrame(list(scores), "C double, fold int, score double")


def one_standard_error(scores: DataFrame) -> DataFrame:
    """Smallest C whose mean score is within one standard error of the best mean."""
    per = scores.groupBy("C").agg(
        F.avg("score").alias("mean_score"), F.count("*").alias("n_folds"),
        (F.coalesce(F.stddev_samp("score"), F.lit(0.0)) / F.sqrt(F.count("*"))).alias("se_score"),
    )
    best = per.agg(F.min_by(F.struct("mean_score", "se_score"), F.struct("mean_score", "C")).alias("_b"))
    limit = F.col("_b.mean_score") + F.col("_b.se_score") + 1e-12
    return with_scalars(per, best).where(F.col("mean_score") <= limit).agg(
        F.min("C").alias("C"), F.min_by("mean_score", "C").alias("mean_score"), F.count("*").alias("eligible")
    )


def choose_c(scores: DataFrame, grid: Sequence[float], walk_forward: bool) -> float:
    """One-SE over folds, the minimum for a single holdout, the middle of the grid without any score."""
    if walk_forward:
        row = one_standard_error(scores).first()
        found = row["C"]
    else:
        found = scores.agg(F.min_by("C", F.struct("score", "C"))).first()[0]
    return float(found) if found is not None else float(grid[len(grid) // 2])


# --- two-stage and ticker scoping -----------------------------------------------------------------


def two_stage(base: Column, stage_b: Column, signal: Column) -> tuple[Column, Column, Column]:
    """(p_base, p_final, stage_used): the second model only where the market signal is present."""
    p_base = clip(base, EPS, 1.0 - EPS)
    has = signal.isNotNull()
    final = clip(F.when(has, stage_b).otherwise(p_base), EPS, 1.0 - EPS)
    return p_base, final, F.when(has, "stage_b").otherwise("stage_a")


def offset_stage(base: Column, extra_eta: Column, foundation: Column, platt: Platt | None = None) -> Column:
    """Second-stage logit added to the base logit outside the foundation tickers."""
    eta = logit(base) + F.when(foundation, F.lit(0.0)).otherwise(extra_eta)
    return clip(platt.probability(eta) if platt else expit(eta), EPS, 1.0 - EPS)


def ticker_feature(
    mode: str = "all", foundation: Sequence[str] = (), support: Sequence[str] | None = None, other: str = "OTHER", column: str = "ticker"
) -> Column:
    """Ticker level as the model saw it: foundation tickers merged, unsupported ones folded."""
    name = upper_ticker(column)
    base = F.when(name.isin([f.upper() for f in foundation]), "FOUNDATION").otherwise(name) if (mode == "non_foundation" and foundation) else name
    if not support:
        return base
    return F.when(base.isin([s.upper() for s in support]), base).otherwise(other)


def baseline_probability(p: Column) -> Column:
    return clip(p, EPS, 1.0 - EPS)
