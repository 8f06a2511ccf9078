"""Mixed model: ridge on the market residual, or on a blend weight between market and benchmark."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from strikelake.functions.scalar import clip, to_number
from strikelake.models.preprocess import Preprocessor, fit_preprocessor


@dataclass(frozen=True)
class MixedModel:
    kind: str
    prep: Preprocessor
    intercept: float
    coefficients: tuple[float, ...]

    def raw(self) -> Column:
        total = F.lit(float(self.intercept))
        for x, b in zip(self.prep.columns(), self.coefficients):
            total = total + x * F.lit(float(b))
        return total

    def probability(self, pm: str = "pm_mid", prn: str = "pRN") -> Column:
        return combine(self.kind, self.raw(), F.col(pm), F.col(prn))


def combine(kind: str, prediction: Column, pm: Column, prn: Column) -> Column:
    if kind == "residual":
        return clip(pm + prediction, 0.0, 1.0)
    if kind != "blend":
        raise ValueError(f"unknown model kind {kind!r}")
    w = clip(prediction, 0.0, 1.0)
    return clip(w * prn + (F.lit(1.0) - w) * pm, 0.0, 1.0)


def target(kind: str, y: Column, pm: Column, prn: Column) -> Column:
    """y - pm, or the clipped weight (y - pm) / (pRN - pm), 0.5 where the two prices agree."""
    if kind == "residual":
        return y - pm
    gap = prn - pm
    return clip(F.when(F.abs(gap) < 1e-6, F.lit(0.5)).otherwise(F.try_divide(y - pm, gap)), 0.0, 1.0)


def prepare(df: DataFrame, kind: str, label: str = "label", pm: str = "pm_mid", prn: str = "pRN", min_days: float = 0.0) -> DataFrame:
    out = df.where(F.col(label).isin(0, 1) & to_number(F.col(pm)).between(0.0, 1.0))
    if kind == "blend":
        out = out.where(to_number(F.col(prn)).between(0.0, 1.0))
    if min_days > 0 and "pm_time_to_resolution" in df.columns:
        out = out.where(F.col("pm_time_to_resolution") >= min_days)
    return out.where(F.col("timestamp_utc").isNotNull()) if "timestamp_utc" in df.columns else out


def fit_mixed(
    df: DataFrame, features: Sequence[str], kind: str = "residual", alpha: float = 1.0, label: str = "label", pm: str = "pm_mid", prn: str = "pRN"
) -> MixedModel:
    """Median imputation, then ridge: |y - Xb - a|^2 + alpha |b|^2 (Spark's normal-equation solver)."""
    prep = fit_preprocessor(df, features, scale=False)
    names = [f"_f{i}" for i in range(len(features))]
    rows = df.select(
        target(kind, F.col(label).cast("double"), F.col(pm), F.col(prn)).alias("_t"), *[x.alias(n) for x, n in zip(prep.columns(), names)]
    )
    n, sd = rows.agg(F.count("*"), F.stddev_pop("_t")).first()
    data = VectorAssembler(inputCols=names, outputCol="_x").transform(rows).select("_t", "_x")
    # Spark divides the label by its deviation, so the penalty is scaled along with it.
    lr = LinearRegression(
        featuresCol="_x", labelCol="_t", solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha / n * (sd or 1.0)
    )
    model = lr.fit(data)
    return MixedModel(kind, prep, float(model.intercept), tuple(float(v) for v in model.coefficients.toArray()))
