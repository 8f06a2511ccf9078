"""Fits against numpy solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikelake.models import logistic as L, mixed as X, selection as S
from strikelake.models.preprocess import fit_preprocessor


def newton(x, y, w, c, offset=0.0):
    x1 = np.column_stack([x, np.ones(len(x))])
    pen = np.append(np.full(x.shape[1], 1.0 / c), 0.0)
    b = np.zeros(x1.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x1 @ b + offset)))
        g = x1.T @ (w * (p - y)) + pen * b
        h = (x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(pen)
        b -= np.linalg.solve(h, g)
    return b[-1], b[:-1]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2)) * [1.0, 3.0] + [0.0, 5.0]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.2 * x[:, 1])))).astype(float)
    w = rng.random(300) + 0.5
    rows = [(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(x, y, w)]
    return x, y, w, spark.createDataFrame(rows, "a double, b double, y double, w double")


@pytest.mark.parametrize("c", [0.01, 1.0])
def test_logistic_equals_newton(data, c):
    x, y, w, df = data
    m = L.fit_logit(df, ["a", "b"], y="y", w="w", c=c)
    z = (x - x.mean(0)) / x.std(0)
    b0, b = newton(z, y, w, c)
    assert m.intercept == pytest.approx(b0, abs=1e-5)
    assert np.allclose(m.coefficients, b, atol=1e-5)


def test_offset_fit_equals_newton(data):
    x, y, w, df = data
    off = 0.3 * x[:, 0]
    b0, b = newton(x, y, w, 0.5, off)
    g0, g = L.fit_offset(df, [F.col("a"), F.col("b")], "y", F.col("a") * 0.3, "w", 0.5)
    assert g0 == pytest.approx(b0, abs=1e-8) and np.allclose(g, b, atol=1e-8)


def test_offset_fit_refuses_holes_and_unfinished_fits(data):
    _, _, _, df = data
    for hole in (None, float("nan")):
        with pytest.raises(ValueError, match="NULL"):
            L.fit_offset(df.withColumn("a", F.when(F.col("a") < 2, F.col("a")).otherwise(F.lit(hole))), [F.col("a")], "y", F.lit(0.0))
    with pytest.raises(ValueError, match="converged"):
        L.fit_offset(df, [F.col("a"), F.col("b")], "y", F.lit(0.0), "w", steps=2)
    with pytest.raises(ValueError, match="converged"):
        L.fit_offset(df.withColumn("y", (F.col("a") > 0).cast("double")), [F.col("a")], "y", F.lit(0.0), c=0.0)


@pytest.mark.parametrize("alpha", [0.5, 20.0])
def test_ridge_equals_closed_form(data, alpha):
    x, y, _, df = data
    pm = np.clip(0.5 + 0.05 * x[:, 0], 0, 1)
    rows = df.withColumns({"pm_mid": F.least(F.greatest(F.lit(0.5) + F.col("a") * 0.05, F.lit(0.0)), F.lit(1.0)), "pRN": F.lit(0.5), "label": F.col("y").cast("int")})
    m = X.fit_mixed(rows, ["a", "b"], "residual", alpha)
    t, xc = (y - pm), x - x.mean(0)
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ (t - t.mean()))
    assert np.allclose(m.coefficients, beta, atol=1e-9)
    assert m.intercept == pytest.approx(t.mean() - x.mean(0) @ beta, abs=1e-9)


def test_preprocessor_imputes_and_drops_the_first_level(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (5.0, "b"), (3.0, None)], "x double, c string")
    prep = fit_preprocessor(df, ["x"], ["c"])
    assert prep.medians == (3.0,) and prep.fill == ("b",) and prep.levels == (("b",),)
    seen = df.unionByName(spark.createDataFrame([(3.0, "zzz")], "x double, c string"))
    out = [tuple(r) for r in seen.select(*[c.alias(n) for c, n in zip(prep.columns(), prep.names())]).collect()]
    assert [v for _, v in out] == [1.0, 0.0, 1.0, 1.0, 0.0]


def test_platt_needs_rows_and_both_classes(spark, data):
    _, _, _, df = data
    assert L.fit_platt(df.limit(20), F.col("a")) is None
    assert L.fit_platt(df.withColumn("y", F.lit(1.0)), F.col("a")) is None


def test_feature_sets_respect_policies():
    sets = S.feature_sets("option_only")
    assert len(sets) == 3 * (1 + 2 + 2 + 4)
    assert all("log_m_fwd" in s for s in sets if "x_m" in s)
    assert all("pm_mid" in s for s in S.feature_sets("mixed"))
    assert not any("rv20" in s for s in S.feature_sets("option_only", empty=["rv20"]))


def test_trial_table_and_no_viable_trial(spark):
    t = S.trial_table(spark, S.feature_sets("option_only")[:2], C=[0.1, 1.0], calibration=["none", "platt"])
    assert t.count() == 8 and t.select("trial_id").distinct().count() == 8
    rows = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.4, 0.1)], "trial_id int, score double, se_delta double").withColumn("rejected_because", F.array().cast("array<string>"))
    assert S.choose_trial(rows, [F.col("trial_id")], epsilon=0.01).count() == 0


def test_training_range_sources():
    assert S.training_range({"min_prn_train": 0.1, "max_prn_train": 0.9}) == (0.1, 0.9)
    assert S.training_range({"prn_train_range": [0.2, 0.8]}) == (0.2, 0.8)
    assert S.training_range({"optional_filters": {"drop_prn_extremes": True, "prn_eps": 0.01}}) == (0.01, 0.99)
    assert S.training_range({}) is None
