"""Trial search against dense numpy fits, one at a time."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikelake.models import search as R, selection as S
from strikelake.models.logistic import choose_c
from strikelake.operators.quality import fold_statistics
from strikelake.operators.splits import Fold

WEEKS = [date(2024, 1, 5) + timedelta(7 * i) for i in range(16)]
FOLDS = [Fold(1, WEEKS[0], WEEKS[9], WEEKS[10], WEEKS[12]), Fold(2, WEEKS[0], WEEKS[12], WEEKS[13], WEEKS[15])]


def newton(x, y, w, pen):
    b = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pen), x.T @ (w * (p - y)) + pen * b)
    return b


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 900
    a, b = rng.normal(size=n), rng.normal(2.0, 4.0, size=n)
    t, wk = rng.integers(0, 4, n), rng.integers(0, 16, n)
    base = 1 / (1 + np.exp(-a))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.7 * a + 0.2 * b + 0.4 * t - 1)))).astype(float)
    hole = rng.random(n) < 0.1
    rows = [
        (float(a[i]), None if hole[i] else float(b[i]), float(y[i]), float(base[i]), f"T{t[i]}", WEEKS[wk[i]], float(0.5 + rng.random()))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "a double, b double, y double, base double, t string, week date, w double").repartition(5)


def brute(rows, fold, feats, c, up, on, slope, platt):
    """Validation log loss of one trial, with every ticker a dense column."""
    side = lambda keep: [r for r in rows if keep(r[5])]
    train, val = side(lambda k: fold.train_lo <= k <= fold.train_hi), side(lambda k: fold.val_lo <= k <= fold.val_hi)
    weeks = sorted({r[5] for r in train})
    held_from = weeks[-min(max(1, round(len(weeks) * 0.2)), len(weeks) - 1)]

    def fit(part):
        raw = np.array([[np.nan if r[f] is None else r[f] for f in feats] for r in part], dtype=float)
        med = np.nanmedian(raw, 0)
        full = np.where(np.isnan(raw), med, raw)
        mean, sd = full.mean(0), full.std(0)
        tickers = ["T0", "T1", "T2", "T3"]

        def design(part):
            raw = np.array([[np.nan if r[f] is None else r[f] for f in feats] for r in part], dtype=float)
            cols = [(np.where(np.isnan(raw), med, raw) - mean) / sd]
            if on:
                cols.append(np.array([[float(r[4] == t) for t in tickers[1:]] for r in part]))
            if slope:
                cols.append(np.array([[r[0] * float(r[4] == t) for t in tickers] for r in part]))
            return np.column_stack([*cols, np.ones(len(part))])

        w = np.array([r[6] * (up if r[4] == "T1" else 1.0) for r in part])
        x = design(part)
        beta = newton(x, np.array([r[2] for r in part]), c * w / w.mean(), np.append(np.ones(x.shape[1] - 1), 0.0))
        return lambda part: design(part) @ beta

    eta = fit(train)(val)
    if platt:
        probe = fit([r for r in train if r[5] < held_from])
        held = [r for r in train if r[5] >= held_from]
        e, w = probe(held), np.array([r[6] * (up if r[4] == "T1" else 1.0) for r in held])
        ab = newton(np.column_stack([e, np.ones(len(e))]), np.array([r[2] for r in held]), w, np.array([1e-6, 0.0]))
        eta = ab[0] * eta + ab[1]
    p, y = 1 / (1 + np.exp(-eta)), np.array([r[2] for r in val])
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def test_every_trial_equals_its_dense_fit(spark, data):
    rows, df = data
    trials = S.trial_table(
        spark, [("a",), ("a", "b")], C=[0.05, 1.0], calibration=["none", "platt"], trading_universe_upweight=[1.0, 1.5],
        ticker_intercepts=["off", "on"], ticker_interactions=[False, True],
    )
    got = R.search_trials(df, trials, FOLDS, "week", y="y", baseline="base", w="w", universe=F.col("t") == "T1", level=F.col("t"))
    got = {(r["trial_id"], r["fold"]): r for r in got.collect()}
    grid = trials.collect()
    assert len(got) == 2 * len(grid) == 128
    at = {"a": 0, "b": 1}
    for t in grid:
        for f in FOLDS:
            want = brute(
                rows, f, [at[x] for x in t["features"]], t["C"], t["trading_universe_upweight"], t["ticker_intercepts"] == "on", t["ticker_interactions"],
                t["calibration"] == "platt",
            )
            row = got[t["trial_id"], f.fold]
            assert row["score"] == pytest.approx(want, abs=1e-7)
            assert row["delta"] == pytest.approx(row["score"] - row["baseline_score"])


def test_many_tickers_stay_rows_of_a_table(spark):
    """5,000 tickers with an intercept and a slope each: the fit of a rare ticker equals that of its mirror twin."""
    n = 20000
    df = spark.range(n).select(
        (F.col("id") % 5000).cast("string").alias("t"), F.sin(F.col("id") / 7).alias("a"), F.lit(0.5).alias("base"),
        ((F.hash("id") % 3 == 0) | (F.sin(F.col("id") / 7) > 0.3)).cast("double").alias("y"),
        F.date_add(F.lit(WEEKS[0]), ((F.col("id") / 5000).cast("int") * 28).cast("int")).alias("week"),
    )
    fold = Fold(1, WEEKS[0], WEEKS[9], WEEKS[10], WEEKS[15])
    trials = S.trial_table(spark, [("a",)], C=[0.1], ticker_intercepts=["on"], ticker_interactions=[False, True])
    out = R.search_trials(df, trials, [fold], "week", y="y", baseline="base", level=F.col("t")).collect()
    assert len(out) == 2 and all(np.isfinite(r["score"]) and r["delta"] < 0 for r in out)


def test_folds_without_a_class_and_empty_folds(spark, data):
    _, df = data
    trials = S.trial_table(spark, [("a",)], C=[1.0], calibration=["platt"])
    one_class = df.withColumn("y", F.when(F.col("week") <= WEEKS[9], 1.0).otherwise(F.col("y")))
    got = R.search_trials(one_class, trials, FOLDS, "week", y="y", baseline="base")
    assert [r["fold"] for r in got.collect()] == [2]
    no_rows = [Fold(1, date(1990, 1, 5), date(1990, 2, 2), WEEKS[10], WEEKS[12])]
    with pytest.raises(ValueError, match="empty"):
        R.search_trials(df, trials, no_rows, "week", y="y", baseline="base")
    with pytest.raises(ValueError, match="objective"):
        R.search_trials(df, trials, FOLDS, "week", y="y", baseline="base", objective="ece_q")


def test_search_to_selected_trial_and_c(spark, data):
    rows, df = data
    trials = S.trial_table(spark, [("a",), ("a", "b")], **{**R.DEFAULT_AXES, "C": [0.1, 1.0], "calibration": ["none"]})
    deltas = R.search_trials(df, trials, FOLDS, "week", y="y", baseline="base", universe=F.col("t") == "T1", foundation=F.col("t") == "T2", level=F.col("t"))
    stats = fold_statistics(deltas, delta="delta").withColumn("score", F.col("median_delta")).join(trials, "trial_id")
    chosen = S.choose_trial(S.acceptance(stats), S.simplicity_key(), epsilon=0.5).collect()
    # Within so wide a margin the simplest trial wins: one feature, no intercepts, the smaller C, weights of 1.
    assert len(chosen) == 1
    assert (chosen[0]["features"], chosen[0]["ticker_intercepts"], chosen[0]["C"], chosen[0]["foundation_weight"]) == (["a"], "off", 0.1, 1.0)
    scores = R.c_search(df, [0.01, 1.0], ["a", "b"], FOLDS, "week", y="y", baseline="base")
    mean = lambda c: np.mean([brute([(*r[:6], 1.0) for r in rows], f, [0, 1], c, 1.0, False, False, False) for f in FOLDS])
    best = min([0.01, 1.0], key=mean)
    assert choose_c(scores, [0.01, 1.0], walk_forward=False) in (0.01, 1.0)
    per = {r["C"]: r["m"] for r in scores.groupBy("C").agg(F.avg("score").alias("m")).collect()}
    assert min(per, key=per.get) == best and per[best] == pytest.approx(mean(best), abs=1e-7)


def test_logistic_step_from_one_exponential():
    from strikelake.models.search import _logistic

    eta = np.array([-1e4, -700.0, -3.0, 0.0, 2.5, 700.0, 1e4])
    prob, softplus = _logistic(eta)
    assert np.allclose(prob, 1 / (1 + np.exp(-np.clip(eta, -700, 700))), atol=1e-15) and np.allclose(softplus, np.logaddexp(0.0, eta), rtol=1e-14)


def test_most_fits_start_where_their_design_has_led(spark, data, monkeypatch):
    """Over all passes a fit is met about twice, not once for each of its Newton steps from zero."""
    _, df = data
    trials = S.trial_table(
        spark, [("a",), ("a", "b")], C=[0.1, 0.15, 0.2, 0.3], trading_universe_upweight=[1.0, 1.1, 1.2], foundation_weight=[1.0, 1.1, 1.2], ticker_intercepts=["off", "on"]
    )
    met, keep = [], R._summed

    def counted(*args):
        out = keep(*args)
        if "level" in out:
            met.append(len(out[out["level"] < 0][["part", "fit"] if "part" in out else ["pair"]].drop_duplicates()))
        return out

    monkeypatch.setattr(R, "_summed", counted)
    up, fd = F.col("t") == "T1", F.col("t") == "T2"
    R.search_trials(df, trials, FOLDS, "week", y="y", baseline="base", w="w", universe=up, foundation=fd, level=F.col("t")).count()
    assert sum(met) <= 3.5 * 2 * trials.count()


def test_fits_far_from_the_one_that_leads(spark, data):
    rows, df = data
    trials = S.trial_table(spark, [("a", "b")], C=[100.0, 1e-4], trading_universe_upweight=[1.0, 200.0, 0.01], ticker_intercepts=["off", "on"], calibration=["none", "platt"])
    got = R.search_trials(df, trials, FOLDS, "week", y="y", baseline="base", w="w", universe=F.col("t") == "T1", level=F.col("t")).collect()
    grid = {t["trial_id"]: t for t in trials.collect()}
    assert len(got) == 2 * len(grid)
    for r in got:
        t = grid[r["trial_id"]]
        want = brute(rows, FOLDS[r["fold"] - 1], [0, 1], t["C"], t["trading_universe_upweight"], t["ticker_intercepts"] == "on", False, t["calibration"] == "platt")
        assert r["score"] == pytest.approx(want, abs=1e-7)
