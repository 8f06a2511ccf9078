"""Trial search in few passes: the Newton steps of every trial on every fold share one scan of the rows.

A row is stored once, with bitmasks of the folds it trains, fits and validates. In a pass each task adds up gradient, Hessian
and loss of all unfinished fits over its rows, Spark sums the shares, and the driver takes the steps. What reaches the
driver is trials x folds x (features^2 + levels) sums; it grows with the grid and the supported tickers, never with the rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from strikelake.functions.scalar import EPS, to_number
from strikelake.models.logistic import MIN_PLATT_ROWS
from strikelake.operators.metrics import loss_log, loss_squared
from strikelake.operators.percentiles import column_medians
from strikelake.operators.splits import Fold, fold_facts, fold_masks, require_whole_folds
from strikelake.session import materialize

OBJECTIVES = ("logloss", "brier")
PLATT_C = 1e6
ROWS_PER_TASK = 500_000
BATCH_ROWS = 65_536  # rows whose levels are met together in a pass
CELLS = 32_768  # rows x fits worked on at once; a pass is quickest while they stay in a core's cache

# The default search grid.
DEFAULT_FEATURE_SETS = (
    ("x_logit_prn",),
    ("x_logit_prn", "rv20"),
    ("x_logit_prn", "abs_log_m_fwd"),
    ("x_logit_prn", "rv20", "abs_log_m_fwd"),
    ("x_logit_prn", "rv20", "abs_log_m_fwd", "log_rel_spread"),
)
DEFAULT_AXES = {
    "C": [0.003, 0.01, 0.03, 0.1, 0.3],
    "calibration": ["none", "platt"],
    "trading_universe_upweight": [1.0, 1.25, 1.5],
    "foundation_weight": [1.0, 1.25, 1.5],
    "ticker_intercepts": ["off", "on"],
    "ticker_interactions": [False],
}


@dataclass(frozen=True)
class Fits:
    """What the fits need beside the rows. Parts are row sets: a fold's train rows, then its fit rows (train without the held weeks)."""

    features: tuple[str, ...]
    used: np.ndarray  # fit x (features + intercept)
    c: np.ndarray
    variant: np.ndarray  # fit -> weight variant
    blocks: np.ndarray  # fit x (ticker intercepts, ticker interactions)
    factors: tuple[tuple[float, float], ...]  # variant -> (universe, foundation)
    center: np.ndarray  # part x (medians, means, scales) x features
    weight_means: np.ndarray  # part x variant
    reference: np.ndarray  # part -> level without an intercept of its own
    n_levels: int


# --- rows -----------------------------------------------------------------------------------------


def ticker_levels(df: DataFrame, level: Column, least: int = 1) -> DataFrame:
    """(level, _lv): levels with at least `least` rows, numbered in text order."""
    kept = df.select(level.alias("level")).where(F.col("level").isNotNull()).groupBy("level").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return kept.select("level", (F.row_number().over(Window.orderBy("level")) - 1).cast("int").alias("_lv"))


def _held_weeks(masked: DataFrame, folds: Sequence[Fold], week: str) -> list:
    """First held week of each fold: the last fifth of its train weeks, half-even, at least one; None below two weeks."""
    sets = [F.sort_array(F.collect_set(F.when(F.col("train_folds").bitwiseAND(F.lit(1 << i)) > 0, F.col(week)))).alias(f"w{i}") for i in range(len(folds))]
    row = masked.agg(*sets).first()  # weeks of a calendar
    take = lambda w: min(max(1, round(len(w) * 0.2)), len(w) - 1)
    return [w[-take(w)] if len(w) >= 2 else None for w in row]


def search_rows(
    df: DataFrame, folds: Sequence[Fold], week: str, *, y: str, baseline: str, features: Sequence[str], group: str | None = None, w: str | None = None,
    universe: Column | None = None, foundation: Column | None = None, level: Column | None = None, levels: DataFrame | None = None, embargo: int = 0,
) -> DataFrame:
    """Every usable row once, written: label, baseline, weight, flags, level number, features and the masks of its parts.

    Rows without a label or baseline, or outside every fold, take no part. A NULL weight counts as 0, a NULL or unsupported
    level has no block, a NULL feature is imputed by the medians of the part. A fold emptied by purge or embargo raises.
    """
    masked = fold_masks(df.where(F.col(y).isNotNull() & F.col(baseline).isNotNull()), list(folds), week, group, embargo)
    facts = fold_facts(masked, list(folds), week)
    known = facts.collect()  # a row per fold
    require_whole_folds(df.sparkSession.createDataFrame(known, facts.schema))
    n = len(folds)
    held = [F.when(F.col("train_folds").bitwiseAND(F.lit(1 << i)) > 0, F.when(F.col(week) >= F.lit(start), F.lit(1 << i))) for i, start in enumerate(_held_weeks(masked, folds, week)) if start]
    held_bits = functools.reduce(lambda a, b: a.bitwiseOR(b), [F.coalesce(h, F.lit(0)) for h in held], F.lit(0)).cast("long")
    flag = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    rows = masked.where((F.col("train_folds") > 0) | (F.col("val_folds") > 0)).select(
        F.col(y).cast("double").alias("_y"), F.col(baseline).cast("double").alias("_b"),
        (F.coalesce(to_number(F.col(w)), F.lit(0.0)) if w else F.lit(1.0)).alias("_w"), flag(universe).alias("_up"), flag(foundation).alias("_fd"),
        (level if level is not None else F.lit(None).cast("string")).alias("level"), "val_folds", "train_folds", held_bits.alias("held_folds"),
        *[to_number(F.col(f)).alias(f"f{i}") for i, f in enumerate(features)],
    )
    fit = F.col("train_folds").bitwiseAND(F.bitwise_not("held_folds"))
    rows = rows.withColumn("_parts", F.col("train_folds").bitwiseOR(F.shiftleft(fit, n)))
    rows = rows.join(levels, "level", "left") if levels is not None else rows.withColumn("_lv", F.lit(None).cast("int"))
    out = rows.withColumn("_lv", F.coalesce("_lv", F.lit(-1))).drop("level", "train_folds")
    # A pass costs far more per byte than a scan: the table is dealt by rows to all cores, not packed by bytes.
    most = max(r["n_train"] + r["n_val"] for r in known)
    return materialize(out.repartition(max(df.sparkSession.sparkContext.defaultParallelism, most // ROWS_PER_TASK)), "search_rows")


def _part(i: int, column: str = "_parts") -> Column:
    return F.col(column).bitwiseAND(F.lit(1 << i).cast("long")) > 0


def _weight(factors: tuple[float, float]) -> Column:
    up, fd = factors
    return F.col("_w") * F.when(F.col("_up"), up).otherwise(1.0) * F.when(F.col("_fd"), fd).otherwise(1.0)


def _center(rows: DataFrame, n_features: int, n_parts: int) -> np.ndarray:
    """Exact medians, then means and population deviations after imputation, of all features in all parts."""
    cells = [(p, f) for p in range(n_parts) for f in range(n_features)]
    out = np.zeros((n_parts, 3, n_features))
    out[:, 2] = 1.0
    if not cells:
        return out
    tall = rows.select(*[F.when(_part(p), F.col(f"f{f}")).alias(f"{p}_{f}") for p, f in cells])
    for r in column_medians(tall, tall.columns).collect():
        p, f = map(int, r["column"].split("_"))
        out[p, 0, f] = r["median"]
    filled = {(p, f): F.when(_part(p), F.coalesce(F.col(f"f{f}"), F.lit(float(out[p, 0, f])))) for p, f in cells}
    row = rows.agg(*[F.avg(x) for x in filled.values()], *[F.stddev_pop(x) for x in filled.values()]).first()
    for k, (p, f) in enumerate(cells):
        out[p, 1, f] = row[k] or 0.0
        out[p, 2, f] = row[len(cells) + k] or 1.0
    return out


# --- fits -----------------------------------------------------------------------------------------


def _summed(rows: DataFrame, kernel: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], keys: Sequence[str], width: int) -> pd.DataFrame:
    names = [f"v{i}" for i in range(width)]
    schema = StructType([*[StructField(k, IntegerType()) for k in keys], *[StructField(v, DoubleType()) for v in names]])
    return rows.mapInPandas(kernel, schema).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in names]).toPandas()


def _eta_maker(fits: Fits, beta: np.ndarray, gamma: np.ndarray) -> Callable:
    """A self-contained function (batch, part, rows, fits) -> design, slope column and linear predictors, to run in tasks."""
    names = [f"f{i}" for i in range(len(fits.features))]
    center, block_at = fits.center, np.cumsum(fits.blocks.any(1)) - 1

    def make(b: pd.DataFrame, part: int, at: np.ndarray, which: np.ndarray) -> tuple:
        raw = b[names].to_numpy(dtype=float)[at].reshape(len(at), len(names))
        x, slope = _design(raw, center[part])
        eta = x @ beta[part, which].T
        own = fits_blocks[which]
        if own.any():
            lv = b["_lv"].to_numpy()[at]
            cols = np.flatnonzero(own)
            # Level -1 meets the zeros stored behind the last level.
            g = gamma[part][block_at[which[cols]]]
            eta[:, cols] += g[:, lv, 0].T + g[:, lv, 1].T * slope[:, None]
        return x, slope, eta

    fits_blocks = fits.blocks.any(1)
    return make


def _design(raw: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Imputed and scaled features with an intercept, and the slope column of the ticker interactions."""
    med, mean, sd = center
    x = np.column_stack([(np.where(np.isnan(raw), med, raw) - mean) / sd, np.ones(len(raw))])
    return x, np.nan_to_num(raw[:, 0]) if raw.shape[1] else np.zeros(len(raw))


def _logistic(eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(1 / (1 + exp(-eta)), log(1 + exp(eta)))."""
    prob, _, softplus = _curves(eta)
    return prob, softplus


def _curves(eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, p (1 - p), log(1 + exp(eta))) with p = 1 / (1 + exp(-eta)), from one exponential, which can't overflow."""
    small = np.abs(eta)
    np.negative(small, out=small)
    np.exp(small, out=small)
    softplus = 1.0 + small
    curve = np.reciprocal(softplus)
    small *= curve  # the smaller one of p and 1 - p
    curve *= small
    np.log(softplus, out=softplus)
    softplus += np.maximum(eta, 0.0)
    np.subtract(0.5, small, out=small)
    np.copysign(small, eta, out=small)
    small += 0.5
    return small, curve, softplus


def _gathered(batches: Iterator[pd.DataFrame], least: int = BATCH_ROWS) -> Iterator[pd.DataFrame]:
    """Batches joined to at least ``least`` rows, so that the rows of a level are met together."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= least:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _runs(changes: np.ndarray, n: int, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of the runs that end where ``changes`` (n - 1 flags) says so, cut to ``most`` rows."""
    edges = [0, *(np.flatnonzero(changes) + 1).tolist(), n]
    for lo, hi in zip(edges[:-1], edges[1:]):
        for i in range(lo, hi, most):
            yield i, min(i + most, hi)


def _flag_classes(factors: tuple[tuple[float, float], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Class of a row by its flags (universe + 2 * foundation), and variant x class factors; flags no variant tells apart share a class."""
    up, fd = np.array(factors, dtype=float).reshape(-1, 2).T
    table = np.column_stack([np.ones(len(up)), up, fd, up * fd])
    kinds, class_of = np.unique(table, axis=1, return_inverse=True)
    return class_of.reshape(-1), kinds


def _sums(rows: DataFrame, fits: Fits, todo: np.ndarray, beta: np.ndarray, gamma: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One pass: Hessian, gradient and loss at the coefficients of all fits in `todo` (part x fit).

    Weights are the fit's own; with `split` they are the rows' plain ones and sums are kept by class of flags, from which the sums of
    every variant follow. Returns (part, fit) pairs, their sums (pair x class x width), and level sums (pair of ticker fits x class x
    level x width) with the pair's place among them or -1.
    """
    n_parts, n_fits = todo.shape
    p1, k = len(fits.features) + 1, fits.n_levels
    own, center, variant, weight_means = fits.blocks.any(1), fits.center, fits.variant, fits.weight_means
    class_of, kinds = _flag_classes(fits.factors)
    n_classes = kinds.shape[1] if split else 1
    one, two = np.triu_indices(p1)
    n_h = len(one)
    width, level_width = n_h + p1 + 1, 2 * p1 + 3
    pairs = np.argwhere(todo)
    with_levels = own[pairs[:, 1]] if k else np.zeros(len(pairs), dtype=bool)
    block = np.where(with_levels, np.cumsum(with_levels) - 1, -1)
    block_at = np.cumsum(own) - 1
    names = [f"f{i}" for i in range(p1 - 1)]
    # Part by part and family by family: places among the pairs, coefficients and level coefficients.
    plan = []
    for part in range(n_parts):
        for levelled in (False, True):
            at = np.flatnonzero((pairs[:, 0] == part) & (own[pairs[:, 1]] == levelled))
            if len(at):
                f = pairs[at, 1]
                scale = np.ones((len(f), kinds.shape[1])) if split else kinds[variant[f]] / weight_means[part, variant[f]][:, None]
                plan.append((part, levelled, at, beta[part, f], gamma[part, block_at[f]] if levelled else None, scale))
    wide = max(width, level_width)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(pairs), n_classes, width))
        by_level = np.zeros((int(with_levels.sum()), n_classes, k, level_width))
        for b in _gathered(batches):
            lv, kind = b["_lv"].to_numpy(), class_of[b["_up"].to_numpy(dtype=int) + 2 * b["_fd"].to_numpy(dtype=int)]
            order = np.lexsort((lv, kind))
            lv, kind, parts = lv[order], kind[order], b["_parts"].to_numpy()[order]
            label, weight = b["_y"].to_numpy()[order], b["_w"].to_numpy()[order]
            raw = b[names].to_numpy(dtype=float)[order].reshape(len(b), len(names))
            at_part = -1
            for part, levelled, at, coef, g, scale in plan:
                if part != at_part:
                    at_part, inside = part, np.flatnonzero((parts >> part) & 1 == 1)
                    x, slope = _design(raw[inside], center[part])
                    w, in_lv, in_kind = weight[inside], lv[inside], kind[inside]
                    products = (x[:, one] * x[:, two]) * w[:, None]
                    level_products = np.column_stack([x, slope[:, None] * x, slope * slope]) * w[:, None] if with_levels.any() else None
                    plain = np.column_stack([x, slope]) * w[:, None]
                    hit = plain * label[inside, None]
                if not len(inside):
                    continue
                changes = in_kind[1:] != in_kind[:-1]
                if levelled:
                    changes = changes | (in_lv[1:] != in_lv[:-1])
                for lo, hi in _runs(changes, len(inside), max(64, CELLS // len(at))):
                    run, level = slice(lo, hi), int(in_lv[lo]) if levelled else -1
                    eta = x[run] @ coef.T
                    if level >= 0:
                        eta += g[:, level, 0]
                        if g[:, level, 1].any():
                            eta += slope[run, None] * g[:, level, 1]
                    prob, curve, softplus = _curves(eta)
                    positives = hit[run].sum(0)
                    grad = prob.T @ plain[run] - positives
                    value = w[run] @ softplus - (label[inside[run]] * w[run]) @ eta
                    times, c = scale[:, in_kind[lo], None], int(in_kind[lo]) if split else 0
                    total[at, c] += np.column_stack([curve.T @ products[run], grad[:, :p1], value]) * times
                    if level >= 0:
                        by_level[block[at], c, level] += np.column_stack([curve.T @ level_products[run], grad[:, p1 - 1 :]]) * times
        for c in range(n_classes):
            yield frame(np.arange(len(pairs)), c, np.full(len(pairs), -1), total[:, c])
            hit_levels = np.argwhere(by_level[:, c].any(2))
            if len(hit_levels):
                yield frame(np.flatnonzero(with_levels)[hit_levels[:, 0]], c, hit_levels[:, 1], by_level[hit_levels[:, 0], c, hit_levels[:, 1]])

    def frame(pair: np.ndarray, c: int, level: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        padded = np.zeros((len(pair), wide))
        padded[:, : values.shape[1]] = values
        head = pd.DataFrame({"pair": pair, "class": c, "level": level}).astype("int32")
        return pd.concat([head, pd.DataFrame(padded, columns=[f"v{i}" for i in range(wide)])], axis=1)

    found = _summed(rows, shares, ["pair", "class", "level"], wide)
    values = found[[f"v{i}" for i in range(wide)]].to_numpy()
    pair, c, level = (found[x].to_numpy() for x in ("pair", "class", "level"))
    total, by_level = np.zeros((len(pairs), n_classes, width)), np.zeros((int(with_levels.sum()), n_classes, k, level_width))
    low = level < 0
    total[pair[low], c[low]] = values[low, :width]
    by_level[block[pair[~low]], c[~low], level[~low]] = values[~low, :level_width]
    return pairs, total, by_level, block


def _leaders(fits: Fits, live: np.ndarray) -> list[np.ndarray]:
    """Stages of part x fit -> the fit that goes first: one of each design, then one of each design and weight variant, then every fit itself.

    The largest C goes first: the others' distance from it shrinks as 1 / (C x weight of the rows).
    """
    own = np.arange(live.shape[1])
    order = np.argsort(-fits.c, kind="stable").tolist()
    design = [(*map(bool, fits.used[f]), *map(bool, fits.blocks[f])) for f in own]
    stages = []
    for key in (lambda f: design[f], lambda f: (*design[f], int(fits.variant[f])), lambda f: f):
        ahead = np.empty(live.shape, dtype=int)
        for part in range(len(live)):
            first: dict = {}
            ahead[part, order] = [first.setdefault(key(f), f) if live[part, f] else f for f in order]
        if not stages or (ahead != stages[-1]).any():
            stages.append(ahead)
    return stages


def fit_all(rows: DataFrame, fits: Fits, live: np.ndarray, steps: int = 40, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps of all fits at once: min C * sum(w * loss) + |b|^2 / 2 with a free intercept and weights of mean 1 in the part.

    `live`: part x fit, what is to be fitted. Returns coefficients (part x fit x features and intercept) and, for fits with
    ticker blocks, level coefficients (part x such fit x level x (intercept, slope)). Fits of one design lie close together, so one of
    them goes first, over all rows as the others; the sums at its last point give the others their first step. A step that raises the
    objective is halved; a step squares the error, so that one below the root of `tol` by ten is the last; a fit without convergence raises.
    """
    n_parts, n_fits = live.shape
    p1, k = len(fits.features) + 1, fits.n_levels
    own = fits.blocks.any(1)
    block_at = np.cumsum(own) - 1
    upper = np.triu_indices(p1)
    n_h = len(upper[0])
    kinds = _flag_classes(fits.factors)[1]
    beta, gamma = np.zeros((n_parts, n_fits, p1)), np.zeros((n_parts, int(own.sum()), k + 1, 2))
    last, last_gamma, best = beta.copy(), gamma.copy(), np.full((n_parts, n_fits), np.inf)

    def advance(part: int, f: int, v: np.ndarray, per_level: np.ndarray) -> bool:
        """A step from the sums at the fit's coefficients; whether more are needed."""
        pen = fits.used[f].astype(float)
        pen[-1] = 0.0
        j = block_at[f] if own[f] else None
        g_now = gamma[part, j].copy() if j is not None else np.zeros(1)
        objective = fits.c[f] * v[n_h + p1] + (pen * beta[part, f] ** 2).sum() / 2 + (g_now**2).sum() / 2
        if objective > best[part, f] + 1e-9 * (1.0 + abs(best[part, f])):
            beta[part, f] = (beta[part, f] + last[part, f]) / 2
            if j is not None:
                gamma[part, j] = (g_now + last_gamma[part, j]) / 2
            return True
        best[part, f], last[part, f] = objective, beta[part, f]
        hess = np.zeros((p1, p1))
        hess[upper] = v[:n_h]
        hess = fits.c[f] * (hess + np.triu(hess, 1).T) + np.diag(pen)
        grad = fits.c[f] * v[n_h : n_h + p1] + pen * beta[part, f]
        off = ~fits.used[f]
        if j is None:
            step = _solve(hess, grad, off)
        else:
            last_gamma[part, j] = g_now
            step, level_step = _solve_arrow(hess, grad, off, per_level, g_now[:k], fits.blocks[f], fits.c[f], fits.reference[part])
            gamma[part, j, :k] -= level_step
        beta[part, f] = beta[part, f] - step
        moved = max(np.abs(step).max(), np.abs(level_step).max() if j is not None and k else 0.0)
        return 100.0 * moved**2 >= tol

    def as_variant(part: int, f: int, v: np.ndarray, per_level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums by class of flags under the weights of a fit."""
        factor = kinds[fits.variant[f]] / fits.weight_means[part, fits.variant[f]]
        return np.tensordot(factor, v, 1), np.tensordot(factor, per_level, 1)

    stages, ids = _leaders(fits, live), np.arange(n_fits)
    done, points = np.zeros_like(live), {}
    for number, ahead in enumerate(stages):
        split = number + 1 < len(stages)
        active = live & (ahead == ids) & ~done
        done |= active
        for part, f in np.argwhere(active) if number else ():
            # Starts at the last point of the fit that went first in the stage before; where that step is small enough, it is the last.
            points[part, f] = v, per_level, beta[part, f], g = points[part, stages[number - 1][part, f]]
            if own[f]:
                gamma[part, block_at[f]] = g
            active[part, f] = advance(part, f, *as_variant(part, f, v, per_level))
        for _ in range(steps):
            if not active.any():
                break
            pairs, total, by_level, block = _sums(rows, fits, active, beta, gamma, split)
            for i, (part, f) in enumerate(pairs):
                v, per_level = total[i], by_level[block[i]] if block[i] >= 0 else np.zeros((total.shape[1], k, 2 * p1 + 3))
                if split:
                    points[part, f] = v, per_level, beta[part, f].copy(), gamma[part, block_at[f]].copy() if own[f] else None
                    v, per_level = as_variant(part, f, v, per_level)
                else:
                    v, per_level = v[0], per_level[0]
                active[part, f] = advance(part, f, v, per_level)
        if active.any():
            raise ValueError(f"{int(active.sum())} fits have not converged after {steps} passes")
    return beta, gamma


def _solve(hess: np.ndarray, grad: np.ndarray, off: np.ndarray) -> np.ndarray:
    hess, grad = hess.copy(), grad.copy()
    hess[off, :], hess[:, off], grad[off] = 0.0, 0.0, 0.0
    hess[off, off] = 1.0
    return np.linalg.solve(hess, grad)


def _solve_arrow(hess, grad, off, sums, gamma, blocks, c, reference) -> tuple[np.ndarray, np.ndarray]:
    """The step of shared coefficients and 2 x 2 level blocks: levels meet only through the shared part, so they are eliminated first."""
    p1 = len(grad)
    zx = c * np.stack([sums[:, :p1], sums[:, p1 : 2 * p1]], axis=1)
    zz = c * np.stack([sums[:, [p1 - 1, 2 * p1 - 1]], sums[:, [2 * p1 - 1, 2 * p1]]], axis=1) + np.eye(2)
    gz = c * sums[:, 2 * p1 + 1 :] + gamma
    pinned = np.tile(~blocks, (len(sums), 1))
    if reference >= 0:
        pinned[reference, 0] = True
    zz[pinned[:, :, None] | pinned[:, None, :]] = 0.0
    zz[:, [0, 1], [0, 1]] += pinned
    gz[pinned], zx[pinned], zx[:, :, off] = 0.0, 0.0, 0.0
    inner = np.linalg.solve(zz, np.concatenate([zx, gz[:, :, None]], axis=2))
    step = _solve(hess - np.einsum("kzi,kzj->ij", zx, inner[:, :, :p1]), grad - np.einsum("kzi,kz->i", zx, inner[:, :, p1]), off)
    return step, inner[:, :, p1] - inner[:, :, :p1] @ step


def platt_all(rows: DataFrame, fits: Fits, beta: np.ndarray, gamma: np.ndarray, n_folds: int, wanted: np.ndarray, steps: int = 60, tol: float = 1e-8) -> np.ndarray:
    """Slope and intercept (fold x fit x 2) on the held rows' logits of the fit parts, all in shared passes; NaN where not `wanted`.

    Fits go in the stages of `fit_all` and start from the result of the one that went first.
    """
    n_fits = wanted.shape[1]
    ab = np.tile(np.array([1.0, 0.0]), (n_folds, n_fits, 1))
    last, best = ab.copy(), np.full((n_folds, n_fits), np.inf)
    class_of, kinds = _flag_classes(fits.factors)
    factor, own = kinds[fits.variant], fits.blocks.any(1)
    block_at, names = np.cumsum(own) - 1, [f"f{i}" for i in range(len(fits.features))]
    stages, done = _leaders(fits, wanted), np.zeros_like(wanted)
    for number, ahead in enumerate(stages):
        active = wanted & (ahead == np.arange(n_fits)) & ~done
        done |= active
        for f, m in np.argwhere(active) if number else ():
            ab[f, m] = ab[f, stages[number - 1][f, m]]
        for _ in range(steps):
            if not active.any():
                break
            todo, now = active.copy(), ab.copy()

            def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros((n_folds, n_fits, 6))
                for b in _gathered(batches):
                    lv, kind = b["_lv"].to_numpy(), class_of[b["_up"].to_numpy(dtype=int) + 2 * b["_fd"].to_numpy(dtype=int)]
                    order = np.lexsort((lv, kind))
                    held, label, weight = (b[c].to_numpy()[order] for c in ("held_folds", "_y", "_w"))
                    lv, kind, raw = lv[order], kind[order], b[names].to_numpy(dtype=float)[order].reshape(len(b), len(names))
                    for fold in range(n_folds):
                        which, inside = np.flatnonzero(todo[fold]), np.flatnonzero((held >> fold) & 1 == 1)
                        if not len(which) or not len(inside):
                            continue
                        part, levelled = n_folds + fold, own[which]
                        design, slope = _design(raw[inside], fits.center[part])
                        coef, g = beta[part, which].T, gamma[part, block_at[which[levelled]]]
                        in_lv, in_kind, sloped = lv[inside], kind[inside], bool(g[:, :, 1].any())
                        changes = in_kind[1:] != in_kind[:-1]
                        if levelled.any():
                            changes = changes | (in_lv[1:] != in_lv[:-1])
                        for lo, hi in _runs(changes, len(inside), max(64, CELLS // len(which))):
                            at, level = inside[lo:hi], int(in_lv[lo])
                            x = design[lo:hi] @ coef
                            if levelled.any() and level >= 0:
                                x[:, levelled] += g[:, level, 0] + slope[lo:hi, None] * g[:, level, 1] if sloped else g[:, level, 0]
                            eta = x * now[fold, which, 0] + now[fold, which, 1]
                            prob, h, softplus = _curves(eta)
                            w, wy = weight[at], weight[at] * label[at]
                            hx = h * x
                            sums = [w @ (hx * x), w @ hx, w @ h, w @ (prob * x) - wy @ x, w @ prob - wy.sum(), w @ softplus - wy @ eta]
                            total[fold, which] += np.stack(sums, axis=1) * factor[which, in_kind[lo], None]
                at = np.argwhere(todo)
                head = pd.DataFrame({"part": at[:, 0], "fit": at[:, 1]}).astype("int32")
                yield pd.concat([head, pd.DataFrame(total[at[:, 0], at[:, 1]], columns=[f"v{i}" for i in range(6)])], axis=1)

            for r in _summed(rows, shares, ["part", "fit"], 6).itertuples(index=False):
                f, m = r.part, r.fit
                objective = r.v5 + ab[f, m, 0] ** 2 / (2 * PLATT_C)
                if objective > best[f, m] + 1e-9 * (1.0 + abs(best[f, m])):
                    ab[f, m] = (ab[f, m] + last[f, m]) / 2
                    continue
                best[f, m], last[f, m] = objective, ab[f, m]
                hess = np.array([[r.v0 + 1 / PLATT_C, r.v1], [r.v1, r.v2]])
                step = np.linalg.solve(hess, np.array([r.v3 + ab[f, m, 0] / PLATT_C, r.v4]))
                ab[f, m] = ab[f, m] - step
                active[f, m] = 100.0 * (np.abs(step).max() / (1.0 + np.abs(ab[f, m]).max())) ** 2 >= tol
        if active.any():
            raise ValueError(f"{int(active.sum())} calibrations have not converged after {steps} passes")
    ab[~wanted] = np.nan
    return ab


# --- search ---------------------------------------------------------------------------------------


def _prepare(rows: DataFrame, trials: Sequence[dict], features: Sequence[str], n_folds: int, n_levels: int) -> tuple[Fits, np.ndarray, list[int], pd.DataFrame]:
    """Distinct fits behind the trials, their numbers and each part's facts, from three aggregates over the rows."""
    n_parts = 2 * n_folds
    key = lambda t: (
        tuple(f in t["features"] for f in features), t["C"], (t.get("trading_universe_upweight", 1.0), t.get("foundation_weight", 1.0)),
        t.get("ticker_intercepts", "off") == "on", bool(t.get("ticker_interactions", False)),
    )
    ids = {k: i for i, k in enumerate(dict.fromkeys(key(t) for t in trials))}
    factors = tuple(dict.fromkeys(k[2] for k in ids))
    means = rows.agg(*[F.avg(F.when(_part(p), _weight(f))) for p in range(n_parts) for f in factors]).first()
    sides = [(f"p{p}", _part(p)) for p in range(n_parts)] + [(f"{c}{f}", _part(f, f"{c}_folds")) for f in range(n_folds) for c in ("held", "val")]
    counts = rows.agg(*[F.count_if(s).alias(n) for n, s in sides], *[F.count_if(s & (F.col("_y") > 0.5)).alias(f"{n}_pos") for n, s in sides]).first().asDict()
    facts = pd.DataFrame({n: {"n": counts[n], "pos": counts[f"{n}_pos"]} for n, _ in sides}).T
    reference = np.full(n_parts, -1)
    if n_levels:
        firsts = rows.where(F.col("_lv") >= 0).agg(*[F.min(F.when(_part(p), F.col("_lv"))) for p in range(n_parts)]).first()
        reference = np.array([-1 if v is None else v for v in firsts])
    keys = list(ids)
    fits = Fits(
        tuple(features), np.array([[*k[0], True] for k in keys]), np.array([k[1] for k in keys], dtype=float),
        np.array([factors.index(k[2]) for k in keys]), np.array([[k[3], k[4]] for k in keys]), factors,
        _center(rows, len(features), n_parts), np.array([m or 1.0 for m in means]).reshape(n_parts, len(factors)), reference, n_levels,
    )
    platt = np.array([t.get("calibration", "none") == "platt" for t in trials])
    return fits, platt, [ids[key(t)] for t in trials], facts


def search_trials(
    df: DataFrame, trials: DataFrame, folds: Sequence[Fold], week: str, *, y: str, baseline: str, group: str | None = None, w: str | None = None,
    universe: Column | None = None, foundation: Column | None = None, level: Column | None = None, least_level: int = 1, embargo: int = 0,
    objective: str = "logloss", two_sided: bool = False,
) -> DataFrame:
    """(trial_id, fold, score, baseline_score, delta) of every trial of `trial_table` on every fold.

    Trials that share their fit share its steps. With `calibration` platt, slope and intercept come from a fit without the last
    fifth of the train weeks; below 50 held rows or with one class there the fit stays as it is. Folds whose train rows hold
    one class have no row, nor, with `two_sided`, those whose validation rows do.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"the objective must be one of {OBJECTIVES}")
    if len(folds) > 31:
        raise ValueError("a mask of train and fit parts holds up to 31 folds")
    spark = df.sparkSession
    grid = [r.asDict() for r in trials.orderBy("trial_id").collect()]
    features = list(dict.fromkeys(f for t in grid for f in t["features"]))
    blocks = any(t.get("ticker_intercepts", "off") == "on" or t.get("ticker_interactions") for t in grid)
    if blocks and level is None:
        raise ValueError("ticker intercepts and interactions need a level column")
    levels = materialize(ticker_levels(df, level, least_level), "levels") if blocks else None
    n_levels = levels.count() if blocks else 0
    rows = search_rows(
        df, folds, week, y=y, baseline=baseline, features=features, group=group, w=w, universe=universe, foundation=foundation,
        level=level if blocks else None, levels=levels, embargo=embargo,
    )
    n = len(folds)
    fits, platt, fit_of, facts = _prepare(rows, grid, features, n, n_levels)
    both = lambda name: 0 < facts.loc[name, "pos"] < facts.loc[name, "n"]
    usable = np.array([both(f"p{f}") and (both(f"val{f}") or not two_sided) for f in range(n)])
    wanted = np.zeros((n, len(fits.c)), dtype=bool)
    wanted[:, sorted({fit_of[t] for t in np.flatnonzero(platt)})] = True
    wanted &= np.array([u and both(f"p{n + f}") and both(f"held{f}") and facts.loc[f"held{f}", "n"] >= MIN_PLATT_ROWS for f, u in enumerate(usable)])[:, None]
    live = np.vstack([np.repeat(usable[:, None], len(fits.c), axis=1), wanted])
    beta, gamma = fit_all(rows, fits, live)
    ab = platt_all(rows, fits, beta, gamma, n, wanted)
    scores = _score(rows, fits, beta, gamma, ab, usable, platt, np.array(fit_of), n, objective)
    loss = (loss_log if objective == "logloss" else loss_squared)(F.col("_y"), F.col("_b"))
    base = rows.agg(*[F.avg(F.when(_part(f, "val_folds"), loss)) for f in range(n)]).first()
    out = [
        (int(grid[t]["trial_id"]), folds[f].fold, float(scores[f, t]), float(base[f]), float(scores[f, t] - base[f]))
        for f in range(n) if usable[f] for t in range(len(grid))
    ]
    return spark.createDataFrame(out, "trial_id int, fold int, score double, baseline_score double, delta double")


def _score(rows, fits, beta, gamma, ab, usable, platt, fit_of, n, objective) -> np.ndarray:
    """Mean validation loss, fold x trial, from one pass; a task adds up its rows' losses."""
    eta_of, eps, squared = _eta_maker(fits, beta, gamma), EPS, objective == "brier"
    which = np.arange(len(fits.c))

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((n, len(fit_of))), np.zeros(n)
        for b in batches:
            val, label = b["val_folds"].to_numpy(), b["_y"].to_numpy()
            for fold in np.flatnonzero(usable):
                inside = np.flatnonzero((val >> fold) & 1 == 1)
                count[fold] += len(inside)
                for s in range(0, len(inside), 2048):
                    at = inside[s : s + 2048]
                    eta = eta_of(b, fold, at, which)[2][:, fit_of]
                    shaped = platt & ~np.isnan(ab[fold, fit_of, 0])
                    eta[:, shaped] = eta[:, shaped] * ab[fold, fit_of[shaped], 0] + ab[fold, fit_of[shaped], 1]
                    p = np.clip(1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700))), eps, 1.0 - eps)
                    yy = label[at, None]
                    total[fold] += ((p - yy) ** 2 if squared else -(yy * np.log(p) + (1 - yy) * np.log1p(-p))).sum(0)
        at = np.argwhere(np.ones_like(total))
        head = pd.DataFrame({"part": at[:, 0], "trial": at[:, 1]}).astype("int32")
        yield head.assign(v0=total.ravel(), v1=np.repeat(count, len(fit_of)))

    out = np.full((n, len(fit_of)), np.nan)
    for r in _summed(rows, shares, ["part", "trial"], 2).itertuples(index=False):
        out[r.part, r.trial] = r.v0 / r.v1 if r.v1 else np.nan
    return out


def c_search(df: DataFrame, grid: Sequence[float], features: Sequence[str], folds: Sequence[Fold], week: str, **how) -> DataFrame:
    """(C, fold, score): the whole grid on all folds in shared passes; folds lacking a class on either side are left out."""
    from strikelake.models.selection import trial_table

    trials = trial_table(df.sparkSession, [tuple(features)], C=[float(c) for c in grid])
    scores = search_trials(df, trials, folds, week, two_sided=True, **how)
    return scores.join(F.broadcast(trials.select("trial_id", "C")), "trial_id").select("C", "fold", "score")
