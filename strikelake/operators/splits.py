"""Time- and group-safe splits. Week lists are calendar-sized (52 a year) and may visit the driver;
rows never do. Fold membership is a join with a small literal table of week ranges."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass
from datetime import date, timedelta
from itertools import pairwise

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.operators.percentiles import value_at_fraction
from strikelake.operators.relational import drop_shared_groups
from strikelake.operators.ranks import split_at_fraction
from strikelake.operators.skew import with_scalars

MIN_TRAIN_WEEKS = 8


@dataclass(frozen=True)
class Fold:
    fold: int
    train_lo: date
    train_hi: date
    val_lo: date
    val_hi: date


def week_list(df: DataFrame, week: str) -> list[date]:
    """Sorted distinct weeks: one small aggregate, not rows."""
    return [r[0] for r in df.select(week).where(F.col(week).isNotNull()).distinct().orderBy(week).collect()]


def test_start(df: DataFrame, week: str, test_weeks: int) -> DataFrame:
    """One row: first week of the test span, NULL unless there are more weeks than that."""
    weeks = df.agg(F.sort_array(F.collect_set(week)).alias("_w"))
    n = F.size("_w")
    return weeks.select(F.when(n > test_weeks, F.try_element_at("_w", n - test_weeks + 1)).alias("test_start"))


def split_test(df: DataFrame, week: str, test_weeks: int, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(train pool, test): the last `test_weeks` weeks are held out; without a week column the last fifth of the rows in `order`."""
    if week not in df.columns:
        if not order:
            raise ValueError(f"without the column {week!r} the test split needs an order of the rows")
        return split_at_fraction(df, order, 0.8)
    marked = with_scalars(df, test_start(df, week, test_weeks))
    is_test = F.coalesce(F.col(week) >= F.col("test_start"), F.lit(False))
    return marked.where(~is_test).drop("test_start"), marked.where(is_test).drop("test_start")


def half_even(x: float) -> int:
    return round(x)


def split_validation(train: DataFrame, week: str, val_weeks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(fit, validation): the last fifth of the weeks (half-even rounding, at least one), or `val_weeks`."""
    weeks = train.agg(F.sort_array(F.collect_set(week)).alias("_w"))
    n = F.size("_w")
    want = F.lit(int(val_weeks)) if val_weeks else F.greatest(F.lit(1), F.bround(n * 0.2, 0).cast("int"))
    take = F.least(want, n - 1)
    start = weeks.select(F.when(n >= 2, F.try_element_at("_w", n - take + 1)).alias("_vs"))
    marked = with_scalars(train, start)
    held = F.coalesce(F.col(week) >= F.col("_vs"), F.lit(False))
    return marked.where(~held).drop("_vs"), marked.where(held).drop("_vs")


def split_row_tail(df: DataFrame, order: list[str], fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(head, tail) by sorted position: at least one head row, and at least one tail row when there are two."""
    return split_at_fraction(df, order, fraction, least_tail=1)


def resolve_validation(
    train: DataFrame, week: str, order: list[str], val_weeks: int | None = None
) -> tuple[DataFrame, DataFrame, str]:
    """Week-grouped split when there are at least two weeks, else the row tail; the mode comes along."""
    if week in train.columns and train.select(week).dropna().distinct().limit(2).count() == 2:
        return (*split_validation(train, week, val_weeks), "week_group")
    return (*split_row_tail(train, order), "row_tail")


def fraction_boundary(df: DataFrame, order: str, fraction: float) -> DataFrame:
    """One row: the time at position floor(n * fraction), found by rank selection, not by a global sort."""
    micros = df.select(F.unix_micros(order).alias("_us"))  # exact as a double until the year 2255
    return value_at_fraction(micros, "_us", fraction).select(F.timestamp_micros(F.col("value").cast("bigint")).alias("boundary"))


def embargo_days(train: DataFrame, boundary: DataFrame, days: int, date_col: str) -> DataFrame:
    """Train rows strictly earlier than the first boundary date minus `days`; undated rows are dropped."""
    if days <= 0:
        return train
    cut = boundary.agg(F.date_sub(F.min(date_col), days).alias("_cut"))
    # No boundary date means no embargo.
    keep = F.col("_cut").isNull() | F.coalesce(F.col(date_col) < F.col("_cut"), F.lit(False))
    return with_scalars(train, cut).where(keep).drop("_cut")


def embargo_weeks(train: DataFrame, boundary: DataFrame, days: int, week: str) -> DataFrame:
    """The same in whole weeks: ceil(days / 7)."""
    return embargo_days(train, boundary, 7 * math.ceil(days / 7) if days > 0 else 0, week)


def gap_days(train: DataFrame, boundary: DataFrame, date_col: str) -> DataFrame:
    a = train.agg(F.max(date_col).alias("_a"))
    b = boundary.agg(F.min(date_col).alias("_b"))
    return with_scalars(a, b).select(F.date_diff("_b", "_a").alias("gap_days"))


def time_split(
    df: DataFrame, week: str, date_col: str, group: str | None, test_weeks: int, val_weeks: int | None = None, embargo: int = 0
) -> DataFrame:
    """`split` = fit / val / test with group-disjoint sides and an embargo before the test span."""
    pool, test = split_test(df, week, test_weeks)
    if group:
        pool = drop_shared_groups(pool, test, group)
    pool = embargo_days(pool, test, embargo, date_col)
    fit, val = split_validation(pool, week, val_weeks)
    if group:
        fit = drop_shared_groups(fit, val, group)
    tag = lambda part, name: part.withColumn("split", F.lit(name))
    return tag(fit, "fit").unionByName(tag(val, "val")).unionByName(tag(test, "test"))


def walk_forward(
    weeks: list[date], folds: int, val_weeks: int, train_weeks: int, expanding: bool = True, gap_weeks: int = 0
) -> list[Fold]:
    """Folds of neighbouring validation spans that end at the latest week, oldest first.

    Span borders are `val_weeks` apart; a border that leaves less than the least history before it moves up to
    where it just does, and a span left without any week is an error.
    """
    if len(weeks) < 3:
        raise ValueError("walk-forward needs at least three weeks")
    history = gap_weeks + MIN_TRAIN_WEEKS
    borders = [max(len(weeks) - k * val_weeks, history) for k in range(folds, -1, -1)]
    spans = list(pairwise(borders))
    if any(lo >= hi for lo, hi in spans) or (spans and not expanding and train_weeks < MIN_TRAIN_WEEKS):
        raise ValueError("not enough history for the requested folds")
    depth = len(weeks) if expanding else train_weeks
    return [
        Fold(i, weeks[max(0, lo - gap_weeks - depth)], weeks[lo - gap_weeks - 1], weeks[lo], weeks[hi - 1])
        for i, (lo, hi) in enumerate(spans, start=1)
    ]


def outer_folds(weeks: list[date], base_test_weeks: int, folds: int, test_weeks: int, gap_weeks: int) -> list[Fold]:
    """Folds stepping back from the pre-test pool; training is everything before the gap."""
    pool = weeks[:-base_test_weeks] if 0 < base_test_weeks < len(weeks) else weeks
    period = test_weeks + gap_weeks
    # As many periods as fit behind one training week.
    fitting = max(0, (len(pool) - 1) // period)
    spans = [(len(pool) - k * period - test_weeks, k) for k in range(min(folds, fitting))]
    return [Fold(k + 1, pool[0], pool[at - gap_weeks - 1], pool[at], pool[at + test_weeks - 1]) for at, k in spans]


def calendar_walk(start: date, end: date, train_days: int, test_days: int, step_days: int, max_splits: int = 0) -> list[Fold]:
    """Fixed-length calendar windows; `*_hi` is the last day inside."""
    fitting = max(0, ((end - start).days - train_days - test_days) // step_days + 1)
    day = lambda k, offset: start + timedelta(days=k * step_days + offset)
    return [
        Fold(k + 1, day(k, 0), day(k, train_days - 1), day(k, train_days), day(k, train_days + test_days - 1))
        for k in range(min(fitting, max_splits or fitting))
    ]


def _mask(folds: list[Fold], column: str, lo: str, hi: str) -> Column:
    bits = [F.when(F.col(column).between(F.lit(getattr(f, lo)), F.lit(getattr(f, hi))), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(folds)]
    return functools.reduce(lambda x, y: x.bitwiseOR(y), bits, F.lit(0)).cast("long")


def fold_masks(
    df: DataFrame, folds: list[Fold], column: str, group: str | None = None, embargo: int = 0, date_col: str | None = None
) -> DataFrame:
    """Every row once, with bitmasks over the folds (bit i for folds[i]): `val_folds`, `train_folds`, `purged_folds`, `embargoed_folds`.

    A train row is purged where its group validates, then embargoed where its day is within `embargo` days of the first
    validation day or later; a row without a day is embargoed too. A group's mask is one aggregate joined back.
    """
    if len(folds) > 62:
        raise ValueError("a bitmask holds up to 62 folds")
    masked = df.withColumns({"val_folds": _mask(folds, column, "val_lo", "val_hi"), "_train": _mask(folds, column, "train_lo", "train_hi")})
    none = F.lit(0).cast("long")
    purged = none
    if group:
        shared = masked.where(F.col(group).isNotNull() & (F.col("val_folds") > 0)).groupBy(group).agg(F.bit_or("val_folds").alias("_shared"))
        masked = masked.join(shared, group, "left")
        purged = F.col("_train").bitwiseAND(F.coalesce("_shared", none))
    masked = masked.withColumn("purged_folds", purged)
    rest = F.col("_train").bitwiseAND(F.bitwise_not("purged_folds"))
    embargoed = none
    if embargo > 0 and folds:
        day = date_col or column
        first = [F.min(F.when(F.col("val_folds").bitwiseAND(F.lit(1 << i)) > 0, F.col(day))).alias(f"_first{i}") for i in range(len(folds))]
        masked = with_scalars(masked, df.withColumn("val_folds", _mask(folds, column, "val_lo", "val_hi")).agg(*first))
        late = [F.when(F.col(f"_first{i}").isNotNull() & ~F.coalesce(F.col(day) < F.date_sub(f"_first{i}", embargo), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(len(folds))]
        embargoed = rest.bitwiseAND(functools.reduce(lambda x, y: x.bitwiseOR(y), late).cast("long"))
    masked = masked.withColumn("embargoed_folds", embargoed).withColumn("train_folds", rest.bitwiseAND(F.bitwise_not("embargoed_folds")))
    return masked.select(*df.columns, "val_folds", "train_folds", "purged_folds", "embargoed_folds")


def fold_facts(masked: DataFrame, folds: list[Fold], date_col: str) -> DataFrame:
    """One row per fold from one aggregate: rows that train and validate, rows purged and embargoed, last train and first
    validation day and the days between them."""
    has = lambda c, i: F.col(f"{c}_folds").bitwiseAND(F.lit(1 << i)) > 0
    counts = [F.count_if(has(c, i)).alias(f"{c}{i}") for i in range(len(folds)) for c in ("train", "val", "purged", "embargoed")]
    days = [f(F.when(has(c, i), F.col(date_col))).alias(f"{n}{i}") for i in range(len(folds)) for c, f, n in (("train", F.max, "last"), ("val", F.min, "first"))]
    one = masked.agg(*counts, *days)
    row = lambda i, f: F.struct(
        F.lit(f.fold).alias("fold"), F.col(f"train{i}").alias("n_train"), F.col(f"val{i}").alias("n_val"), F.col(f"purged{i}").alias("n_purged"),
        F.col(f"embargoed{i}").alias("n_embargoed"), F.col(f"last{i}").alias("last_train"), F.col(f"first{i}").alias("first_val"),
        F.date_diff(f"first{i}", f"last{i}").alias("gap_days"),
    )
    return one.select(F.inline(F.array(*[row(i, f) for i, f in enumerate(folds)])))


def require_whole_folds(facts: DataFrame) -> None:
    """Raises if purge and embargo have left a fold without train or validation rows; the facts are a row per fold."""
    if empty := [r["fold"] for r in facts.where("n_train = 0 or n_val = 0").select("fold").collect()]:
        raise ValueError(f"folds {sorted(empty)} are empty after purge and embargo; fewer folds or a shorter embargo are needed")


def assign_folds(
    df: DataFrame, folds: list[Fold], column: str, group: str | None = None, embargo: int = 0, date_col: str | None = None
) -> DataFrame:
    """One copy of a row per fold it belongs to, with `fold` and `role` (train / val).

    Group purge and day embargo are decided on masks, before any row is copied.
    """
    masked = fold_masks(df, folds, column, group, embargo, date_col)
    spec = F.array(*[F.struct(F.lit(f.fold).alias("fold"), F.lit(role).alias("role"), F.lit(1 << i).cast("long").alias("bit")) for i, f in enumerate(folds) for role in ("train", "val")])
    hits = F.filter(spec, lambda s: F.when(s["role"] == "val", F.col("val_folds")).otherwise(F.col("train_folds")).bitwiseAND(s["bit"]) > 0)
    return masked.withColumn("_f", F.explode(hits)).select(*df.columns, "_f.fold", "_f.role")


def preview_labels(df: DataFrame, week: str, test_weeks: int, val_weeks: int, walk: bool = True) -> DataFrame:
    """Preview labelling: everything is train below three weeks; no embargo, no purge."""
    weeks = df.agg(F.sort_array(F.collect_set(week)).alias("_w"))
    n = F.size("_w")
    tests = F.least(F.lit(int(test_weeks)), n)
    rest = n - tests
    vals = F.least(F.lit(int(val_weeks)), rest)
    few = n < 3
    edges = weeks.select(
        F.when(~few, F.try_element_at("_w", n - tests + 1)).alias("_ts"),
        F.when(~few & (rest > 0) & F.lit(walk), F.try_element_at("_w", F.greatest(rest - vals + 1, F.lit(1)))).alias("_vs"),
    )
    marked = with_scalars(df, edges)
    label = F.when(F.col(week) >= F.col("_ts"), "test").when(F.col(week) >= F.col("_vs"), "val").otherwise("train")
    return marked.withColumn("split", label).drop("_ts", "_vs")


# --- leak rules -----------------------------------------------------------------------------------


def times_before(decision: Column, times: list[Column], allow_missing: bool) -> Column:
    """Every feature time is strictly before the decision; missing times fail unless allowed."""
    ok = F.lit(True)
    for t in times:
        ok = ok & F.coalesce(t < decision, t.isNull() & F.lit(allow_missing))
    return ok


def label_after_decision(decision: Column, resolution: Column) -> Column:
    return F.coalesce(decision < resolution, F.lit(False))


def assert_no_leaks(df: DataFrame, decision: str, times: list[str], allow_missing: bool = False) -> DataFrame:
    """Fails the job on the first leaking row, inside the tasks; no separate counting pass."""
    ok = times_before(F.col(decision), [F.col(t) for t in times], allow_missing)
    guard = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("feature time is not before decision time")))
    return df.withColumn("leak_check_passed", guard)


def quarantine(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    good = F.coalesce(ok, F.lit(False))
    return df.where(good), df.where(~good)
