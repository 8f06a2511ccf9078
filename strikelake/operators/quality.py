"""Dataset summaries, profiles, coverage, contract checks and metric roll-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelake.functions.calendar import next_friday
from strikelake.operators.skew import with_scalars


def composition(rows: DataFrame, split: str, target: str, week: str, distinct: Mapping[str, str]) -> DataFrame:
    """Rows, classes, week range and distinct key counts per split.

    Distinct keys are counted in tall form, combined before the shuffle, so several distinct counts
    do not multiply the rows of a split in one task.
    """
    y = F.col(target).try_cast("double")
    base = rows.groupBy(split).agg(
        F.count("*").alias("n_rows"), F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"),
        F.count_distinct(y).alias("class_count"), F.min(week).alias("week_start"), F.max(week).alias("week_end"),
    )
    counts = distinct_counts(rows, [split], distinct)
    return base.join(counts, split)


def distinct_counts(rows: DataFrame, by: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """One column per entry of names (output -> input column) with its distinct non-null count."""
    pairs = F.array(*[F.struct(F.lit(out).alias("_k"), F.col(src).cast("string").alias("_v")) for out, src in names.items()])
    tall = rows.select(*by, F.inline(pairs)).where(F.col("_v").isNotNull()).groupBy(*by, "_k", "_v").agg(F.lit(1).alias("_1"))
    per = tall.groupBy(*by, "_k").agg(F.count("*").alias("_n"))
    return per.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("_k") == out, F.col("_n"))), F.lit(0)).alias(out) for out in names])


def dataset_summary(df: DataFrame, date_col: str, ticker: str = "ticker", sample: int = 8) -> DataFrame:
    name = F.upper(F.trim(F.col(ticker).cast("string")))
    base = df.agg(
        F.count("*").alias("rows"), F.min(date_col).alias("date_start"), F.max(date_col).alias("date_end"),
    )
    weeks = df.select(next_friday(F.col(date_col)).alias("_w")).where(F.col("_w").isNotNull()).distinct().agg(F.count("*").alias("week_count"))
    names = df.select(name.alias("_t")).where(F.col("_t") != "").distinct()
    count = names.agg(F.count("*").alias("ticker_count"))
    head = names.orderBy("_t").limit(sample).agg(F.array_join(F.sort_array(F.collect_list("_t")), ",").alias("ticker_sample"))
    return with_scalars(with_scalars(with_scalars(base, weeks), count), head)


def available(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    return [c for c in candidates if c in df.columns]


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, dtype, missing_pct, n_unique) for each column; sketches instead of exact counts on request."""
    cols = list(columns or df.columns)
    types = dict(df.dtypes)
    if approximate:
        wide = df.agg(
            F.count("*").alias("_n"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(cols)],
            *[F.approx_count_distinct(c).alias(f"_u{i}") for i, c in enumerate(cols)],
        )
        parts = [
            F.struct(
                F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"),
                (F.lit(100.0) * (F.col("_n") - F.col(f"_c{i}")) / F.col("_n")).alias("missing_pct"), F.col(f"_u{i}").alias("n_unique"),
            )
            for i, c in enumerate(cols)
        ]
        return wide.select(F.inline(F.array(*parts)))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("_v")) for c in cols])
    values = df.select(F.inline(pairs)).groupBy("column", "_v").agg(F.count("*").alias("_n"))
    dtype = F.element_at(F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))]), F.col("column"))
    missing = F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0))
    return values.groupBy("column").agg(
        (F.lit(100.0) * missing / F.sum("_n")).alias("missing_pct"), F.count("_v").alias("n_unique")
    ).select("column", dtype.alias("dtype"), "missing_pct", "n_unique")


def null_fractions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, null_frac), one pass; absent columns count as wholly missing."""
    have = [c for c in columns if c in df.columns]
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"_{i}") for i, c in enumerate(have)])
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("null_frac")) for i, c in enumerate(have)]
    parts += [F.struct(F.lit(c).alias("column"), F.lit(1.0).alias("null_frac")) for c in columns if c not in have]
    return wide.select(F.inline(F.array(*parts)))


def schema_verdict(df: DataFrame, required: Sequence[str], error_at: float = 0.9, warn_at: float = 0.5) -> DataFrame:
    """Columns that are nearly or mostly missing, with a severity."""
    level = F.when(F.col("null_frac") > error_at, "error").when(F.col("null_frac") > warn_at, "warning").otherwise("ok")
    return null_fractions(df, required).withColumn("severity", level)


def most_missing(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    gaps = null_fractions(df, columns).where(F.col("null_frac") > 0)
    return gaps.orderBy(F.col("null_frac").desc(), "column").limit(n)


def tdays_regime(df: DataFrame, days: str = "T_days", by: Sequence[str] = (), daily: float = 0.85, weekly: float = 0.95) -> DataFrame:
    """daily: enough rows with one day left; weekly: enough within 1..4 days and at least two of them seen."""
    t = F.bround(F.col(days), 0).cast("int")
    known = df.where(F.col(days).isNotNull()).select(*by, t.alias("_t"))
    in_week = F.when(F.col("_t").between(1, 4), F.col("_t"))
    g = known.groupBy(*by).agg(
        F.avg((F.col("_t") == 1).cast("double")).alias("_d"), F.avg(F.col("_t").between(1, 4).cast("double")).alias("_w"),
        F.count_distinct(in_week).alias("_u"),
    )
    return g.select(*by, (F.col("_d") >= daily).alias("is_daily"), ((F.col("_w") >= weekly) & (F.col("_u") >= 2)).alias("is_weekly"))


def regime_preview(df: DataFrame, keep: Column, days: str = "T_days", ticker: str = "ticker") -> DataFrame:
    """(t_days, rows) after the filter, with the totals before and after on every line."""
    flag = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    totals = flag.agg(F.count("*").alias("rows_before"), F.count_if("_keep").alias("rows_after"))
    tickers = flag.where("_keep").select(ticker).distinct().agg(F.count(ticker).alias("tickers_after"))
    per = flag.where("_keep").groupBy(F.col(days).alias("t_days")).agg(F.count("*").alias("rows"))
    return with_scalars(with_scalars(per, totals), tickers)


def date_gaps(df: DataFrame, start: Column, end: Column, by: Sequence[str] = ("ticker",), day: str = "date") -> DataFrame:
    """Runs of missing days per key inside [start, end]: left, right and inner holes."""
    have = df.where(F.col(day).between(start, end)).select(*by, F.col(day).alias("_d")).distinct()
    keys = df.select(*by).distinct()
    need = keys.withColumn("_d", F.explode(F.sequence(start, end, F.expr("INTERVAL 1 DAY"))))
    missing = need.join(have, [*by, "_d"], "left_anti")
    # Days are calendar-bounded per key; consecutive days share day number minus rank.
    order = Window.partitionBy(*by).orderBy("_d")
    runs = missing.withColumn("_g", F.unix_date("_d") - F.row_number().over(order))
    return runs.groupBy(*by, "_g").agg(F.min("_d").alias("gap_start"), F.max("_d").alias("gap_end"), F.count("*").alias("days")).drop("_g")


def fold_statistics(deltas: DataFrame, by: Sequence[str] = ("trial_id",), delta: str = "delta_logloss") -> DataFrame:
    """Fold count, mean, sample deviation (0 for one fold), standard error, improved folds and worst."""
    v = F.col(delta)
    sd = F.coalesce(F.when(F.count(v) > 1, F.stddev_samp(v)), F.lit(0.0))
    return deltas.where(v.isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n_folds"), F.avg(v).alias("mean_delta"), F.percentile(delta, F.lit(0.5)).alias("median_delta"),
        sd.alias("std_delta"), (sd / F.sqrt(F.count(v))).alias("se_delta"), F.count_if(v < 0).alias("folds_improved"), F.max(v).alias("worst_delta"),
    )


def best_by_metric(rows: DataFrame, by: Sequence[str], metric: str, keep: Sequence[str]) -> DataFrame:
    order = F.struct(metric, *keep)
    return rows.where(F.col(metric).isNotNull()).groupBy(*by).agg(
        F.min(metric).alias(metric), *[F.min_by(c, order).alias(c) for c in keep if c not in by]
    )


def metric_parity(left: DataFrame, right: DataFrame, keys: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """(metric, mismatches) between two metric tables; a missing row counts as a mismatch of every metric."""
    if sorted(left.columns) != sorted(right.columns):
        raise ValueError("metric tables have different columns")
    values = [c for c in left.columns if c not in keys]
    types = dict(left.dtypes)
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[F.col(v).alias(f"_r_{v}") for v in values])
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = eq if cond is None else cond & eq
    both = left.withColumn("_l", F.lit(1)).join(r.withColumn("_q", F.lit(1)), cond, "full")
    one_sided = F.col("_l").isNull() | F.col("_q").isNull()
    def differs(v: str) -> Column:
        a, b = F.col(v), F.col(f"_r_{v}")
        if types[v] in ("string", "date", "boolean"):
            unequal = ~a.eqNullSafe(b)
        else:
            unequal = a.isNull() != b.isNull()
            unequal = unequal | F.coalesce(F.abs(a - b) > tol, F.lit(False))
        return one_sided | unequal

    wide = both.agg(*[F.count_if(differs(v)).alias(v) for v in values])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).alias("mismatches")) for v in values])))


def rule_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, bad_rows): how many rows break each rule, in one pass."""
    wide = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"_{i}") for i, bad in enumerate(rules.values())])
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("bad_rows")) for i, n in enumerate(rules)]))
    )


def snapshot_rules(columns: Sequence[str]) -> dict[str, Column]:
    rules: dict[str, Column] = {}
    have = set(columns)
    if {"spot_source", "spot_asof_utc", "snapshot_time_utc"} <= have:
        priced = F.coalesce(F.col("spot_source"), F.lit("none")) != "none"
        same = F.coalesce(F.col("spot_asof_utc") == F.col("snapshot_time_utc"), F.lit(False))
        rules["spot_time_is_snapshot_time"] = priced & ~same
    if "T_days" in have:
        rules["horizon_not_negative"] = F.col("T_days") < 0
    if "expiry_ts_utc" in have:
        rules["expiry_present"] = F.col("expiry_ts_utc").isNull()
    if "pRN" in have:
        rules["prn_present"] = F.col("pRN").isNull()
    return rules


def require_clean(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Fails the job on the first row that breaks a rule; rows pass through otherwise."""
    bad = F.lit(None).cast("string")
    for name, broken in rules.items():
        bad = F.coalesce(bad, F.when(F.coalesce(broken, F.lit(False)), F.lit(name)))
    checked = F.when(bad.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("row breaks rule "), bad)))
    return df.withColumn("_ok", checked).where("_ok").drop("_ok")


def drop_log(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts per drop reason)."""
    marked = rows.withColumn("drop_reason", reason)
    counts = marked.where(F.col("drop_reason").isNotNull()).groupBy("drop_reason").agg(F.count("*").alias("dropped"))
    return marked.where(F.col("drop_reason").isNull()).drop("drop_reason"), counts


def stage_rows(stages: Mapping[str, DataFrame]) -> DataFrame:
    """(stage, rows) of the tables of a run."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("stage"), "rows") for name, df in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
