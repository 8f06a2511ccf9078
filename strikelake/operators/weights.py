"""Sample weights: per-snapshot equalisation, ticker balance, policy multipliers, mean-one scaling.

Group and ticker totals are aggregates joined back to the rows. A hot group then only makes the
streamed side of that join skewed, which AQE splits; no window ever gathers a group in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType

from strikelake.functions import calendar, keys
from strikelake.functions.scalar import clip
from strikelake.operators.relational import first_columns
from strikelake.operators.skew import with_group_totals, with_scalars
from strikelake.session import materialize

VERSION = "v3"  # fixed value
SNAPSHOT_DATES = ("snapshot_date", "asof_date", "asof_target", "asof_ts")
EXPIRY_DATES = (
    "expiry_date", "option_expiration_used", "option_expiration_requested", "expiry_close_date_used", "week_friday",
)
STRIKES = ("K", "threshold", "strike")
WEEKS = ("week_id", "week_friday")


def upper_ticker(column: str = "ticker") -> Column:
    return F.upper(F.coalesce(F.col(column).cast("string"), F.lit("UNKNOWN")))


def parse_tickers(raw: str | Iterable[str] | None) -> list[str]:
    items = raw.split(",") if isinstance(raw, str) else list(raw or [])
    return sorted({t.strip().upper() for t in items if t.strip()})


def with_weight_keys(df: DataFrame, probe: bool = True) -> DataFrame:
    """snapshot_date, expiry_date, snapshot_dow, week_id and the group key, from whichever columns exist.

    `probe` looks for the first candidate that holds values; without it the first present one is used.
    """
    snap, expiry, strike, week = first_columns(df, (SNAPSHOT_DATES, EXPIRY_DATES, STRIKES, WEEKS), with_values=probe)
    if not (snap and expiry and strike):
        raise ValueError("weights need a snapshot date, an expiry date and a strike")
    ymd = lambda c: F.col(c) if df.schema[c].dataType == DateType() else F.to_date(F.col(c).try_cast("timestamp"))
    raw_dow = F.col("snapshot_dow").cast("string") if "snapshot_dow" in df.columns else F.lit(None).cast("string")
    out = df.withColumns(
        {
            "snapshot_date": ymd(snap),
            "expiry_date": ymd(expiry),
            "week_id": ymd(week) if week else calendar.next_friday(ymd(expiry)),
            "_k": F.col(strike).try_cast("double"),
            "_dow": raw_dow,
        }
    )
    out = out.withColumn("snapshot_dow", calendar.weekday_label(F.col("_dow"), F.col("snapshot_date"))).drop("_dow")
    snap = keys.cluster_snapshot(F.col("ticker"), F.col("expiry_date"), F.col("snapshot_date"), F.col("snapshot_dow"))
    return out.withColumn("weight_group_key", snap)


def with_cluster_keys(keyed: DataFrame) -> DataFrame:
    """The cluster texts derived from the weight keys; added after the group join, so they are not shuffled."""
    return keyed.withColumns(
        {
            "cluster_week": keys.cluster_week(F.col("ticker"), F.col("expiry_date")),
            "cluster_snapshot": F.col("weight_group_key"),
            "cluster_strike": keys.cluster_strike(F.col("ticker"), F.col("expiry_date"), F.round("_k", 7)),
            "group_id": F.col("weight_group_key"),
        }
    ).drop("_k")


def weighting_v3(
    df: DataFrame,
    *,
    mode: str = "none",
    alpha_min: float = 0.5,
    alpha_max: float = 2.0,
    beta: float = 1.0,
    focus: str | Iterable[str] | None = None,
    strict: bool = True,
    probe: bool = True,
    scope: tuple[str, ...] = (),
) -> DataFrame:
    """One over group size, times a ticker factor, times a focus factor, divided by its mean.

    `scope` names columns (a file, a dataset) inside which everything is computed separately.
    """
    keyed, groups = weight_groups(df, mode=mode, alpha_min=alpha_min, alpha_max=alpha_max, beta=beta, focus=focus, strict=strict, probe=probe, scope=scope)
    return weighted_rows(keyed, groups, scope)


def weighted_rows(keyed: DataFrame, groups: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """The rows of `weight_groups` with the weights of their groups."""
    return with_cluster_keys(keyed.join(groups, [*scope, "weight_group_key"])).withColumn("weighting_version", F.lit(VERSION))


def weight_groups(
    df: DataFrame, *, mode: str = "none", alpha_min: float = 0.5, alpha_max: float = 2.0, beta: float = 1.0, focus: str | Iterable[str] | None = None,
    strict: bool = True, probe: bool = True, scope: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(rows with their keys, one row per group with its size and weights); the arguments are those of `weighting_v3`."""
    if mode not in ("none", "sqrt_inv"):
        raise ValueError(f"unknown ticker mode {mode!r}")
    if not beta > 0:
        raise ValueError("focus factor must be positive")
    keyed = with_weight_keys(df, probe)
    critical = F.col("snapshot_date").isNull() | F.col("expiry_date").isNull() | F.col("snapshot_dow").isNull() | F.col("_k").isNull()
    if strict:
        checked = F.when(critical, F.raise_error(F.lit("weighting keys missing"))).otherwise(F.col("weight_group_key"))
        # Never NULL, which spares the join a filter that would build the key a second time.
        keyed = keyed.withColumn("weight_group_key", F.coalesce(checked, F.lit("")))
    else:
        keyed = keyed.where(~critical)
    sc = list(scope)
    # All weights depend on the group only, so they are worked out on the table of groups, and their means on that of the
    # tickers. Groups are written once: otherwise every mean, each with its own columns, would count all rows anew. Tickers
    # are written too, so that their size is known and few of them are broadcast to the groups.
    groups = keyed.groupBy(*sc, upper_ticker().alias("_t"), "weight_group_key").agg(F.count("*").cast("double").alias("weight_group_size"))
    groups = materialize(groups, "weight-groups")
    tickers = groups.groupBy(*sc, "_t").agg(
        F.count("*").cast("double").alias("weight_ticker_group_count"), F.sum("weight_group_size").alias("_rows")
    )
    attach = lambda one: tickers.join(F.broadcast(one), sc) if sc else with_scalars(tickers, one)
    if mode == "sqrt_inv":
        tickers = attach(tickers.groupBy(*sc).agg(F.avg("weight_ticker_group_count").alias("_mean")))
        raw = F.sqrt(F.col("_mean") / F.greatest(F.col("weight_ticker_group_count"), F.lit(1.0)))
        tickers = tickers.withColumn("weight_ticker_w_raw", clip(raw, alpha_min, alpha_max)).drop("_mean")
    else:
        tickers = tickers.withColumn("weight_ticker_w_raw", F.lit(1.0))
    chosen = parse_tickers(focus)
    focused = F.when(F.col("_t").isin(chosen), F.lit(float(beta))).otherwise(F.lit(1.0)) if chosen else F.lit(1.0)
    tickers = tickers.withColumn("weight_trade_focus_mult", focused)
    total = F.sum(F.col("weight_ticker_group_count") * F.col("weight_ticker_w_raw") * F.col("weight_trade_focus_mult"))
    tickers = attach(tickers.groupBy(*sc).agg((total / F.sum("_rows")).alias("_m"))).drop("_rows")
    tickers = materialize(tickers, "weight-tickers")
    groups = groups.join(tickers, [*sc, "_t"]).withColumn("weight_group_w", F.lit(1.0) / F.col("weight_group_size"))
    groups = groups.withColumn(
        "weight_raw", F.col("weight_group_w") * F.col("weight_ticker_w_raw") * F.col("weight_trade_focus_mult")
    )
    groups = groups.withColumn("weight_final", F.col("weight_raw") / F.col("_m")).drop("_m", "_t")
    return keyed, groups


def base_weight(df: DataFrame, column: str | None) -> DataFrame:
    """Column `w`: the named weight, the legacy column for the default name, or uniform; bad values are 1."""
    name = column
    if column == "weight_final" and column not in df.columns and "sample_weight_final" in df.columns:
        name = "sample_weight_final"
    if not name or name.lower() in ("uniform", "none") or name not in df.columns:
        return df.withColumn("w", F.lit(1.0))
    value = F.col(name).try_cast("double")
    return df.withColumn("w", F.when((value > 0) & (value < float("inf")), value).otherwise(F.lit(1.0)))


def equalize_groups(df: DataFrame, group: str, w: str = "w") -> DataFrame:
    """Every group's weights sum to 1; groups without a positive sum stay as they are."""
    named = df.withColumn("_g", F.coalesce(F.col(group).cast("string"), F.lit("NA")))
    total = with_group_totals(named, ["_g"], _sum=F.sum(w))
    return total.withColumn(w, F.when(F.col("_sum") > 0, F.col(w) / F.col("_sum")).otherwise(F.col(w))).drop("_g", "_sum")


def mean_one(df: DataFrame, w: str = "w", where: Column | None = None, name: str | None = None) -> DataFrame:
    """Scale valid weights of the subset to mean 1; other rows get NULL in `name`."""
    name = name or w
    inside = F.lit(True) if where is None else where
    valid = inside & (F.col(w) > 0)
    mean = df.agg(F.avg(F.when(valid, F.col(w))).alias("_mean"))
    out = with_scalars(df, mean)
    scaled = F.when(valid & (F.col("_mean") > 1e-12), F.col(w) / F.col("_mean")).otherwise(F.col(w))
    return out.withColumn(name, F.when(inside, scaled)).drop("_mean")


def multiply_tickers(df: DataFrame, tickers: str | Iterable[str] | None, factor: float, w: str = "w") -> DataFrame:
    chosen = parse_tickers(tickers)
    if not chosen or not factor > 0 or abs(factor - 1.0) <= 1e-12:
        return df
    return df.withColumn(w, F.when(upper_ticker().isin(chosen), F.col(w) * factor).otherwise(F.col(w)))


def balance_tickers(df: DataFrame, w: str = "w", lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """Times sqrt(mean rows per ticker / rows of the ticker), clipped."""
    counts = df.groupBy(upper_ticker().alias("_t")).agg(F.count("*").alias("_n"))
    counts = with_scalars(counts, counts.agg(F.avg("_n").alias("_mean")))
    factor = clip(F.sqrt(F.col("_mean") / F.col("_n")), lo, hi)
    counts = counts.select(F.col("_t").alias("_tk"), factor.alias("_f"))
    out = df.withColumn("_t", upper_ticker()).join(counts, F.col("_t") == F.col("_tk"))
    return out.withColumn(w, F.col(w) * F.col("_f")).drop("_t", "_tk", "_f")


def training_weights(
    df: DataFrame,
    group: str | None,
    *,
    foundation: str | Iterable[str] | None = None,
    foundation_weight: float = 1.0,
    universe: str | Iterable[str] | None = None,
    universe_weight: float = 1.0,
    balance: bool = False,
    fit: Column | None = None,
    val: Column | None = None,
) -> DataFrame:
    """Training order: equalise, foundation, trading universe, ticker balance, then mean 1 per subset."""
    out = equalize_groups(df, group) if group else df
    out = multiply_tickers(out, foundation, foundation_weight)
    out = multiply_tickers(out, universe, universe_weight)
    if balance:
        out = balance_tickers(out)
    out = mean_one(out, name="w_train")
    if fit is not None:
        out = mean_one(out, where=fit, name="w_fit")
    if val is not None:
        out = mean_one(out, where=val, name="w_val")
    return out


def preview_weights(
    df: DataFrame,
    group: str | None,
    *,
    universe: str | Iterable[str] | None = None,
    universe_weight: float = 1.0,
    balance: bool = False,
) -> DataFrame:
    """Preview order: trading universe, ticker balance, equalise, mean 1 (not the training order)."""
    out = multiply_tickers(df, universe, universe_weight)
    if balance:
        out = balance_tickers(out)
    if group:
        out = equalize_groups(out, group)
    return mean_one(out)


def reweight_masked(df: DataFrame, group: str, mask: Column, w: str = "w") -> DataFrame:
    """Inside the mask every group gets the same total and the mask keeps its mean; outside nothing changes."""
    inside = df.withColumn("_in", F.coalesce(mask, F.lit(False)))
    total = with_group_totals(inside, ["_in", group], _sum=F.sum(w))
    shared = F.when(F.col("_in") & (F.col("_sum") > 0), F.col(w) / F.col("_sum")).otherwise(F.col(w))
    out = total.withColumn("_w2", shared)
    means = out.where("_in").agg(F.avg(w).alias("_m1"), F.avg("_w2").alias("_m2"))
    out = with_scalars(out, means)
    scaled = F.when((F.col("_m1") > 0) & (F.col("_m2") > 0), F.try_divide(F.col("_w2") * F.col("_m1"), F.col("_m2"))).otherwise(F.col("_w2"))
    return out.withColumn(w, F.when(F.col("_in"), scaled).otherwise(F.col(w))).drop("_in", "_sum", "_w2", "_m1", "_m2")


def group_sum_summary(df: DataFrame, group: str, w: str = "w") -> DataFrame:
    sums = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.sum(w).alias("_s"))
    return sums.agg(
        F.count("*").alias("n_groups"), F.min("_s").alias("min"), F.avg("_s").alias("mean"), F.max("_s").alias("max"),
        (F.max("_s") / F.avg("_s") > 4.0).alias("imbalanced"),
    )
