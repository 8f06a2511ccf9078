"""Dataset-level jobs: weight migration over many files, the three projections of a build, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.operators import relational, weights

# Columns of the current and the earlier weighting scheme.
WEIGHT_COLUMNS = (
    "weight_group_key", "weight_group_size", "weight_group_w", "weight_ticker_group_count", "weight_ticker_w_raw",
    "weight_trade_focus_mult", "weight_raw", "weight_final", "weighting_version", "sample_weight_final",
)


def migrate_weights(rows: DataFrame, file: str = "file", **options) -> tuple[DataFrame, DataFrame]:
    """Recompute the weights of many dataset files in one job: (rows, one report row per file).

    Each file is its own weighting scope. A file with a row that lacks a key is left out and reported
    as skipped_unfit.
    """
    base = rows.drop(*[c for c in WEIGHT_COLUMNS if c in rows.columns])
    keyed = weights.with_weight_keys(base, probe=False)
    bad = F.col("snapshot_date").isNull() | F.col("expiry_date").isNull() | F.col("snapshot_dow").isNull() | F.col("_k").isNull()
    fitness = keyed.groupBy(file).agg(F.count("*").alias("_rows"), F.max(bad).alias("_unfit"))
    # A row per file is broadcast: a shuffle by file would send a file's rows to one task.
    fit = base.join(F.broadcast(fitness.where(~F.col("_unfit")).select(file)), file, "left_semi")
    # All weights are those of the groups, so the report reads the table of groups, not the rows.
    keyed, groups = weights.weight_groups(fit, probe=False, scope=(file,), **options)
    done = weights.weighted_rows(keyed, groups, (file,))
    size = F.col("weight_group_size")
    stats = groups.groupBy(file).agg(
        F.count("weight_group_key").alias("weight_groups"), F.min("weight_final").alias("weight_min"),
        (F.sum(F.col("weight_final") * size) / F.sum(size)).alias("weight_mean"), F.max("weight_final").alias("weight_max"),
    )
    report = fitness.join(stats, file, "left").select(
        file, F.when(F.col("_unfit"), "skipped_unfit").otherwise("processed").alias("status"), F.col("_rows").alias("rows"),
        "weight_groups", "weight_min", "weight_mean", "weight_max",
    )
    return done, report


def training_view(rows: DataFrame) -> DataFrame:
    return rows


# Diagnostics carried into the snapshot view when present.
SNAPSHOT_EXTRAS = (
    "asof_target", "asof_date", "week_monday", "week_friday", "spot_scale_used", "dividend_yield", "forward_price",
    "moneyness_ref", "moneyness_ref_price", "used_max_abs_logm", "n_band_raw", "n_band_inside", "calls_k_min",
    "calls_k_max", "quote_source", "n_chain_raw", "n_chain_used", "rel_spread_median", "dropped_liquidity",
    "dropped_intrinsic", "dropped_insane", "median_dK", "min_dK",
)


def snapshot_view(rows: DataFrame, stock_source: str = "closes") -> DataFrame:
    """Everything known without the benchmark probability; a pRN column here is an error."""
    same = F.col("option_expiration_used") == F.col("option_expiration_requested")
    sat = F.upper("expiry_convention").contains("SAT")
    source = F.concat(F.lit(f"{stock_source}_"), F.col("spot_scale_used"))
    view = rows.select(
        "row_id", "asof_ts", "ticker", "option_type",
        F.col("option_expiration_requested").alias("expiry_date_requested"),
        F.col("option_expiration_used").alias("expiry_date_used"),
        F.when(same, "requested").when(sat, "fallback_next").otherwise("fallback_prev").alias("expiry_used_reason"),
        F.col("week_friday").alias("event_end_date"), F.lit("UTC").alias("event_end_tz"), "K",
        F.col("S_asof_close").alias("S0_close_used"), source.alias("S0_close_source"),
        F.col("asof_fallback_days").alias("S0_close_lag_days"), F.col("S_expiry_close").alias("expiry_close_used"),
        source.alias("expiry_close_source"), F.col("expiry_fallback_days").alias("expiry_close_lag_days"), "T_days",
        *[c for c in SNAPSHOT_EXTRAS if c in rows.columns],
    )
    leaked = [c for c in view.columns if "prn" in c.lower()]
    if leaked:
        raise ValueError(f"snapshot view must not carry {leaked}")
    return view


def prn_view(rows: DataFrame, method: str, version: str, config_hash: str) -> DataFrame:
    flag = lambda c: F.col(c) if c in rows.columns else F.lit(False)
    curve: Column = F.concat_ws(
        "|", F.col("ticker").cast("string"), F.col("option_expiration_used").cast("string"), F.col("asof_date").cast("string"),
        F.lit(method), F.lit(version),
    )
    return rows.select(
        "row_id", "pRN_raw", "pRN", F.lit(method).alias("rn_method"), F.col("quote_source").alias("rn_quote_source"),
        (flag("prn_monotone_adj_intervals") | flag("prn_monotone_adj_targets")).alias("rn_monotone_adjusted"),
        curve.alias("curve_id"), F.lit(version).alias("prn_version"), F.lit(config_hash).alias("prn_config_hash"),
        F.col("n_chain_used").alias("n_calls_used"), "calls_k_min", "calls_k_max", F.col("median_dK").alias("deltaK"),
        F.col("rel_spread_median").alias("avg_rel_spread"),
    )


def backfill_dataset(existing: DataFrame, extra: DataFrame, **options) -> DataFrame:
    """Add the missing rows, keep the stored ones on equal ids, and weight the whole again.

    `existing` is read several times: it should be a stored table, not a job.
    """
    merged = relational.backfill(existing, extra, write=True)
    merged = merged.drop(*[c for c in WEIGHT_COLUMNS if c in merged.columns])
    return weights.weighting_v3(merged, **options)
