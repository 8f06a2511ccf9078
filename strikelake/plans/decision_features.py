"""Point-in-time decision features: bars, market features, benchmark, labels and the leak check."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strikelake.functions.calendar import close_time_utc
from strikelake.operators.bars import bar_features
from strikelake.operators.relational import common_values, many_to_one
from strikelake.operators.splits import assert_no_leaks, times_before


def decision_features(
    bars: DataFrame,
    dim_market: DataFrame,
    benchmark: DataFrame,
    labels: DataFrame | None = None,
    *,
    spread_bps: float = 50.0,
    vol_window: int = 24,
    vol_min: int = 6,
    zone: str = "America/New_York",
    daily: bool = True,
    fail_on_leak: bool = False,
) -> DataFrame:
    """One row per market and decision time that has a benchmark on that date.

    Daily bars are decided one second after the local close, so the day's benchmark (made at the
    close) is strictly earlier.
    """
    timed = bars
    if daily:
        close = close_time_utc(F.to_date("timestamp_utc"), zone)
        timed = bars.withColumn("timestamp_utc", F.timestamp_micros(F.unix_micros(close) + 1_000_000))
    base = bar_features(timed, spread_bps, vol_window, vol_min)
    base = base.withColumns(
        {
            "pm_momentum_5m": F.lit(None).cast("double"), "pm_momentum_5m_time": F.lit(None).cast("timestamp"),
            "pm_momentum_1d": F.col("pm_momentum_1h"), "pm_momentum_1d_time": F.col("pm_momentum_1h_time"),
        }
    )
    dim = dim_market.withColumns({"ticker": F.upper("ticker"), "threshold": F.round("threshold", 6)})
    base = many_to_one(base, dim, ["market_id"], check=False)
    seconds = (F.unix_micros("resolution_time_utc") - F.unix_micros("timestamp_utc")) / 1e6
    base = base.withColumns({"pm_time_to_resolution": seconds / 86_400.0, "decision_date": F.to_date("timestamp_utc")})
    bench = benchmark.withColumnsRenamed({"snapshot_date": "decision_date", "asof_time": "prn_asof_time"})
    bench = bench.withColumn("threshold", F.round("threshold", 6))
    key = ["ticker", "threshold", "expiry_date", "decision_date"]
    # The inner join already limits both sides to common dates.
    out = base.dropna(subset=key).join(bench.dropna(subset=[*key, "prn_asof_time"]), key)
    out = many_to_one(out, labels, ["market_id"], check=False) if labels is not None else out.withColumn("label", F.lit(None).cast("int"))
    times = [c for c in out.columns if c.endswith("_time") and c.startswith(("pm_", "prn_"))]
    if fail_on_leak:
        return assert_no_leaks(out, "timestamp_utc", times, allow_missing=True)
    return out.withColumn("leak_check_passed", times_before(F.col("timestamp_utc"), [F.col(t) for t in times], True))


def common_dates(base: DataFrame, benchmark: DataFrame) -> DataFrame:
    return common_values(base.select(F.col("decision_date").alias("d")), benchmark.select(F.col("snapshot_date").alias("d")), "d")
