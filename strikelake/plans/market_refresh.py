"""Hourly market table and daily snapshot of the refresh job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.functions.calendar import display_friday, last_completed_close
from strikelake.functions.scalar import clip
from strikelake.operators.asof import asof_join, hourly_spine
from strikelake.operators.bars import last_at_or_before
from strikelake.operators.relational import many_to_one
from strikelake.operators.skew import pick_row


def hourly_market_table(
    markets: DataFrame, ticks: DataFrame, benchmark: DataFrame, start: Column, cutoff: Column, spread_bps: float = 50.0
) -> DataFrame:
    """One row per market and hour up to min(resolution, cut-off): last YES price and last benchmark.

    markets(market_id, ticker, threshold, expiry_date, resolution_time_utc);
    benchmark(ticker, threshold, expiry_date, asof_time, pRN). A benchmark made after the hour, or an
    hour after the cut-off, fails the job.
    """
    end = F.least(F.coalesce("resolution_time_utc", cutoff), cutoff)
    spine = hourly_spine(markets.withColumn("_end", end), start, F.col("_end")).drop("_end")
    yes = ticks.where(F.lower("token_role") == "yes").select("market_id", F.col("timestamp_utc").alias("price_ts"), "price", "event_id")
    priced = asof_join(spine, yes, ["market_id"], "timestamp_utc", "price_ts", ["price"], tiebreak=["event_id"], matched_ts="price_time")
    keyed = priced.withColumn("threshold", F.round("threshold", 6))
    bench = benchmark.withColumn("threshold", F.round("threshold", 6))
    out = asof_join(
        keyed, bench, ["ticker", "threshold", "expiry_date"], "timestamp_utc", "asof_time", ["pRN"], matched_ts="prn_asof_time"
    )
    ask = F.col("price")
    leak = (F.col("timestamp_utc") > cutoff) | F.coalesce(F.col("prn_asof_time") > F.col("timestamp_utc"), F.lit(False))
    guarded = F.when(~leak, F.col("timestamp_utc")).otherwise(F.raise_error(F.lit("leak check failed")))
    return out.withColumns(
        {
            "timestamp_utc": guarded, "pm_buy": ask, "pm_ask": ask, "pm_bid": clip(ask * (1 - spread_bps / 10_000.0), 0.0, 1.0),
            "week_friday": display_friday(F.to_date("timestamp_utc")),
        }
    ).drop("price")


def daily_snapshot(markets: DataFrame, ticks: DataFrame, benchmark: DataFrame, now: Column, zone: str = "America/New_York") -> DataFrame:
    """Markets with a benchmark of the last completed close, priced by the last YES and NO tick up to it."""
    close = last_completed_close(now, zone)
    day = F.to_date(F.from_utc_timestamp(close, zone))
    key = ["ticker", "threshold", "expiry_date"]
    todays = benchmark.where(F.col("snapshot_date") == day).withColumn("threshold", F.round("threshold", 6))
    todays = todays.withColumn("prn_asof_utc", F.col("asof_time")).drop("asof_time")
    listed = pick_row(markets.withColumn("threshold", F.round("threshold", 6)), key, [F.col("market_id")])
    snap = many_to_one(todays, listed, key, check=False).where(F.col("market_id").isNotNull())
    last = last_at_or_before(ticks, close, ["market_id", "token_role"], tiebreak=["event_id"])
    by_role = last.groupBy("market_id").agg(
        F.max(F.when(F.col("token_role") == "yes", F.col("price"))).alias("pPM_buy"), F.max(F.when(F.col("token_role") == "no", F.col("price"))).alias("qPM_buy")
    )
    out = snap.join(by_role, "market_id", "left")
    ok = F.col("pPM_buy").isNotNull() | F.col("qPM_buy").isNotNull()
    stamp = F.when(F.col("prn_asof_utc") <= close, close).otherwise(F.raise_error(F.lit("leak check failed")))
    return out.withColumns(
        {
            "snapshot_time_utc": stamp, "pPM_mid": F.col("pPM_buy"), "qPM_mid": F.col("qPM_buy"), "pm_ok": ok,
            "pm_reason": F.when(ok, "ok").otherwise("no_clob_trade"),
        }
    )


def market_series(table: DataFrame) -> DataFrame:
    """Ordered points per (ticker, threshold, week): hourly rows of one week, so each list is short."""
    point = F.struct(
        "timestamp_utc", "pm_buy", "pm_bid", F.coalesce("pm_ask", "pm_buy").alias("pm_ask"), "pRN"
    )
    return table.groupBy("ticker", "threshold", "week_friday", "market_id").agg(F.sort_array(F.collect_list(point)).alias("points"))
