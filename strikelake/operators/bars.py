"""Ticks to bars, bar features, cleaning, down-sampling and hourly series.

Windows below run over bars, which are unique per (market, calendar step): a market's bar count is
bounded by the calendar however many ticks it has. Raw ticks are only aggregated or handled per
(market, day) slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelake.functions.scalar import clip, finite, symmetric_quote
from strikelake.operators.asof import asof_join, hourly_spine
from strikelake.operators.skew import pick_row, time_slice, with_neighbours, with_scalars

FREQS = {"5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}


def bucket_start(ts: Column, freq: str) -> Column:
    if freq == "1h":
        return F.date_trunc("hour", ts)
    if freq == "1d":
        return F.date_trunc("day", ts)
    return F.window(ts, FREQS[freq])["start"]


def ohlc(
    ticks: DataFrame,
    freq: str,
    market: str = "market_id",
    ts: str = "timestamp_utc",
    price: str = "price",
    tiebreak: Sequence[str] = ("event_id",),
    fill_gaps: bool = True,
) -> DataFrame:
    """Open/high/low/close per UTC-aligned bucket; gaps inside a market's span come out as NULL bars."""
    order = F.struct(ts, *tiebreak)
    bars = ticks.groupBy(market, bucket_start(F.col(ts), freq).alias("bar")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
    )
    if fill_gaps:
        span = bars.groupBy(market).agg(F.min("bar").alias("_lo"), F.max("bar").alias("_hi"))
        step = F.expr(f"INTERVAL {FREQS[freq].upper().rstrip('S')}")
        grid = span.select(market, F.explode(F.sequence("_lo", "_hi", step)).alias("bar"))
        bars = grid.join(bars, [market, "bar"], "left")
    return bars.withColumnRenamed("bar", ts).select(
        ts,
        market,
        "open",
        "high",
        "low",
        "close",
        F.lit(None).cast("double").alias("volume"),
        F.lit(None).cast("double").alias("trade_count"),
    )


def simple_return(close: str, order: Window) -> Column:
    """close / previous close - 1; a zero base gives NULL instead of an infinity."""
    return finite(F.try_divide(F.col(close), F.lag(close).over(order)) - 1.0)


def bar_features(
    bars: DataFrame,
    spread_bps: float = 50.0,
    vol_window: int = 24,
    vol_min: int = 6,
    market: str = "market_id",
    ts: str = "timestamp_utc",
) -> DataFrame:
    """Features known before the bar: everything is taken from the bar before it."""
    by_time = Window.partitionBy(market).orderBy(ts)
    trailing = by_time.rowsBetween(-(vol_window - 1), 0)
    prev = F.lag("close").over(by_time)
    ratio = F.try_divide(F.col("close"), prev)
    with_ret = (
        bars.where(F.col("close").isNotNull())
        .withColumn("ret_1h", simple_return("close", by_time))
        .withColumn("log_ret", F.when(ratio > 0, F.ln(F.when(ratio > 0, ratio))))
    )
    vol = F.when(F.count("log_ret").over(trailing) >= vol_min, F.stddev_samp("log_ret").over(trailing))
    with_vol = with_ret.withColumn("_vol", vol)
    last = F.lag("close").over(by_time)
    last_time = F.lag(ts).over(by_time)
    out = with_vol.select(
        *with_ret.columns,
        last.alias("pm_last"),
        last_time.alias("pm_last_time"),
        F.lag("volume").over(by_time).alias("pm_liquidity_proxy"),
        F.lag("ret_1h").over(by_time).alias("pm_momentum_1h"),
        last_time.alias("pm_momentum_1h_time"),
        F.lag("_vol").over(by_time).alias("pm_volatility"),
        last_time.alias("pm_volatility_time"),
    )
    bid, ask = symmetric_quote(F.col("pm_last"), spread_bps)
    return (
        out.withColumn("pm_mid", F.col("pm_last"))
        .withColumn("pm_bid", bid)
        .withColumn("pm_ask", ask)
        .withColumn("pm_spread", F.col("pm_ask") - F.col("pm_bid"))
    )


def last_bar_per_day(bars: DataFrame, market: str = "market_id", ts: str = "timestamp_utc") -> DataFrame:
    dated = bars.withColumn("date", F.to_date(ts))
    return pick_row(dated, [market, "date"], [F.col(ts)], last=True)


def momentum(bars: DataFrame, name: str, market: str = "market_id", ts: str = "timestamp_utc") -> DataFrame:
    """Return of the previous bar and the time it was known (5-minute, hourly or daily bars)."""
    by_time = Window.partitionBy(market).orderBy(ts)
    return (
        bars.where(F.col("close").isNotNull())
        .withColumn("_ret", simple_return("close", by_time))
        .withColumn(name, F.lag("_ret").over(by_time))
        .withColumn(f"{name}_time", F.lag(ts).over(by_time))
        .drop("_ret")
    )


def despike(
    ticks: DataFrame,
    jump: float,
    revert: float,
    market: str = "market_id",
    ts: str = "timestamp_utc",
    tiebreak: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Replace one-point spikes by the mean of their raw neighbours; `price_raw` keeps the input.

    Ticks of equal time are first reduced to the last one, as in the price history loader.
    """
    single = pick_row(ticks, [market, ts], [F.col(t) for t in tiebreak], last=True)
    near = with_neighbours(single, [market], [ts], time_slice(F.col(ts)), "price")
    before, after, here = F.col("prev_price"), F.col("next_price"), F.col("price")
    spike = F.coalesce(
        (F.abs(here - before) >= jump) & (F.abs(here - after) >= jump) & (F.abs(after - before) <= revert),
        F.lit(False),
    )
    return (
        near.withColumn("price_raw", here)
        .withColumn("despiked", spike)
        .withColumn("price", F.when(spike, clip((before + after) * 0.5, 0.0, 1.0)).otherwise(here))
        .drop("prev_price", "next_price")
    )


def downsample(
    points: DataFrame,
    max_points: int,
    keys: Sequence[str],
    ts: str = "timestamp_utc",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Last point of each of N equal time buckets. The latest point opens bucket N, so N+1 can remain.

    Series of at most N points pass unchanged; a series of zero length in time keeps its first N.
    """
    micros = F.unix_micros(F.col(ts))
    span = points.groupBy(*keys).agg(
        F.min(micros).alias("_lo"), F.max(micros).alias("_hi"), F.count("*").alias("_n")
    )
    joined = points.join(span, list(keys))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(max_points))
    bucket = F.floor(F.try_divide(micros - F.col("_lo"), width))
    order = [F.col(ts), *[F.col(t) for t in tiebreak]]
    moving = (F.col("_n") > max_points) & (F.col("_hi") > F.col("_lo"))
    cols = points.columns
    thinned = pick_row(
        joined.where(moving).withColumn("_b", bucket).select(*cols, "_b"), [*keys, "_b"], order, last=True
    ).select(*cols)
    short = joined.where(F.col("_n") <= max_points).select(*cols)
    flat = joined.where((F.col("_n") > max_points) & (F.col("_hi") == F.col("_lo"))).select(*cols)
    ranked = Window.partitionBy(*keys).orderBy(*order)
    # Equal-time points only: the filter on row_number becomes a per-task group limit before the shuffle.
    flat = flat.withColumn("_rn", F.row_number().over(ranked)).where(F.col("_rn") <= max_points).drop("_rn")
    return thinned.unionByName(short).unionByName(flat)


def last_at_or_before(
    ticks: DataFrame, cutoff: Column, keys: Sequence[str], ts: str = "timestamp_utc", tiebreak: Sequence[str] = ()
) -> DataFrame:
    return pick_row(ticks.where(F.col(ts) <= cutoff), list(keys), [F.col(ts), *[F.col(t) for t in tiebreak]], last=True)


def hourly_series(
    markets: DataFrame,
    ticks: DataFrame,
    start: Column,
    end: Column,
    tiebreak: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Forward-filled hourly price per market from `start` to `end` (a column of `markets` may bound it)."""
    spine = hourly_spine(markets, start, end)
    return asof_join(
        spine, ticks, ["market_id"], "timestamp_utc", "timestamp_utc", ["price"], exact=True, tiebreak=tiebreak,
        matched_ts="price_time",
    )


def high_water_mark(ticks: DataFrame, keys: Sequence[str], ts: str = "timestamp_utc") -> DataFrame:
    return ticks.groupBy(*keys).agg(F.max(ts).alias("last_ts"))


def newer_than_stored(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], ts: str = "timestamp_utc") -> DataFrame:
    """Rows later than the stored maximum of their key; unseen keys pass whole."""
    mark = high_water_mark(stored, keys, ts)
    return (
        incoming.join(mark, list(keys), "left")
        .where(F.col("last_ts").isNull() | (F.col(ts) > F.col("last_ts")))
        .drop("last_ts")
    )


def resume_points(
    markets: DataFrame, ticks: DataFrame, week_start: Column, force: bool = False, keys: Sequence[str] = ("market_id", "token_role")
) -> DataFrame:
    """Where the next pull starts: one second after the newest tick, else the start of the week."""
    mark = high_water_mark(ticks, keys)
    resume = F.timestamp_micros(F.unix_micros("last_ts") + 1_000_000)
    start = week_start if force else F.greatest(F.coalesce(resume, week_start), week_start)
    return markets.join(mark, list(keys), "left").withColumn("fetch_from", start)


def replace_range(
    existing: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    day: Column,
    start: Column | None = None,
    end: Column | None = None,
) -> DataFrame:
    """Delete [start, end] from the stored rows, append the new ones, new rows win on equal keys."""
    inside = F.lit(start is not None or end is not None)
    if start is not None:
        inside = inside & (day >= start)
    if end is not None:
        inside = inside & (day <= end)
    kept = existing.where(~F.coalesce(inside, F.lit(False))).withColumn("_src", F.lit(0))
    merged = kept.unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return pick_row(merged, list(keys), [F.col("_src")], last=True).drop("_src")


def signal_heights(runs: DataFrame, metric: str, recency: str, last_n: int = 10) -> DataFrame:
    """Scale the metric of the newest runs to 30..100, lower is better; equal values give 70."""
    recent = runs.where(F.col(metric).isNotNull()).orderBy(F.col(recency).desc()).limit(last_n)
    bounds = recent.agg(F.min(metric).alias("_lo"), F.max(metric).alias("_hi"))
    scaled = 30 + 70 * F.try_divide(F.col("_hi") - F.col(metric), F.col("_hi") - F.col("_lo"))
    return with_scalars(recent, bounds).select(
        *runs.columns,
        F.when(F.col("_hi") == F.col("_lo"), F.lit(70)).otherwise(F.bround(scaled, 0).cast("int")).alias("height"),
    )
