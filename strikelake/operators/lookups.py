"""Calendar lookups: bounded nearest close, trailing sums, split factors, volatility, spot cascades.

Every window here runs over rows unique per (ticker, day); facts are first reduced to their distinct
(ticker, day) questions and the answers are joined back, so fact volume never enters a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelake.functions.calendar import local_time
from strikelake.functions.scalar import clip
from strikelake.operators.asof import asof_join
from strikelake.operators.skew import DAY_MICROS


def nearest_close(
    queries: DataFrame, closes: DataFrame, direction: str, max_days: int, day: str = "day", prefix: str = "close", extra: tuple[str, ...] = ()
) -> DataFrame:
    """First positive close at 0..max_days after (or before) the day, with its date and lag in days.

    `extra` columns of the matched close come along as <prefix>_<name>.
    """
    step = 1 if direction == "forward" else -1
    asked = queries.select("ticker", day).distinct()
    tried = asked.select("ticker", day, F.explode(F.sequence(F.lit(0), F.lit(max_days))).alias("_k"))
    tried = tried.withColumn("date", F.date_add(day, F.col("_k") * step))
    usable = closes.where((F.col("close") > 0) & (F.col("close") < float("inf"))).select("ticker", "date", "close", *extra)
    found = tried.join(usable, ["ticker", "date"]).groupBy("ticker", day).agg(
        F.min_by(F.struct("close", "date", *extra), "_k").alias("_hit"), F.min("_k").alias(f"{prefix}_lag")
    )
    answer = found.select(
        "ticker", day, F.col("_hit.close").alias(f"{prefix}_px"), F.col("_hit.date").alias(f"{prefix}_date"), f"{prefix}_lag",
        *[F.col("_hit")[x].alias(f"{prefix}_{x}") for x in extra],
    )
    return queries.join(answer, ["ticker", day], "left")


def _over_days(lo: int | None, hi: int | None) -> Window:
    start = Window.unboundedPreceding if lo is None else lo
    end = Window.unboundedFollowing if hi is None else hi
    return Window.partitionBy("ticker").orderBy("_d").rangeBetween(start, end)


def _question_days(queries: DataFrame, day: str, events: DataFrame, amount: str) -> DataFrame:
    """Daily event amounts plus one NULL-amount row per distinct question."""
    daily = events.groupBy("ticker", F.unix_date("date").cast("long").alias("_d")).agg(F.sum(amount).alias("_a"))
    asked = queries.select("ticker", F.unix_date(day).cast("long").alias("_d")).distinct()
    return daily.withColumn("_q", F.lit(False)).unionByName(
        asked.select("ticker", "_d", F.lit(None).cast(daily.schema["_a"].dataType).alias("_a"), F.lit(True).alias("_q"))
    )


def window_total(
    queries: DataFrame, events: DataFrame, amount: str, lo: int | None, hi: int | None, name: str, day: str = "day"
) -> DataFrame:
    """Sum of event amounts in [day+lo, day+hi] (both ends included, None = open); 0 when there are none."""
    days = _question_days(queries, day, events, amount)
    total = days.withColumn(name, F.coalesce(F.sum("_a").over(_over_days(lo, hi)), F.lit(0.0)))
    answer = total.where("_q").select("ticker", F.date_from_unix_date(F.col("_d").cast("int")).alias(day), name)
    return queries.join(answer, ["ticker", day], "left")


def split_factor(queries: DataFrame, splits: DataFrame, name: str = "split_factor", day: str = "day") -> DataFrame:
    """Product of the ratios of splits later than the day."""
    logs = splits.where(F.col("ratio") > 0).withColumn("_ln", F.ln("ratio"))
    out = window_total(queries, logs, "_ln", 1, None, name, day)
    return out.withColumn(name, F.exp(name))


def count_between(
    queries: DataFrame, events: DataFrame, start: str, end: str, name: str
) -> DataFrame:
    """Events with start <= date <= end, by difference of two running counts."""
    ones = events.withColumn("_one", F.lit(1.0))
    marked = queries.withColumn("_before", F.date_sub(start, 1))
    upto = window_total(marked, ones, "_one", None, 0, "_upto", end)
    both = window_total(upto, ones, "_one", None, 0, "_prior", "_before")
    count = F.when(F.col(start) <= F.col(end), (F.col("_upto") - F.col("_prior")).cast("long"))
    return both.withColumn(name, count).drop("_before", "_upto", "_prior")


def closes_already_adjusted(closes: DataFrame, splits: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """Per ticker: do the closes already carry the split? Decided by the first split that can tell.

    False when the close ratio across it is near the split ratio, True when near 1, NULL when no
    split decides.
    """
    events = splits.where(F.col("ratio") > 0).select("ticker", F.col("date").cast("timestamp").alias("_ts"), "ratio")
    days = closes.select("ticker", F.col("date").cast("timestamp").alias("_cts"), "close")
    pre = asof_join(events, days, ["ticker"], "_ts", "_cts", ["close"], exact=False, matched_ts="_m1")
    pre = pre.withColumnRenamed("close", "_pre")
    both = asof_join(pre, days, ["ticker"], "_ts", "_cts", ["close"], direction="forward", matched_ts="_m2")
    ok = (F.col("_pre") > 0) & (F.col("close") > 0)
    ratio = F.when(ok, F.try_divide("_pre", "close"))
    verdict = F.when(F.abs(ratio - F.col("ratio")) / F.col("ratio") <= tolerance, F.lit(False)).when(
        F.abs(ratio - 1.0) <= tolerance, F.lit(True)
    )
    judged = both.withColumn("_v", verdict).where(F.col("_v").isNotNull())
    first = judged.groupBy("ticker").agg(F.min_by("_v", F.struct("_ts", "ratio")).alias("already_adjusted"))
    return closes.select("ticker").distinct().join(first, "ticker", "left")


def both_scales(closes: DataFrame, splits: DataFrame) -> DataFrame:
    """closes(ticker, date, close_raw, close_adj) whatever scale the feed delivered."""
    factor = split_factor(closes, splits, day="date")
    state = closes_already_adjusted(closes, splits)
    adjusted = F.coalesce("already_adjusted", F.lit(False))
    return factor.join(state, "ticker", "left").select(
        "ticker",
        "date",
        F.when(adjusted, F.col("close") * F.col("split_factor")).otherwise(F.col("close")).alias("close_raw"),
        F.when(adjusted, F.col("close")).otherwise(F.col("close") / F.col("split_factor")).alias("close_adj"),
    )


def _log_return(order: Window) -> Column:
    prev = F.lag("close").over(order)
    ok = (F.col("close") > 0) & (prev > 0)
    return F.when(ok, F.ln(F.when(ok, F.try_divide("close", prev))))


def realized_vol(closes: DataFrame, lookback: int = 20, name: str = "rv20") -> DataFrame:
    """sqrt(252) x sample deviation of the last `lookback` log returns; NULL if any is missing."""
    order = Window.partitionBy("ticker").orderBy("date")
    trailing = order.rowsBetween(-(lookback - 1), 0)
    rets = closes.withColumn("_lr", _log_return(order))
    full = F.count("_lr").over(trailing) >= lookback
    return rets.withColumn(name, F.when(full, F.stddev_samp("_lr").over(trailing) * (252.0**0.5))).drop("_lr")


def vol_table(closes: DataFrame, target: int = 20, min_closes: int = 2, history_days: int = 400) -> DataFrame:
    """Per close date: volatility of the last `target` closes, else of what there is, scaled up."""
    order = Window.partitionBy("ticker").orderBy("_d")
    rets = closes.withColumn("_d", F.unix_date("date").cast("long")).withColumn("_lr", _log_return(order))
    near = order.rowsBetween(-(target - 2), 0)  # target closes hold target-1 returns
    far = order.rangeBetween(-history_days, 0)
    # The first close of the span has no return inside it, so its return is taken out of the sums.
    head = F.coalesce(F.first("_lr").over(far), F.lit(0.0))
    head_known = F.when(F.first("_lr").over(far).isNotNull(), 1).otherwise(0)
    rows = (
        rets.withColumn("_n", F.count("*").over(far))
        .withColumn("_cnt_near", F.count("_lr").over(near))
        .withColumn("_sd_near", F.stddev_samp("_lr").over(near))
        .withColumn("_cnt_far", F.count("_lr").over(far) - head_known)
        .withColumn("_s1", F.coalesce(F.sum("_lr").over(far), F.lit(0.0)) - head)
        .withColumn("_s2", F.coalesce(F.sum(F.col("_lr") * F.col("_lr")).over(far), F.lit(0.0)) - head * head)
    )
    spread = F.try_divide(
        F.col("_s2") - F.try_divide(F.col("_s1") * F.col("_s1"), F.col("_cnt_far")), F.col("_cnt_far") - 1
    )
    whole = F.col("_cnt_far") == F.col("_n") - 1  # one bad price spoils the estimate
    rows = rows.withColumn("_sd_far", F.when(whole & (spread > 0), F.sqrt(F.when(spread > 0, spread))))
    annual = 252.0**0.5
    good_near = (F.col("_n") >= target) & (F.col("_cnt_near") == target - 1) & (F.col("_sd_near") > 0)
    good_far = (F.col("_n") >= min_closes) & (F.col("_sd_far") > 0)
    scale = F.when(F.col("_n") < target, F.sqrt(F.lit(float(target)) / F.col("_n"))).otherwise(F.lit(1.0))
    return rows.select(
        "ticker",
        "date",
        F.when(good_near, clip(F.col("_sd_near") * annual, 0.0, 10.0))
        .when(good_far, clip(F.col("_sd_far") * annual * scale, 0.0, 10.0))
        .alias("rv"),
        F.when(good_near, F.lit(target)).when(good_far, F.col("_n").cast("int")).alias("rv_window"),
        F.when(good_near, F.lit(f"realized_{target}d"))
        .when(good_far, F.concat(F.lit("realized_"), F.col("_n").cast("string"), F.lit("d_scaled")))
        .alias("rv_source"),
    )


def robust_vol(
    queries: DataFrame, closes: DataFrame, day: str = "day", atm_iv: str = "atm_iv", fallback: float = 0.30
) -> DataFrame:
    """Realised volatility at the last close <= day, else ATM implied volatility, else a constant."""
    table = vol_table(closes).withColumn("_cts", F.col("date").cast("timestamp"))
    asked = queries.withColumn("_ts", F.col(day).cast("timestamp"))
    hit = asof_join(asked, table, ["ticker"], "_ts", "_cts", ["rv", "rv_window", "rv_source"], matched_ts="_m")
    iv_ok = F.col(atm_iv) > 0
    return hit.select(
        *queries.columns,
        F.coalesce("rv", F.when(iv_ok, clip(F.col(atm_iv), 0.0, 10.0)), F.lit(fallback)).alias("rv20"),
        F.coalesce("rv_source", F.when(iv_ok, F.lit("implied_atm")), F.lit("fallback")).alias("rv20_source"),
        F.coalesce("rv_window", F.lit(0)).alias("rv20_window"),
        (F.col("rv").isNull() & ~F.coalesce(iv_ok, F.lit(False))).alias("is_missing_rv20"),
    )


def spot_asof(
    queries: DataFrame,
    minutes: DataFrame,
    daily: DataFrame,
    ts: str = "ts",
    zone: str = "America/New_York",
    intraday_days: int = 5,
) -> DataFrame:
    """Last minute price <= ts, else the last daily close before the local date, else none."""
    intraday = asof_join(
        queries, minutes, ["ticker"], ts, "minute_ts", ["minute_px"], tiebreak=["minute_tie"],
        tolerance_micros=intraday_days * DAY_MICROS, matched_ts="_its",
    )
    local_day = F.to_date(local_time(F.col(ts), zone)).cast("timestamp")
    dated = intraday.withColumn("_day", local_day)
    closes = daily.select("ticker", F.col("date").cast("timestamp").alias("_cts"), F.col("close").alias("_close"))
    both = asof_join(dated, closes, ["ticker"], "_day", "_cts", ["_close"], exact=False, matched_ts="_dts")
    return both.select(
        *queries.columns,
        F.coalesce("minute_px", "_close").alias("spot"),
        F.when(F.col("minute_px").isNotNull(), F.lit("intraday_1m"))
        .when(F.col("_close").isNotNull(), F.lit("prev_close"))
        .otherwise(F.lit("none"))
        .alias("spot_source"),
        F.coalesce(F.when(F.col("minute_px").isNotNull(), F.col("_its")), F.col("_dts")).alias("spot_ts"),
    )


def trailing_yield(
    queries: DataFrame, dividends: DataFrame, closes: DataFrame, day: str = "day", reference: str = "ref_yield"
) -> DataFrame:
    """Dividends of the last 365 days over the last close, if in [0, 0.2]; else the reference in [0, 1]."""
    counted = dividends.withColumn("_one", F.lit(1.0))
    total = window_total(queries, dividends, "amount", -365, 0, "_div", day)
    total = window_total(total, counted, "_one", -365, 0, "_cnt", day).withColumn("_ts", F.col(day).cast("timestamp"))
    px = closes.select("ticker", F.col("date").cast("timestamp").alias("_cts"), "close")
    priced = asof_join(total, px, ["ticker"], "_ts", "_cts", ["close"], matched_ts="_m")
    own = F.when((F.col("_cnt") > 0) & (F.col("close") > 0), F.try_divide("_div", "close"))
    ref = F.when(F.col(reference).between(0.0, 1.0), F.col(reference))
    return priced.select(
        *queries.columns, F.when(own.between(0.0, 0.2), own).otherwise(ref).alias("dividend_yield")
    )
