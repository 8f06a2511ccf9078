"""As-of joins by union and one ordered pass per (key, time slice): linear, never a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelake.operators.skew import SLICE_MICROS

SPANS_PER_TASK = 1_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    *,
    exact: bool = True,
    direction: str = "backward",
    tolerance_micros: int | None = None,
    tiebreak: Sequence[str] = (),
    slice_micros: int = SLICE_MICROS,
    matched_ts: str = "matched_ts",
) -> DataFrame:
    """Left rows with `values` (and the right time as `matched_ts`) of the closest right row.

    `exact=False` demands a strictly earlier (later) right time. Equal right times are settled by
    `tiebreak` (largest wins looking back, smallest looking ahead). Every left row comes back.
    """
    if direction == "nearest":
        return _nearest(left, right, on, left_ts, right_ts, values, tolerance_micros, tiebreak, slice_micros, matched_ts)
    keys = list(on)
    sign = 1 if direction == "backward" else -1
    axis_l = F.unix_micros(F.col(left_ts).cast("timestamp")) * sign
    axis_r = F.unix_micros(F.col(right_ts).cast("timestamp")) * sign
    # Right rows sort before left rows at equal time when an exact match counts.
    side_right, side_left = (0, 1) if exact else (1, 0)

    payload = F.struct(F.col(right_ts).alias("_mts"), *[F.col(v).alias(v) for v in values])
    right_rows = right.dropna(subset=[*keys, right_ts]).select(
        *keys,
        axis_r.alias("_axis"),
        F.struct(*[F.col(t).alias(t) for t in tiebreak]).alias("_tie") if tiebreak else F.lit(0).alias("_tie"),
        payload.alias("_r"),
    )
    left_rows = left.select(*keys, axis_l.alias("_axis"), F.struct(*left.columns).alias("_l"))
    right_rows = right_rows.withColumn("_s", F.floor(F.col("_axis") / F.lit(slice_micros)))
    left_rows = left_rows.withColumn("_s", F.floor(F.col("_axis") / F.lit(slice_micros)))

    # Forward order over ties: the first-listed right row must be met last on the reversed axis.
    tie_pick = F.max_by if sign == 1 else F.min_by
    per_time = right_rows.groupBy(*keys, "_s", "_axis").agg(tie_pick("_r", "_tie").alias("_r"))
    last_of_slice = per_time.groupBy(*keys, "_s").agg(F.max_by("_r", "_axis").alias("_r"))
    wanted = left_rows.select(*keys, "_s").distinct()
    slices = last_of_slice.withColumn("_need", F.lit(False)).unionByName(
        wanted.select(*keys, "_s", F.lit(None).cast(per_time.schema["_r"].dataType).alias("_r"), F.lit(True).alias("_need"))
    )
    # RANGE, not ROWS: everything in the slice itself is excluded, whichever row comes first.
    earlier = Window.partitionBy(*keys).orderBy("_s").rangeBetween(Window.unboundedPreceding, -1)
    carried = (
        slices.withColumn("_r", F.last("_r", ignorenulls=True).over(earlier))
        .where(F.col("_need") & F.col("_r").isNotNull())
        .select(*keys, "_s", F.lit(None).cast("long").alias("_axis"), F.lit(-1).alias("_side"), "_r")
    )
    empty_left = F.lit(None).cast(left_rows.schema["_l"].dataType).alias("_l")
    stream = (
        left_rows.select(*keys, "_s", "_axis", F.lit(side_left).alias("_side"), F.lit(None).cast(per_time.schema["_r"].dataType).alias("_r"), "_l")
        .unionByName(per_time.select(*keys, "_s", "_axis", F.lit(side_right).alias("_side"), "_r", empty_left))
        .unionByName(carried.select(*keys, "_s", "_axis", "_side", "_r", empty_left))
    )
    ordered = (
        Window.partitionBy(*keys, "_s")
        .orderBy(F.col("_axis").asc_nulls_first(), "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hit = F.last("_r", ignorenulls=True).over(ordered)
    out = stream.withColumn("_r", hit).where(F.col("_l").isNotNull())
    if tolerance_micros is not None:
        gap = F.abs(F.col("_axis") - F.unix_micros(F.col("_r._mts").cast("timestamp")) * sign)
        out = out.withColumn("_r", F.when(gap <= tolerance_micros, F.col("_r")))
    return out.select("_l.*", F.col("_r._mts").alias(matched_ts), *[F.col("_r")[v].alias(v) for v in values])


def _nearest(left, right, on, left_ts, right_ts, values, tolerance, tiebreak, slice_micros, matched_ts):
    args = dict(tolerance_micros=tolerance, tiebreak=tiebreak, slice_micros=slice_micros)
    back = asof_join(left, right, on, left_ts, right_ts, values, exact=True, matched_ts="_bts", **args)
    back = back.select(*left.columns, F.when(F.col("_bts").isNotNull(), F.struct("_bts", *values)).alias("_b"))
    both = asof_join(back, right, on, left_ts, right_ts, values, exact=True, direction="forward", matched_ts="_fts", **args)
    here = F.unix_micros(F.col(left_ts).cast("timestamp"))
    behind = here - F.unix_micros(F.col("_b._bts").cast("timestamp"))
    ahead = F.unix_micros(F.col("_fts").cast("timestamp")) - here
    use_back = F.col("_b").isNotNull() & (F.col("_fts").isNull() | (behind <= ahead))
    return both.select(
        *left.columns,
        F.when(use_back, F.col("_b._bts")).otherwise(F.col("_fts")).alias(matched_ts),
        *[F.when(use_back, F.col("_b")[v]).otherwise(F.col(v)).alias(v) for v in values],
    )


def hourly_spine(spans: DataFrame, start: Column, end: Column, name: str = "timestamp_utc") -> DataFrame:
    """One row per full hour from `start` to `end`; grows with the calendar span, not with ticks.

    A span makes hundreds of rows, so the spans are dealt to tasks by their number, not by their few bytes.
    """
    if (tasks := -(-spans.count() // SPANS_PER_TASK)) > 1:
        spans = spans.repartition(tasks)
    lo, hi = F.date_trunc("hour", start), F.date_trunc("hour", end)
    hours = F.when(lo <= hi, F.sequence(lo, hi, F.expr("INTERVAL 1 HOUR")))
    return spans.withColumn(name, F.explode(hours))
