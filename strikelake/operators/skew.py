"""Skew-safe building blocks.

One key may own a third of the rows, so nothing here sends all rows of a key to one task:
* picking one row per key is an aggregate (`min_by`/`max_by`), combined before the shuffle;
* per-key totals are an aggregate joined back (the join side is splittable by AQE), not a window;
* order-sensitive work over an unbounded key runs per (key, slice of the order axis). What crosses
  a slice border is aggregated first to one row per (key, slice) and handed on by a window over
  those few rows.
Plain windows are used only over tables that are already unique per key and calendar step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY_MICROS = 86_400_000_000
# Width of a slice of the time axis: one hour keeps the share of even a very hot key small enough for
# one task (a third of 100 TB over ten years is a few hundred MB an hour).
SLICE_MICROS = 3_600_000_000


def pick_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """First (or last) row per key by `order`; ties beyond `order` must not matter to the caller."""
    rest = [c for c in df.columns if c not in set(keys)]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = (F.max_by if last else F.min_by)(F.struct(*rest), rank).alias("_row")
    out = df.groupBy(*keys).agg(best)
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def with_group_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach per-key aggregates. NULL keys form their own group, as with pandas dropna=False."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    right = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *aggs)
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cond = eq if cond is None else cond & eq
    return df.join(right, cond, "left").drop(*[f"_k_{k}" for k in keys])


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach a global aggregate (one row, or a histogram of fixed size) to every row."""
    return df.crossJoin(F.broadcast(scalars))


def time_slice(ts: Column, slice_micros: int = SLICE_MICROS) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(slice_micros)).cast("long")


def with_neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_col: Column, value: str
) -> DataFrame:
    """`prev_<value>` and `next_<value>` in `order` within the key, exact across slice borders."""
    keys, order = list(keys), list(order)
    base = df.withColumn("_s", slice_col)
    rank = F.struct(*order)
    edges = base.groupBy(*keys, "_s").agg(
        F.min_by(value, rank).alias("_head"), F.max_by(value, rank).alias("_tail")
    )
    over_slices = Window.partitionBy(*keys).orderBy("_s")
    edges = edges.select(
        *keys, "_s", F.lag("_tail").over(over_slices).alias("_before"), F.lead("_head").over(over_slices).alias("_after")
    )
    inside = Window.partitionBy(*keys, "_s").orderBy(*order)
    joined = base.join(edges, [*keys, "_s"])
    # Presence is tracked apart from the value: a stored NULL neighbour must stay NULL.
    first = F.row_number().over(inside) == 1
    final = F.lead(F.lit(1)).over(inside).isNull()
    return joined.select(
        *df.columns,
        F.when(first, F.col("_before")).otherwise(F.lag(value).over(inside)).alias(f"prev_{value}"),
        F.when(final, F.col("_after")).otherwise(F.lead(value).over(inside)).alias(f"next_{value}"),
    )


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], slice_col: Column, name: str = "position"
) -> DataFrame:
    """1-based row position within the key. `slice_col` must not decrease along `order`."""
    keys = list(keys)
    base = df.withColumn("_s", slice_col)
    sizes = base.groupBy(*keys, "_s").agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_s", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_s").orderBy(*order)
    return base.join(offsets, [*keys, "_s"]).select(
        *df.columns, (F.col("_off") + F.row_number().over(inside)).alias(name)
    )


def text_bucket(text: Column, hex_digits: int = 3) -> Column:
    """Even, order-preserving bucket of an md5 text: its leading hex digits."""
    return F.substring(text, 1, hex_digits)


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """0-based gap-free index over distinct keys, in md5 order; no single-task global sort."""
    distinct = df.select(key).distinct().withColumn("_h", F.md5(F.col(key).cast("string")))
    distinct = distinct.withColumn("_s", text_bucket(F.col("_h")))
    sizes = distinct.groupBy("_s").agg(F.count("*").alias("_n"))  # at most 16^3 rows
    run = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_s", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_s").orderBy("_h", key)
    return distinct.join(F.broadcast(offsets), "_s").select(
        key, (F.col("_off") + F.row_number().over(inside) - 1).cast("long").alias(name)
    )
