"""Exact linear-interpolation percentiles of unbounded groups.

`percentile` keeps every distinct value of a group in one task's memory. Here equal values are first counted (combined before
the shuffle), and a prefix scan over the ordered distinct values finds those at the wanted ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strikelake.operators.ranks import values_at_ranks


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(groups..., prob, value) with numpy's default interpolation between neighbouring ranks."""
    g = list(groups)
    counted, total = _counted(df, g, value)
    # Wanted 0-based ranks: floor and ceiling of p * (n - 1).
    pos = F.col("_p") * (F.col("_n") - 1)
    want = total.select(*g, "_n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("_p"))
    want = want.select(*g, "_p", pos.alias("_pos"), F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos)))).alias("_rank"))
    at_rank = values_at_ranks(counted, want.select(*g, "_rank"), g, "_v", "_c")
    both = want.join(at_rank, [*g, "_rank"])
    lo, hi = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    frac = F.max(F.col("_pos") - F.floor("_pos"))
    return both.groupBy(*g, F.col("_p").alias("prob")).agg((lo + (hi - lo) * frac).alias("value"))


def value_at_fraction(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """One row: the value at 0-based position floor(n * fraction) in sorted order."""
    counted, total = _counted(df, [], value)
    want = total.select(F.floor(F.col("_n") * fraction).alias("_rank"))
    return values_at_ranks(counted, want, [], "_v", "_c").select(F.col("_v").alias("value"))


def _counted(df: DataFrame, g: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    counted = df.where(F.col(value).isNotNull()).groupBy(*g, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    total = counted.groupBy(*g).agg(F.sum("_c").alias("_n"))
    return counted, total if g else total.where(F.col("_n").isNotNull())


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, median): all columns in one tall pass."""
    tall = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x")) for c in columns])))
    return exact_percentiles(tall, ["column"], "_x", [0.5]).select("column", F.col("value").alias("median"))
