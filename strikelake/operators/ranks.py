"""Running sums over an unbounded order, by a range-partitioned prefix scan.

The rows are dealt by sampled splitters of (keys, order), so that neighbours lie in one partition whatever their distribution;
each partition and key sends one sum, whose prefix sums are handed back, and the rest of the scan stays within a partition.
A hot key spreads over many partitions. Rows equal in keys and order do not: callers count equal values first, or
end the order with a tie-break column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelake.operators.skew import with_scalars
from strikelake.session import materialize


def with_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, name: str, total: str | None = None) -> DataFrame:
    """Adds `name`, the sum of `amount` up to and with the row in ascending `order` within its keys, and the keys' `total`.

    Integers and decimals give exact sums, doubles one that depends on where partitions end.
    """
    keys, order = list(keys), list(order)
    dealt = df.withColumn("_amount", amount).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = materialize(dealt, "ranked")  # the numbers of partitions must be the same in both passes
    sums = dealt.groupBy("_part", *keys).agg(F.sum("_amount").alias("_sum"))
    over = Window.partitionBy(*(keys or [F.lit(0)]))  # a row for each partition of a key
    before = F.sum("_sum").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_k_{k}") for k in keys], before.alias("_before"), F.sum("_sum").over(over).alias("_total"))
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.coalesce("_before", F.lit(0)) + F.sum("_amount").over(inside)
    return dealt.join(sums, same).select(*df.columns, upto.alias(name), *([F.col("_total").alias(total)] if total else []))


def split_at_fraction(df: DataFrame, order: Sequence[str], fraction: float, least_tail: int = 0) -> tuple[DataFrame, DataFrame]:
    """(head, tail) by position in `order`: the first max(1, floor(n * fraction)) rows, fewer if the tail needs `least_tail`."""
    ranked = with_running_sum(df, [], order, F.lit(1).cast("long"), "_pos", "_n")
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))
    cut = F.when(cut > F.col("_n") - least_tail, F.greatest(F.lit(0), F.col("_n") - least_tail)).otherwise(cut)
    return ranked.where(F.col("_pos") <= cut).select(*df.columns), ranked.where(F.col("_pos") > cut).select(*df.columns)


def values_at_ranks(counted: DataFrame, ranks: DataFrame, keys: Sequence[str], value: str, count: str) -> DataFrame:
    """(keys..., _rank, `value`): which of the counted distinct values stands at each 0-based rank of its keys' order.

    `ranks` has few ranks for each key.
    """
    keys = list(keys)
    placed = with_running_sum(counted.select(*keys, value, count), keys, [value], F.col(count), "_upto")
    wanted = ranks.groupBy(*keys).agg(F.collect_set("_rank").alias("_ranks"))
    both = placed.join(wanted, keys) if keys else with_scalars(placed, wanted)
    hit = F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col(count)))
    return both.select(*keys, F.explode(hit).alias("_rank"), value)
