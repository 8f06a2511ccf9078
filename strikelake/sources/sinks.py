"""Sinks: appends with schema union, partition overwrite, histories and run outputs.

Data is clustered by partition value before the write, spread over `files` tasks per value, so one
hot date is neither one task nor thousands of small files.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F



def _clustered(df: DataFrame, partition_by: Sequence[str], spread: str | None, files: int) -> DataFrame:
    if not spread:
        return df
    return df.repartition(*[F.col(p) for p in partition_by], F.pmod(F.hash(spread), F.lit(files)))


def append(df: DataFrame, path: str, partition_by: Sequence[str], spread: str | None = None, files: int = 8) -> None:
    _clustered(df, partition_by, spread, files).write.mode("append").partitionBy(*partition_by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str], spread: str | None = None, files: int = 8) -> None:
    """Replace only the partitions present in `df`."""
    writer = _clustered(df, partition_by, spread, files).write.mode("overwrite").partitionBy(*partition_by)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def read_union(spark: SparkSession, path: str) -> DataFrame:
    """All appended batches under the union of their schemas."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_bars(bars: DataFrame, path: str, freq: str, replace: bool = False) -> None:
    """Bars by frequency and date; market is a sort column, not a directory level."""
    out = bars.withColumns({"freq": F.lit(freq), "date": F.to_date("timestamp_utc")}).where(F.col("timestamp_utc").isNotNull())
    out = _clustered(out, ["freq", "date"], "market_id", 4).sortWithinPartitions("freq", "date", "market_id", "timestamp_utc")
    writer = out.write.partitionBy("freq", "date")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)


def write_trades(trades: DataFrame, path: str) -> None:
    dated = trades.withColumn("date", F.to_date("timestamp_utc")).where(F.col("date").isNotNull())
    append(dated, path, ["date"], "trade_id")


def append_history(snapshot: DataFrame, path: str, contract_type: str) -> None:
    kind = "weekly" if contract_type.strip().lower() == "weekly" else "1dte"
    append(snapshot.withColumn("contract_type", F.lit(kind)), path, ["contract_type"])


def write_run_outputs(path: str, tables: Mapping[str, DataFrame]) -> None:
    """Small result tables of one run (metrics, composition, overlaps, weights, fold deltas)."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


