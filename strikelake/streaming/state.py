"""Keyed tables that streams keep up to date: one row per key, in hash buckets, of which a batch reads and writes only its own.

A batch writes the buckets it touches whole, as a new version, and then a map from buckets to versions. Readers follow the
newest map, so a table is always read from one version of each bucket and no batch reads what earlier ones appended. A batch that
is replayed starts from the map of the batch before it and overwrites its own version: the result is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strikelake.operators.skew import pick_row

#: The version that a table starts from, before any batch.
SEED = -1


@dataclass(frozen=True)
class KeyedTable:
    """Rows of unique `keys` under `path`; the number of buckets bounds what the driver keeps and stays as it is."""

    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def versions(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """Bucket -> version by the newest map, or the newest of a batch ahead of `before`."""
        try:
            maps = spark.read.parquet(f"{self.path}/maps")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        if before is not None:
            maps = maps.where(F.col("batch") < before)
        newest = maps.agg(F.max_by("map", "batch").alias("map")).first()["map"]
        return dict(newest or {})

    def read(self, spark: SparkSession, schema, before: int | None = None, touched: Sequence[int] | None = None) -> DataFrame:
        """The table's rows, of the buckets `touched` if given."""
        versions = self.versions(spark, before)
        paths = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items()) if touched is None or b in set(touched)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, batch: int) -> None:
        """`rows` are the whole buckets they lie in."""
        spark = rows.sparkSession
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/version={batch}")
        written = {r["bucket"]: batch for r in spark.read.parquet(f"{self.path}/rows/version={batch}").select("bucket").distinct().collect()} if not rows.isEmpty() else {}
        versions = {**self.versions(spark, batch), **written}
        one = spark.createDataFrame([(batch, versions)], "batch int, map map<int,int>")
        one.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/maps/of={batch}")

    def merge(self, batch: DataFrame, batch_id: int, combine: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Puts the batch's rows into the table; `combine` gives one row per key of old and new rows. Returns the old rows met."""
        spark, schema = batch.sparkSession, batch.schema
        touched = [r["b"] for r in batch.select(self.bucket().alias("b")).distinct().collect()]  # at most `buckets`
        old = self.read(spark, schema, batch_id, touched)
        if touched:
            self.write(combine(old.unionByName(batch)).select(*batch.columns), batch_id)
        return old


def newest_sink(table: KeyedTable, order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Keeps the newest row of every key: of the latest batch, and within it the largest by `order`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("batch_of", F.lit(batch_id).cast("long")).persist()
        try:
            table.merge(stamped, batch_id, lambda both: pick_row(both, table.keys, [F.col("batch_of"), *[F.col(o) for o in order]], last=True))
        finally:
            stamped.unpersist()

    return write


def newer_only_sink(path: str, table: KeyedTable, ts: str = "timestamp_utc", seed: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Appends the rows later than all that earlier batches (and the seed) hold for their key, under one folder per batch.

    `table` holds the highest time of every key; unseen keys pass whole, and rows of one batch don't hold each other back.
    """
    highest = lambda rows: rows.groupBy(*table.keys).agg(F.max(ts).alias(ts))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if seed is not None and not table.versions(spark, 0):
            table.write(highest(seed.select(*table.keys, ts)), SEED)
        held = batch.persist()
        try:
            touched = [r["b"] for r in held.select(table.bucket().alias("b")).distinct().collect()]
            marks = highest(held)
            old = table.read(spark, marks.schema, batch_id, touched).withColumnRenamed(ts, "_high")
            fresh = held.join(old, list(table.keys), "left").where(F.col("_high").isNull() | (F.col(ts) > F.col("_high"))).select(*held.columns)
            fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            table.merge(marks, batch_id, highest)
        finally:
            held.unpersist()

    return write
