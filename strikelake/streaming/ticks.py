"""Incremental jobs as Structured Streaming: cleaning, bars, enrichment, upserts, quarantine.

Sinks keep every micro-batch under its own batch id and readers take the newest version of a key. A
replayed batch overwrites its own folder only, so the result is the same after any restart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strikelake.operators.skew import pick_row
from strikelake.session import configure


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of a parquet table; the schema is taken from the table, times become UTC instants."""
    configure(spark)
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # A glob lets the table be one file or a folder of files; a plain path must be a folder.
    df = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])


def clean(ticks: DataFrame, keys: Sequence[str], delay: str = "1 hour", ts: str = "timestamp_utc") -> DataFrame:
    """Prices inside [0,1], one tick per key and time; duplicates within the watermark are dropped."""
    valid = ticks.where(F.col("price").between(0.0, 1.0))
    return valid.withWatermark(ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def bars(ticks: DataFrame, width: str = "1 hour", delay: str = "1 hour", ts: str = "timestamp_utc", tie: str = "event_id") -> DataFrame:
    """Continuous OHLC; append mode emits a bar once it is final, update mode on every change."""
    order = F.struct(ts, tie)
    g = ticks.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("_w"), "market_id").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close")
    )
    return g.select(F.col("_w.start").alias(ts), "market_id", "open", "high", "low", "close")


def validity(
    table: DataFrame, keys: Sequence[str], asof: str, until: Column, day: str = "valid_day"
) -> DataFrame:
    """Daily benchmark rows as intervals [asof, next asof), one copy per calendar day they cover.

    With the day as an equality key the stream join compares a tick with one or two rows only.
    """
    order = Window.partitionBy(*keys).orderBy(asof)
    span = table.withColumn("valid_to", F.coalesce(F.lead(asof).over(order), until))
    days = F.when(F.to_date(asof) <= F.to_date("valid_to"), F.sequence(F.to_date(asof), F.to_date("valid_to"), F.expr("INTERVAL 1 DAY")))
    return span.withColumn(day, F.explode(days)).withColumnRenamed(asof, "valid_from")


def enrich(ticks: DataFrame, intervals: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "timestamp_utc") -> DataFrame:
    """Latest strictly earlier benchmark for each tick: a stream-static join, no state."""
    right = intervals.select(*keys, "valid_day", "valid_from", "valid_to", *values)
    dated = ticks.withColumn("valid_day", F.to_date(ts))
    cond = [dated[k] == right[k] for k in [*keys, "valid_day"]]
    cond += [dated[ts] > right["valid_from"], dated[ts] <= right["valid_to"]]
    joined = dated.join(right, cond, "left")
    return joined.select(*[dated[c] for c in ticks.columns], right["valid_from"].alias("asof_time"), *[right[v] for v in values])


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", partitions: int | None = None) -> None:
    """Process what is there and stop (the scheduled form of the job).

    The number of state stores is fixed by a stream's first run: `partitions`, or the cores at hand instead of a default
    meant for batch shuffles.
    """
    spark = df.sparkSession
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(partitions or spark.sparkContext.defaultParallelism))
    try:
        query = (
            df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
        )
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()


def version_sink(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def current_rows(spark: SparkSession, path: str, keys: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """Newest version of every key over all batches."""
    rows = spark.read.parquet(path)
    return pick_row(rows, list(keys), [F.col("batch_id"), *[F.col(t) for t in tiebreak]], last=True).drop("batch_id")


def quarantine_sink(good_path: str, bad_path: str, ok: Column) -> Callable[[DataFrame, int], None]:
    """Rows that break the leak rule go to a side table instead of stopping the stream."""

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumn("_ok", F.coalesce(ok, F.lit(False)))
        marked.where("_ok").drop("_ok").write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
        marked.where(~F.col("_ok")).drop("_ok").write.mode("overwrite").parquet(f"{bad_path}/batch_id={batch_id}")

    return write
