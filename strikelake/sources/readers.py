"""Scans: by suffix, of benchmark datasets, of partitioned bars, of price histories, of raw payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from strikelake.functions.calendar import asof_time, close_time_utc
from strikelake.functions.scalar import to_number
from strikelake.operators.relational import first_column, keep_last, restrict_to

# Column candidates of benchmark datasets, first present wins.
EXPIRY_COLUMNS = ("expiry_date", "option_expiration_used", "expiry_close_date_used", "option_expiration_requested")
ASOF_STAMPS = ("asof_ts", "asof_time", "asof_datetime")
ASOF_DATES = ("asof_date", "asof_target")


def read_dataset(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet or CSV by suffix; a parquet path that cannot be opened falls back to its CSV twin."""
    def csv(p: str) -> DataFrame:
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
        return reader.schema(schema).csv(p) if schema else reader.option("inferSchema", True).csv(p)

    if not path.endswith(".parquet"):
        return csv(path)
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException:
        return csv(path[: -len(".parquet")] + ".csv")


def scan_benchmark(
    df: DataFrame,
    values: Sequence[str],
    *,
    tickers: DataFrame | None = None,
    thresholds: DataFrame | None = None,
    expiries: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    zone: str = "America/New_York",
    close_time: str = "16:00:00",
) -> DataFrame:
    """Benchmark probabilities keyed by (ticker, threshold, expiry, snapshot date), newest as-of per key.

    Only the needed columns are read; the date range is a plain predicate on the stored column, so it
    reaches the scan; key sets are semi joins.
    """
    expiry = first_column(df, EXPIRY_COLUMNS)
    stamp, day = first_column(df, ASOF_STAMPS), first_column(df, ASOF_DATES)
    if not expiry or not (stamp or day):
        raise ValueError("benchmark dataset needs an expiry and an as-of column")
    rows = df.select("ticker", "K", expiry, *[c for c in (stamp, day) if c], *[v for v in values if v in df.columns])
    coarse = day or stamp
    # A stamp may fall on the next UTC day, so the pushed range is one day wider than the exact one below.
    if start:
        rows = rows.where(F.col(coarse).cast("date") >= F.date_sub(F.lit(start).cast("date"), 1))
    if end:
        rows = rows.where(F.col(coarse).cast("date") <= F.date_add(F.lit(end).cast("date"), 1))
    rows = rows.withColumns(
        {
            "ticker": F.upper("ticker"), "threshold": F.round(to_number(F.col("K")), 6),
            "expiry_date": F.to_date(F.col(expiry).try_cast("timestamp")),
        }
    )
    sets = {"ticker": tickers, "threshold": thresholds, "expiry_date": expiries}
    rows = restrict_to(rows, **{k: v for k, v in sets.items() if v is not None})
    if stamp:
        rows = asof_time(rows, stamp, zone, close_time)
    else:
        rows = rows.withColumn("asof_time", close_time_utc(F.to_date(day), zone, close_time))
    rows = rows.withColumn("snapshot_date", F.to_date("asof_time"))
    if start:
        rows = rows.where(F.col("snapshot_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("snapshot_date") <= F.lit(end).cast("date"))
    key = ["ticker", "threshold", "expiry_date", "snapshot_date"]
    have = [v for v in values if v in df.columns]
    rows = rows.select(*key, "asof_time", *have).dropna(subset=["ticker", "threshold", "expiry_date", "asof_time"])
    return keep_last(rows, key, ["asof_time", *have])


def scan_bars(
    spark: SparkSession, path: str, freq: str, markets: DataFrame | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Bars of one frequency and date range: partition pruning on freq and date, then a market semi join."""
    bars = _in_range(spark.read.option("mergeSchema", True).parquet(path), freq, start, end)
    return _clean_bars(bars, markets)


def _in_range(df: DataFrame, freq: str, start: str | None, end: str | None) -> DataFrame:
    out = df.where(F.col("freq") == freq)
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def _clean_bars(bars: DataFrame, markets: DataFrame | None) -> DataFrame:
    if markets is not None:
        bars = restrict_to(bars, market_id=markets)
    bars = bars.withColumn("close", to_number(F.col("close"))).dropna(subset=["market_id", "timestamp_utc", "close"])
    return keep_last(bars, ["market_id", "timestamp_utc"], ["close"])


def scan_bars_counted(
    spark: SparkSession, path: str, schema: StructType | str, freq: str, markets: DataFrame | None = None, start: str | None = None, end: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(bars, one row `files`, `skipped_files`): files that cannot be read are passed over and counted.

    `schema` holds the data columns, so no footer is needed to plan. Skipped are the files of the range that are listed but give
    no row, files of no rows among them; a file broken behind its first rows keeps those rows. The listing reads no contents.
    """
    read = _in_range(spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path), freq, start, end)
    listed = _in_range(spark.read.format("binaryFile").load(path), freq, start, end).select(F.col("_metadata.file_path").alias("file"))
    seen = read.select(F.col("_metadata.file_path").alias("file"), F.lit(True).alias("_seen")).distinct()
    counted = listed.join(seen, "file", "left").agg(F.count("*").alias("files"), F.count_if(F.col("_seen").isNull()).alias("skipped_files"))
    return _clean_bars(read, markets), counted


def read_checked_csv(spark: SparkSession, path: str, schema: StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, one-row count of lines that did not parse)."""
    wide = StructType(list(schema.fields)).add("_bad", StringType())
    reader = spark.read.schema(wide).option("header", header).option("columnNameOfCorruptRecord", "_bad")
    raw = reader.csv(path)
    # A field is only parsed, and so only found bad, when the query needs it: this test, always true,
    # keeps every column in view.
    parsed = F.concat_ws("", *[F.col(c).cast("string") for c in schema.names]) >= ""
    bad = F.col("_bad").isNotNull()
    return raw.where(~bad & parsed).drop("_bad"), raw.agg(F.count_if(bad & parsed).alias("bad_lines"))


def price_slice(
    ticks: DataFrame, markets: DataFrame | None, roles: Sequence[str], start: Column | None = None, end: Column | None = None
) -> DataFrame:
    out = ticks.where(F.lower("token_role").isin([r.lower() for r in roles]))
    if start is not None:
        out = out.where(F.col("timestamp_utc") >= start)
    if end is not None:
        out = out.where(F.col("timestamp_utc") <= end)
    return restrict_to(out, market_id=markets) if markets is not None else out


def normalize_trades(trades: DataFrame) -> DataFrame:
    """Landed trades to typed fills; epoch seconds to UTC, side in lower case."""
    seconds = F.col("timestamp").try_cast("double")
    return trades.select(
        F.col("id").alias("trade_id"), F.col("blockNumber").try_cast("bigint").alias("block_number"),
        F.timestamp_micros((seconds * 1e6).cast("bigint")).alias("timestamp_utc"), F.col("marketId").alias("market_id"),
        F.col("outcomeTokenId").alias("outcome_token_id"), to_number(F.col("price")).alias("price"), to_number(F.col("size")).alias("size"),
        F.lower("side").alias("side"), F.col("transactionHash").alias("tx_hash"),
    )


def flatten_price_payload(payloads: DataFrame, body: str = "payload", token: str = "token_id") -> DataFrame:
    """`{"history":[{"t":seconds,"p":price}]}` to ticks; prices outside [0,1] are dropped."""
    parsed = payloads.select(token, F.from_json(body, "history ARRAY<STRUCT<t: STRING, p: STRING>>").alias("_j"))
    points = parsed.select(token, F.inline("_j.history"))
    price, seconds = to_number(F.col("p")), F.col("t").try_cast("double")
    return points.select(
        token, F.timestamp_micros((seconds * 1e6).cast("bigint")).alias("timestamp_utc"), price.alias("price")
    ).where(F.col("price").between(0.0, 1.0) & F.col("timestamp_utc").isNotNull())


def preview(df: DataFrame, order: Sequence[Column], n: int, tail: bool = False) -> DataFrame:
    """First or last n rows in a given order (a top-n sort, not a full one). `order` is ascending."""
    keys = [o.desc() for o in order] if tail else [o.asc() for o in order]
    return df.orderBy(*keys).limit(n)
