"""Base tables and the domain views derived from them (each also given as portable SQL)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampNTZType

from strikelake.session import configure


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table with zone-less times read as UTC instants."""
    configure(spark)
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    local = {f.name for f in df.schema if isinstance(f.dataType, TimestampNTZType)}
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in local else F.col(c) for c in df.columns])


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price ticks in [0,1] per market; `event_id` settles equal times."""
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("market_id"),
        F.col("ts").alias("timestamp_utc"),
        (F.least(F.col("value"), F.lit(400.0)) / 400.0).alias("price"),
        F.when(F.col("event_type").isin("view", "click", "purchase"), "yes").otherwise("no").alias("token_role"),
        F.concat(F.lit("T"), (F.col("user_id") % 10).cast("string")).alias("ticker"),
        ((F.col("user_id") % 20) * 5).cast("double").alias("threshold"),
        "event_type",
    )


TICKS = """ticks AS (
SELECT event_id, user_id AS market_id, ts AS timestamp_utc, least(value, 400.0) / 400.0 AS price,
       CASE WHEN event_type IN ('view','click','purchase') THEN 'yes' ELSE 'no' END AS token_role,
       concat('T', CAST(user_id % 10 AS VARCHAR)) AS ticker,
       CAST((user_id % 20) * 5 AS DOUBLE) AS threshold, event_type
FROM events)"""


def dim_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "events")
        .select(F.col("user_id").alias("market_id"))
        .distinct()
        .select(
            "market_id",
            F.concat(F.lit("T"), (F.col("market_id") % 10).cast("string")).alias("ticker"),
            ((F.col("market_id") % 20) * 5).cast("double").alias("threshold"),
            F.date_add(F.lit("2024-01-05").cast("date"), (7 * (F.col("market_id") % 4)).cast("int")).alias("expiry_date"),
        )
    )


DIM_MARKET = """dim_market AS (
SELECT DISTINCT user_id AS market_id, concat('T', CAST(user_id % 10 AS VARCHAR)) AS ticker,
       CAST((user_id % 20) * 5 AS DOUBLE) AS threshold,
       CAST(DATE '2024-01-05' + CAST(7 * (user_id % 4) AS INT) AS DATE) AS expiry_date
FROM events)"""


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "orders")
        .groupBy((F.col("o_custkey") % 10).alias("ticker"), F.to_date("o_orderdate").alias("date"))
        .agg(F.max("o_totalprice").alias("close"))
    )


CLOSES = """closes AS (
SELECT o_custkey % 10 AS ticker, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS close
FROM orders GROUP BY 1, 2)"""


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "orders")
        .where(F.col("o_orderstatus") == "F")
        .select(
            (F.col("o_custkey") % 10).alias("ticker"),
            F.to_date("o_orderdate").alias("date"),
            (F.col("o_orderkey") % 100 / F.lit(64.0)).alias("amount"),
        )
    )


# Multiples of 1/64 add up exactly in floating point, whatever the order.
DIVIDENDS = """dividends AS (
SELECT o_custkey % 10 AS ticker, CAST(o_orderdate AS DATE) AS date, (o_orderkey % 100) / 64.0::DOUBLE AS amount
FROM orders WHERE o_orderstatus = 'F')"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "part")
        .where(F.col("p_size") > 45)
        .select(
            (F.col("p_partkey") % 10).alias("ticker"),
            F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 2400).cast("int")).alias("date"),
            F.when(F.col("p_partkey") % 3 == 0, 2.0).otherwise(0.5).alias("ratio"),
        )
    )


SPLITS = """splits AS (
SELECT p_partkey % 10 AS ticker, CAST(DATE '1995-01-01' + CAST(p_partkey % 2400 AS INT) AS DATE) AS date,
       CASE WHEN p_partkey % 3 = 0 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS ratio
FROM part WHERE p_size > 45)"""


def option_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of chains (ticker, asof_date); spot 100, several raw quotes may share a strike."""
    k = F.col("l_partkey") % 81
    base = F.greatest(F.lit(40.0) - k, F.lit(0.0)) + F.col("l_quantity") / 10.0
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"),
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("asof_date"),
        (F.lit(60) + k).cast("double").alias("strike"),
        base.alias("bid"),
        (base + F.col("l_discount") * 10.0 + 0.05).alias("ask"),
        (F.col("l_extendedprice") / 1000.0).alias("close"),
        F.col("l_quantity").alias("volume"),
        F.col("l_linenumber").alias("cnt"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
    )


QUOTES = """option_quotes AS (
SELECT l_suppkey AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS asof_date,
       CAST(60 + l_partkey % 81 AS DOUBLE) AS strike,
       greatest(40.0::DOUBLE - l_partkey % 81, 0.0::DOUBLE) + l_quantity / 10.0 AS bid,
       greatest(40.0::DOUBLE - l_partkey % 81, 0.0::DOUBLE) + l_quantity / 10.0 + l_discount * 10.0 + 0.05 AS ask,
       l_extendedprice / 1000.0 AS close, l_quantity AS volume, l_linenumber AS cnt, l_orderkey, l_linenumber,
       l_partkey, l_extendedprice
FROM lineitem)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored binary rows with groups (orders), tickers (suppliers) and dates."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("group_id"),
        "l_linenumber",
        "l_partkey",
        F.col("l_suppkey").alias("ticker"),
        F.to_date("l_shipdate").alias("asof_date"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("l_discount") - 0.05) * 40.0))).alias("p_model"),
        (F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("l_tax") - 0.04) * 30.0))).alias("p_base"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.col("l_quantity").alias("w"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


LABELLED = """labelled AS (
SELECT l_orderkey AS group_id, l_linenumber, l_partkey, l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS asof_date,
       1.0 / (1.0 + exp(-(l_discount - 0.05) * 40.0)) AS p_model,
       1.0 / (1.0 + exp(-(l_tax - 0.04) * 30.0)) AS p_base,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS w, l_extendedprice AS price,
       l_discount AS discount, l_tax AS tax
FROM lineitem)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market titles and slugs in several spellings, one per part."""
    key = F.col("p_partkey")
    t = F.concat(F.lit("T"), (key % 10).cast("string"))
    day = (1 + key % 28).cast("string")
    size = F.col("p_size").cast("string")
    return load(spark, sf_dir, "part").select(
        key.alias("market_id"),
        F.concat(F.lit("c"), (key % 700).cast("string")).alias("condition_id"),
        F.when(key % 5 == 0, F.concat(F.lit("Will Apple close above "), size, F.lit(" on Feb "), day, F.lit("th 2024?")))
        .when(key % 5 == 1, F.concat(F.lit("Will it finish week ending March "), day, F.lit(", 2024 above $1,"), F.lpad(size, 3, "0"), F.lit(".5?")))
        .when(key % 5 == 2, F.concat(F.lit("Up or down by "), size))
        .otherwise(F.concat(F.lit("Will "), t, F.lit(" finish week of January "), day, F.lit(", 2024 above $"), size, F.lit("?")))
        .alias("question"),
        F.when(key % 7 == 0, F.concat(F.lit("other-"), size))
        .otherwise(F.concat(F.lower(t), F.lit("-above-on-january-"), day, F.lit("-2024")))
        .alias("slug"),
        F.when(key % 4 == 0, (F.lit(1_704_067_200) + key * 3600).cast("string"))
        .when(key % 4 == 1, ((F.lit(1_704_067_200) + key * 3600) * 1000).cast("string"))
        .when(key % 4 == 2, F.lit("2024-02-03 04:05:06"))
        .alias("resolved_time"),
        F.when(key % 6 == 0, F.lit("not a list"))
        .otherwise(F.concat(F.lit('["y'), key.cast("string"), F.lit('","n'), key.cast("string"), F.lit('"]')))
        .alias("token_ids"),
    )


TITLES = """titles AS (
SELECT p_partkey AS market_id, concat('c', CAST(p_partkey % 700 AS VARCHAR)) AS condition_id,
       CASE WHEN p_partkey % 5 = 0 THEN concat('Will Apple close above ', CAST(p_size AS VARCHAR), ' on Feb ', CAST(1 + p_partkey % 28 AS VARCHAR), 'th 2024?')
            WHEN p_partkey % 5 = 1 THEN concat('Will it finish week ending March ', CAST(1 + p_partkey % 28 AS VARCHAR), ', 2024 above $1,', lpad(CAST(p_size AS VARCHAR), 3, '0'), '.5?')
            WHEN p_partkey % 5 = 2 THEN concat('Up or down by ', CAST(p_size AS VARCHAR))
            ELSE concat('Will T', CAST(p_partkey % 10 AS VARCHAR), ' finish week of January ', CAST(1 + p_partkey % 28 AS VARCHAR), ', 2024 above $', CAST(p_size AS VARCHAR), '?') END AS question,
       CASE WHEN p_partkey % 7 = 0 THEN concat('other-', CAST(p_size AS VARCHAR))
            ELSE concat('t', CAST(p_partkey % 10 AS VARCHAR), '-above-on-january-', CAST(1 + p_partkey % 28 AS VARCHAR), '-2024') END AS slug,
       CASE p_partkey % 4 WHEN 0 THEN CAST(1704067200 + p_partkey * 3600 AS VARCHAR)
            WHEN 1 THEN CAST((1704067200 + p_partkey * 3600) * 1000 AS VARCHAR)
            WHEN 2 THEN '2024-02-03 04:05:06' END AS resolved_time,
       CASE WHEN p_partkey % 6 = 0 THEN 'not a list'
            ELSE concat('["y', CAST(p_partkey AS VARCHAR), '","n', CAST(p_partkey AS VARCHAR), '"]') END AS token_ids
FROM part)"""
