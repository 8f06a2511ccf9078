"""Streams over several small files equal their batch twins, and replays change nothing."""

import pytest
from pyspark.sql import functions as F

from strikelake.operators import bars
from strikelake.session import scratch_path
from strikelake.sources import sinks
from strikelake.sources.tables import ticks
from strikelake.streaming import ticks as ST
from strikelake.streaming.state import KeyedTable, newer_only_sink, newest_sink

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark):
    path = scratch_path(spark, "ticks")
    t = ticks(spark, SF)
    for i in range(4):
        t.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(path)
    return path


def test_bars_over_late_files_equal_batch(spark, folder):
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    ST.run_available(ST.bars(ST.read_stream(spark, folder, 1), delay="60 days"), ST.version_sink(out), ck)
    got = ST.current_rows(spark, out, ["market_id", "timestamp_utc"])
    want = bars.ohlc(spark.read.parquet(folder), "1h", fill_gaps=False).select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_restart_continues_from_the_checkpoint(spark, folder):
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    for _ in range(2):
        ST.run_available(ST.read_stream(spark, folder, 2).select("event_id"), ST.version_sink(out), ck, "append")
    rows = spark.read.parquet(out)
    assert rows.count() == spark.read.parquet(folder).count() == rows.select("event_id").distinct().count()


def test_newer_only_sink_is_monotone_per_key(spark, folder):
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    marks = KeyedTable(scratch_path(spark, "marks"), ("market_id",), 4)
    ST.run_available(ST.read_stream(spark, folder, 1), newer_only_sink(out, marks), ck, "append")
    rows = spark.read.parquet(out)
    per = rows.groupBy("market_id", "batch_id").agg(F.min("timestamp_utc").alias("lo"), F.max("timestamp_utc").alias("hi"))
    bad = per.alias("a").join(per.alias("b"), (F.col("a.market_id") == F.col("b.market_id")) & (F.col("a.batch_id") < F.col("b.batch_id")) & (F.col("a.hi") >= F.col("b.lo")))
    assert bad.count() == 0


def test_dynamic_overwrite_leaves_other_partitions(spark):
    path = scratch_path(spark, "parts")
    df = spark.range(10).select("id", (F.col("id") % 2).alias("p"))
    sinks.append(df, path, ["p"])
    sinks.overwrite_partitions(df.where("p = 1 and id < 4"), path, ["p"])
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4, 6, 8]


KEYED = "k string, t int, v string"
BATCHES = [[("a", 5, "x"), ("b", 7, "x"), ("c", 1, "x")], [("a", 4, "late"), ("a", 6, "y"), ("a", 7, "z")], [], [("b", 7, "same"), ("d", 1, "x"), (None, 3, "n")], [("a", 7, "again"), (None, 2, "late")]]


def newer_by_hand(high):
    high, out = dict(high), []
    for batch in BATCHES:
        out += [r for r in batch if r[0] not in high or r[1] > high[r[0]]]
        for k, t, _ in batch:
            high[k] = max(t, high.get(k, t))
    return sorted(map(str, out))


def test_newest_rows_are_merged_bucket_by_bucket(spark):
    table = KeyedTable(scratch_path(spark, "keyed"), ("k",), 3)
    sink, want, touched = newest_sink(table, ["t"]), {}, {}
    for i, batch in enumerate(BATCHES):
        df = spark.createDataFrame(batch, KEYED)
        for r in df.select("k", table.bucket().alias("b")).collect():
            touched[r["b"]] = i
        sink(df, i)
        sink(df, i)  # a replay changes nothing
        want |= {k: (t, v) for k, t, v in sorted(batch, key=lambda r: r[1])}
        assert table.versions(spark) == touched
    got = table.read(spark, KEYED)
    assert {r["k"]: (r["t"], r["v"]) for r in got.collect()} == want and got.count() == len(want)
    # One version of each bucket is read, whatever the number of batches.
    assert {f.split("version=")[1].split("/part")[0] for f in got.inputFiles()} == {f"{v}/bucket={b}" for b, v in touched.items()}


@pytest.mark.parametrize("seeded", [False, True])
def test_newer_only_reads_high_marks_alone(spark, seeded):
    out, table = scratch_path(spark, "newer"), KeyedTable(scratch_path(spark, "marks"), ("k",), 3)
    seed = spark.createDataFrame([("a", 5, "s"), ("e", 9, "s"), ("a", 2, "s")], KEYED) if seeded else None
    sink = newer_only_sink(out, table, "t", seed)
    for i, batch in enumerate(BATCHES):
        df = spark.createDataFrame(batch, KEYED)
        sink(df, i)
        sink(df, i)
    got = sorted(str((r["k"], r["t"], r["v"])) for r in spark.read.parquet(out).collect())
    unseen = {(None, 3, "n"), (None, 2, "late")}  # NULL keys equal nothing that is stored and always pass
    want = newer_by_hand({"a": 5, "e": 9} if seeded else {})
    assert got == sorted({*want, *map(str, unseen)})


def test_hourly_bars_over_late_files_are_upserted(spark, folder):
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    rows, table = ST.bars(ST.read_stream(spark, folder, 1), delay="60 days"), KeyedTable(out, ("market_id", "timestamp_utc"), 4)
    ST.run_available(rows, newest_sink(table), ck, partitions=3)
    want = bars.ohlc(spark.read.parquet(folder), "1h", fill_gaps=False).select(rows.columns)
    got = table.read(spark, rows.schema)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and len(table.versions(spark)) == 4
