"""Plan shapes that matter at scale."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from strikelake.sources import readers, sinks
from strikelake.operators import bars
from strikelake.session import scratch_path
from strikelake.sources.tables import ticks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["price_history_slice"](spark, SF))
    assert "PushedFilters" in text
    scan = next(l for l in text.splitlines() if "events.parquet" in l or "ReadSchema" in l)
    assert "props" not in scan


def test_row_level_operators_have_no_nested_loops(spark):
    for name in ("asof_backward_exact", "nearest_close_forward", "despiked_prices", "hourly_price_spine", "decision_features"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text, name
        # Only one-row aggregates may be attached by a nested loop.
        assert text.count("BroadcastNestedLoopJoin") <= 1, name


def test_bar_scan_prunes_partitions(spark):
    path = scratch_path(spark, "bars")
    sinks.write_bars(bars.ohlc(ticks(spark, SF), "1d"), path, "1d")
    df = readers.scan_bars(spark, path, "1d", start="2024-01-10", end="2024-01-11")
    text = plan(df)
    assert "PartitionFilters: [isnotnull(freq" in text or "PartitionFilters: [isnotnull(date" in text
    assert df.select(F.min("date"), F.max("date")).first()[0].day == 10
