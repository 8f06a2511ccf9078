"""Headline queries, wall-clock seconds with a warm session; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and local[n].
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

QUERIES = (
    "tick_daily_features",
    "ohlc_bars_hourly",
    "lagged_hourly_features",
    "despiked_prices",
    "downsampled_series",
    "asof_backward_strict",
    "hourly_price_spine",
    "decision_features",
    "nearest_close_forward",
    "trailing_dividend_sum",
    "best_source_dedupe",
    "monotone_call_curve",
    "isotonic_probabilities",
    "snapshot_weights",
    "training_weight_policy",
    "last_weeks_test_split",
    "walk_forward_folds",
    "split_metrics",
    "weight_distribution",
    "model_scoring",
    "top_edges",
)


def main() -> None:
    from strikelake import catalog
    from strikelake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    catalog.load_all()
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    times: dict[str, float] = {}
    for name in QUERIES if not only else only:
        best = None
        for _ in range(2):  # the first run warms code generation
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
