"""Figures that must not grow with the rows: what is written, and how often a plan works out the same thing."""

from __future__ import annotations

import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikelake.operators import chain, metrics, ranks, relational
from test_operators import frame, greedy_error


@pytest.mark.parametrize("kind", ["even", "nano"])
def test_weighted_bins_rank_only_rows_near_an_edge(spark, monkeypatch, kind):
    n = 20_000
    rng = np.random.default_rng(5)
    p = rng.integers(1, 12, n) / 12 if kind == "nano" else rng.random(n)
    y = (rng.random(n) < p).astype(int)
    w = rng.integers(0, 50, n)
    tie = [hashlib.md5(str(i).encode()).hexdigest() for i in range(n)]
    scale = 1e-9 if kind == "nano" else 1.0  # crowded values, and the last place that counts
    df = frame(spark, [(float(a), int(b), float(c) * scale, t) for a, b, c, t in zip(p, y, w, tie)], "p double, y int, w double, t string")
    written = []
    for module in (metrics, ranks):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda d, name="stage", keep=keep: (lambda out: (written.append(out.count()), out)[1])(keep(d, name)))
    got = metrics.ece_equal_mass(df, [], "y", "p", F.col("t"), 7, weight="w").first()["ece_q"]
    assert got == pytest.approx(greedy_error(p, y, w, tie, 7), abs=1e-9)
    assert max(written) < n * 0.8  # all rows were sorted and written twice


def test_snapshot_probability_filters_no_nested_case(spark, tmp_path):
    from strikelake import catalog

    catalog.load_all()
    day = dt.date(1996, 3, 4)
    rows = [(i, 1, 30 + 2 * (i % 9), 7, day, float(20 + i % 9), 0.04, 30_000.0 + i) for i in range(40)]
    rows += [(900, 1, 31, 8, day, 20.0, 0.04, 30_000.0)]  # a chain too thin for a curve
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double, l_discount double, l_extendedprice double"
    frame(spark, rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.QUERIES["snapshot_bracket_probability"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "lambda" in line]
    assert {r["ticker"] for r in out.collect()} == {7} and out.count() == 9


def test_scale_is_chosen_without_a_second_curve(spark):
    rows = [("a", "raw", 1.0, 3, 9), ("a", "raw", 2.0, 3, 9), ("a", "split_adj", 1.0, 3, 9), ("b", "raw", 1.0, 12, 5), ("b", "split_adj", 1.0, 11, 30)]
    rows += [("c", "split_adj", 1.0, 2, 3), ("c", "raw", 1.0, 2, 4), (None, "raw", 1.0, 2, 4)]
    banded = frame(spark, rows, "c string, spot_scale string, strike double, n_band_inside long, n_chain_used long")
    best = chain.choose_scale(banded, ["c"])
    assert sorted((r["c"], r["spot_scale"]) for r in best.collect()) == [("a", "split_adj"), ("b", "raw"), ("c", "raw")]
    assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString()


def test_backfill_reads_stored_rows_and_looks_for_added_ones_once(spark, tmp_path):
    from strikelake import catalog

    catalog.load_all()
    days = [dt.date(1996, 3, 4), dt.date(1997, 5, 6), dt.date(1999, 7, 8)]
    rows = [(i, 1, 30 + i % 9, 1 + i % 7, days[i % 3], 0.04, 0.02, "R", 20.0, 30_000.0 + i) for i in range(60)]
    rows += rows[:5]  # stored rows and added ones that come twice
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_discount double, l_tax double, l_returnflag string, l_quantity double, l_extendedprice double"
    frame(spark, rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.QUERIES["backfill_with_weights"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Every total used to work out all rows again, with its own reads of the source and its own anti join.
    reads = [line for line in plan.splitlines() if "Relation [" in line]
    assert "LeftAnti" not in plan and len([line for line in reads if "order_id" in line]) == 2 and len(reads) <= 4

    # The weights are those of the whole table weighted at once; an extra row whose id is stored (those of 1997) is dropped.
    whole = catalog.QUERIES["snapshot_weights"](spark, str(tmp_path)).collect()
    assert sorted(out.collect()) == sorted(whole) and len(whole) == 65


def test_backfill_keeps_stored_rows_on_equal_ids_and_repeats(spark):
    from strikelake.plans.datasets import backfill_dataset

    day, end = dt.date(2024, 1, 2), dt.date(2024, 1, 5)
    columns = "row_id string, ticker string, snapshot_date date, expiry_date date, K double, v int, weight_final double"
    old = frame(spark, [("a", "t", day, end, 1.0, 1, 9.0), ("b", "t", day, end, 2.0, 2, 9.0), ("b", "t", day, end, 2.0, 2, 9.0)], columns)
    new = frame(spark, [("a", "t", day, end, 1.0, 7, 9.0), ("c", None, day, end, 1.0, 3, 9.0), ("c", None, day, end, 1.0, 3, 9.0), (None, "u", day, end, 1.0, 4, 9.0)], columns)
    got = backfill_dataset(old, new, mode="sqrt_inv", beta=2.0, focus="u").collect()
    # Groups t (3 rows), UNKNOWN (2) and u (1): 1 / size, u twice; the mean over the 6 rows is (1 + 1 + 2) / 6.
    want = [("a", 1, 0.5), ("b", 2, 0.5), ("b", 2, 0.5), ("c", 3, 0.75), ("c", 3, 0.75), (None, 4, 3.0)]
    assert sorted((r["v"], r["row_id"], round(r["weight_final"], 9)) for r in got) == sorted((v, k, w) for k, v, w in want)


def test_candidates_of_all_keys_are_looked_at_in_one_row(spark):
    df = frame(spark, [(None, 1, "x")], "a string, b int, c string")
    assert relational.first_columns(df, (("a", "b"), ("no", "c"), ("a",), ()), with_values=True) == ["b", "c", None, None]
    assert relational.first_columns(df, (("a", "b"), ("no",))) == ["a", None] and relational.first_column(df, ("a", "b"), with_values=True) == "b"
