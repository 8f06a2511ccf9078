"""Hand-made edge rows and brute-force comparisons."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strikelake.functions import calendar as cal, features, scalar, text
from strikelake.operators import asof, bars, bootstrap, chain, lookups, metrics, quality, relational, skew, splits, weights
from strikelake.operators.percentiles import exact_percentiles

D = dt.datetime


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def asof_brute(left, right, exact, forward=False):
    out = {}
    for i, k, t in left:
        ok = [(rt, tie, v) for rk, rt, tie, v in right if rk == k and (
            (rt >= t if forward else rt <= t) if exact else (rt > t if forward else rt < t))]
        out[i] = (min if forward else max)(ok, default=(None, None, None))[2]
    return out


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join_equals_brute_force_with_a_hot_key(spark, exact, direction):
    rng = np.random.default_rng(3)
    base = D(2024, 1, 1)
    key = lambda: "hot" if rng.random() < 0.5 else f"k{rng.integers(5)}"
    at = lambda: base + dt.timedelta(hours=int(rng.integers(24 * 40)))
    left = [(i, key(), at()) for i in range(300)]
    right = [(key(), at(), i, float(i)) for i in range(200)]
    out = asof.asof_join(
        frame(spark, left, "i int, k string, t timestamp"), frame(spark, right, "k string, rt timestamp, tie int, v double"), ["k"], "t", "rt", ["v"],
        exact=exact, direction=direction, tiebreak=["tie"], slice_micros=skew.DAY_MICROS * 3,
    ).collect()
    assert len(out) == 300
    assert {r["i"]: r["v"] for r in out} == asof_brute(left, right, exact, direction == "forward")


def test_asof_keeps_left_rows_without_match_and_null_keys(spark):
    left = frame(spark, [(1, "a", D(2024, 1, 1)), (2, None, D(2024, 1, 5)), (3, "b", None)], "i int, k string, t timestamp")
    right = frame(spark, [("a", D(2024, 1, 2), 1.0), (None, D(2024, 1, 1), 2.0)], "k string, rt timestamp, v double")
    out = {r["i"]: r["v"] for r in asof.asof_join(left, right, ["k"], "t", "rt", ["v"]).collect()}
    assert out == {1: None, 2: None, 3: None}


def test_asof_tolerance(spark):
    left = frame(spark, [(1, "a", D(2024, 1, 10)), (2, "a", D(2024, 1, 4))], "i int, k string, t timestamp")
    right = frame(spark, [("a", D(2024, 1, 3), 7.0)], "k string, rt timestamp, v double")
    out = asof.asof_join(left, right, ["k"], "t", "rt", ["v"], tolerance_micros=2 * skew.DAY_MICROS)
    assert {r["i"]: r["v"] for r in out.collect()} == {1: None, 2: 7.0}


def test_neighbours_cross_slices_and_keep_null_values(spark):
    rows = [("a", D(2024, 1, d), v) for d, v in ((1, 1.0), (2, None), (5, 3.0), (9, 4.0))]
    df = frame(spark, rows, "k string, t timestamp, v double")
    out = skew.with_neighbours(df, ["k"], ["t"], skew.time_slice(F.col("t")), "v").orderBy("t").collect()
    assert [r["prev_v"] for r in out] == [None, 1.0, None, 3.0]
    assert [r["next_v"] for r in out] == [None, 3.0, 4.0, None]


def test_positions_are_dense_across_slices(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id"))
    out = skew.with_position(df, ["k"], ["id"], F.floor(F.col("id") / 37))
    assert out.where(F.col("position") != F.col("id") + 1).count() == 0


def test_dense_index_has_no_gaps(spark):
    df = spark.range(5000).select((F.col("id") % 777).cast("string").alias("g"))
    out = sorted(r["idx"] for r in skew.dense_index(df, "g").collect())
    assert out == list(range(777))


@pytest.mark.parametrize("kind", ["uniform", "heavy", "ties", "single", "wide", "crowded"])
def test_exact_percentiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(5)
    x = {
        "uniform": rng.random(997), "heavy": np.exp(rng.normal(0, 6, 800)), "ties": rng.integers(0, 4, 600).astype(float), "single": np.array([2.5]),
        "wide": np.concatenate([rng.normal(0, 1e-9, 500), [1e18]]), "crowded": np.concatenate([np.full(400, 0.5), 0.5 + rng.random(600) * 1e-4]),
    }[kind]
    df = frame(spark, [("g", float(v)) for v in x] + [("g", None)], "g string, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["prob"]: r["value"] for r in exact_percentiles(df, ["g"], "x", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.percentile(x, 100 * p)), rel=1e-12, abs=1e-15)


def ece_q_brute(p, y, tie, n_bins, copies=None):
    copies = np.ones(len(p), int) if copies is None else copies
    idx = [i for i in sorted(range(len(p)), key=lambda i: (p[i], tie[i], y[i])) for _ in range(copies[i])]
    n, size, total, start = len(idx), max(1, len(idx) // n_bins), 0.0, 0
    for b in range(n_bins):
        part = idx[start:] if b == n_bins - 1 else idx[start : start + size]
        if part:
            total += len(part) / n * abs(np.mean([p[i] for i in part]) - np.mean([y[i] for i in part]))
        start += size
    return total


@pytest.mark.parametrize("n,bins,levels", [(1000, 10, None), (997, 7, 3), (50, 10, 1), (6, 10, None)])
def test_equal_mass_error_equals_brute_force(spark, n, bins, levels):
    import hashlib

    rng = np.random.default_rng(n)
    p = rng.random(n) if levels is None else rng.integers(1, levels + 1, n) / (levels + 1)
    y = (rng.random(n) < p).astype(int)
    tie = [hashlib.md5(str(i).encode()).hexdigest() for i in range(n)]
    df = frame(spark, [(float(a), int(b), c) for a, b, c in zip(p, y, tie)], "p double, y int, t string")
    got = metrics.ece_equal_mass(df, [], "y", "p", F.col("t"), bins).first()["ece_q"]
    assert got == pytest.approx(ece_q_brute(p, y, tie, bins), abs=1e-12)


def greedy_error(p, y, w, tie, n_bins):
    """The rule told row by row: a bin takes rows while its weight stays within its share, one at least."""
    rows = sorted((a, t, b, int(c)) for a, b, c, t in zip(p, y, w, tie) if c > 0)
    total, out, at = sum(r[3] for r in rows), 0.0, 0
    for b in range(n_bins):
        got = []
        while at < len(rows) and (b == n_bins - 1 or not got or (sum(r[3] for r in got) + rows[at][3]) * n_bins <= total):
            got.append(rows[at])
            at += 1
        out += abs(sum(r[3] * r[0] for r in got) - sum(r[3] * r[2] for r in got)) / total
    return out


@pytest.mark.parametrize("kind", ["even", "crowded", "hot", "heavy", "few"])
def test_weighted_equal_mass_error_equals_brute_force(spark, kind):
    import hashlib

    rng = np.random.default_rng(3)
    n = 4 if kind == "few" else 400
    p = {"crowded": 0.5 + rng.random(n) * 1e-4, "hot": np.where(rng.random(n) < 0.4, 0.25, rng.random(n))}.get(kind, rng.random(n))
    y = (rng.random(n) < p).astype(int)
    w = {"even": np.ones(n), "heavy": np.where(np.arange(n) % 50 == 7, 5000, rng.integers(0, 3, n))}.get(kind, rng.integers(0, 9, n) + (kind == "few"))
    tie = [hashlib.md5(str(i).encode()).hexdigest() for i in range(n)]
    rows = [("a", float(a), int(b), float(c), t) for a, b, c, t in zip(p, y, w, tie)]
    extra = [("b", 0.3, 1, 2.0, "x"), ("b", 0.4, 0, None, "y"), ("b", None, 0, 1.0, "z"), (None, 0.3, 1, 2.0, "x")]
    df = frame(spark, rows + extra, "g string, p double, y int, w double, t string")
    got = {r["g"]: r["ece_q"] for r in metrics.ece_equal_mass(df, ["g"], "y", "p", F.col("t"), 10, weight="w").collect()}
    assert got["a"] == pytest.approx(greedy_error(p, y, w, tie, 10), abs=1e-9) and got["b"] == pytest.approx(0.7)
    alone = metrics.ece_equal_mass(df.where("g = 'a'"), [], "y", "p", F.col("t"), 10, weight="w").first()["ece_q"]
    assert alone == pytest.approx(got["a"], abs=1e-12)


def test_running_sum_over_partitions(spark):
    from strikelake.operators.ranks import with_running_sum

    rng = np.random.default_rng(8)
    rows = [(("hot" if i % 3 else f"k{i % 7}") if i % 50 else None, float(v), i) for i, v in enumerate(np.append(rng.normal(0, 1e-6, 1499), 1e18))]
    df = frame(spark, rows, "k string, v double, i int").repartition(6)
    got = {r["i"]: (r["s"], r["t"]) for r in with_running_sum(df, ["k"], ["v", "i"], F.col("i").cast("long"), "s", "t").collect()}
    for k in {r[0] for r in rows}:
        own, run = sorted((v, i) for k2, v, i in rows if k2 == k), 0
        for _, i in own:
            run += i
            assert got[i] == (run, sum(i for _, i in own))


@pytest.mark.parametrize("n,head", [(1, 1), (2, 1), (5, 4), (11, 8)])
def test_test_split_without_a_week_column(spark, n, head):
    train, test = splits.split_test(spark.range(n), "week", 4, ["id"])
    assert (train.count(), test.count()) == (head, n - head)
    with pytest.raises(ValueError):
        splits.split_test(spark.range(3), "week", 4)


def test_bootstrap_equals_resampling_the_rows(spark):
    import hashlib

    rng = np.random.default_rng(1)
    n = 240
    unit = [f"u{v}" for v in rng.integers(0, 17, n)]
    pm, pb = rng.integers(1, 10, n) / 10, rng.integers(1, 10, n) / 10
    y = rng.integers(0, 2, n)
    tie = [hashlib.md5(str(i).encode()).hexdigest() for i in range(n)]
    df = frame(spark, [(unit[i], float(pm[i]), float(pb[i]), int(y[i]), tie[i]) for i in range(n)], "u string, pm double, pb double, y int, t string")
    copies = {(r["rep"], r["u"]): r["m"] for r in metrics.bootstrap_copies(df.select("u"), "u", 6, 7).collect()}
    got = {r["rep"]: r for r in bootstrap.bootstrap_deltas(df, "u", "y", "pm", "pb", F.col("t"), 6, 7).collect()}
    for rep in range(6):
        m = np.array([copies.get((rep, u), 0) for u in unit])
        assert sum(v for (r_, _), v in copies.items() if r_ == rep) == len(set(unit))
        loss = lambda p: -np.where(y == 1, np.log(p), np.log(1 - p))
        assert got[rep]["delta_logloss"] == pytest.approx(np.sum(m * (loss(pm) - loss(pb))) / m.sum(), abs=1e-12)
        want = ece_q_brute(pm, y, tie, 10, m) - ece_q_brute(pb, y, tie, 10, m)
        assert got[rep]["delta_ece_q"] == pytest.approx(want, abs=1e-12)


def test_poisson_bootstrap_equals_weighted_rows_and_draws_poisson_counts(spark):
    """Single rows as units, one prediction over a third of the rows, unusable rows beside them."""
    rng = np.random.default_rng(3)
    n, reps = 3000, 40
    pm, pb = rng.random(n), rng.random(n)
    pm[: n // 3] = 0.5
    y = rng.integers(0, 2, n)
    rows = [(i, float(pm[i]), float(pb[i]), int(y[i]), f"{i * 7919 % n:05d}") for i in range(n)]
    df = frame(spark, [*rows, (n, None, 0.5, 1, "x"), (n + 1, float("nan"), 0.5, 1, "x"), (n + 2, 0.5, 0.5, None, "x")], "id long, pm double, pb double, y int, t string")
    got = {r["rep"]: r for r in bootstrap.bootstrap_deltas(df.repartition(7), "id", "y", "pm", "pb", F.col("t"), reps, 7, resampling="poisson").collect()}
    keys = np.array([r[0] for r in df.where(F.col("id") < n).orderBy("id").select(F.xxhash64(F.col("id").cast("string"))).collect()])
    m = bootstrap.poisson_counts(reps, 7)(keys)
    assert m.mean() == pytest.approx(1.0, abs=0.01) and m.var() == pytest.approx(1.0, abs=0.02) and m.max() >= 6
    assert abs(np.corrcoef(m.T)[np.triu_indices(reps, 1)]).max() < 0.1
    loss = lambda p: -np.where(y == 1, np.log(p), np.log(1 - p))
    tie = [r[4] for r in rows]
    for rep in (0, 7, 39):
        w = m[:, rep]
        assert got[rep]["n_groups"] == n
        assert got[rep]["delta_logloss"] == pytest.approx(np.sum(w * (loss(pm) - loss(pb))) / w.sum(), abs=1e-12)
        assert got[rep]["delta_brier"] == pytest.approx(np.sum(w * ((pm - y) ** 2 - (pb - y) ** 2)) / w.sum(), abs=1e-12)
        want = ece_q_brute(pm, y, tie, 10, w) - ece_q_brute(pb, y, tie, 10, w)
        assert got[rep]["delta_ece_q"] == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError):
        bootstrap.bootstrap_deltas(df, "id", "y", "pm", "pb", F.col("t"), 2, resampling="other")


def test_isotonic_fit_equals_min_max_formula():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 30):
        for y in (rng.random(n), np.linspace(0, 1, n), np.linspace(1, 0, n), np.full(n, 0.3)):
            want = [min(max(np.mean(y[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
            assert np.allclose(chain.isotonic_falling(y), want, atol=1e-12)


def test_chain_with_two_strikes_has_no_curve(spark):
    q = frame(spark, [("a", k, 5.0, 5.2, 5.1, 1.0, 1, i) for i, k in enumerate((90.0, 110.0))], "c string, strike double, bid double, ask double, close double, volume double, cnt int, i int")
    q = q.withColumns({"spot": F.lit(100.0), "t_years": F.lit(0.1), "rate": F.lit(0.0), "div_yield": F.lit(0.0)})
    s = chain.strike_table(q, ["c"], ["i"])
    assert chain.call_curve(s, ["c"]).count() == 0
    thin = chain.call_curve(s, ["c"], keep_thin=True)
    assert chain.isotonic_knots(chain.interval_probability(thin, ["c"]), ["c"]).count() == 0


def test_band_takes_the_cap_when_no_width_is_enough(spark):
    c = frame(spark, [("a", float(k)) for k in range(95, 106)], "c string, strike double").withColumn("spot_ref", F.lit(100.0))
    wide = chain.with_band(c, ["c"], rules=chain.rules_with(min_inside=50)).first()
    assert wide["used_band"] == pytest.approx(0.10) and wide["n_band_inside"] == 9
    assert chain.with_band(c, ["c"], rules=chain.rules_with(min_inside=9)).first()["used_band"] == pytest.approx(0.06)


def test_normal_cdf_is_accurate(spark):
    xs = [-6.0, -1.5, -0.2, 0.0, 0.7, 2.3, 5.0]
    got = frame(spark, [(x,) for x in xs], "x double").select(scalar.normal_cdf(F.col("x")).alias("p")).collect()
    for x, r in zip(xs, got):
        assert r["p"] == pytest.approx(0.5 * (1 + math.erf(x / math.sqrt(2))), abs=1e-7)


def test_numbers_that_are_not_finite_become_null(spark):
    raw = frame(spark, [("1.5",), ("nan",), ("inf",), ("-inf",), ("x",), (None,), ("0",)], "t string")
    out = [r[0] for r in raw.select(scalar.to_number(F.col("t"))).collect()]
    assert out == [1.5, None, None, None, None, None, 0.0]
    assert raw.select(scalar.safe_divide(F.lit(1.0), scalar.to_number(F.col("t"))).alias("v")).collect()[-1]["v"] is None


def test_close_time_follows_daylight_saving(spark):
    days = [dt.date(2024, 3, 8), dt.date(2024, 3, 11), dt.date(2024, 11, 1), dt.date(2024, 11, 4)]
    got = frame(spark, [(d,) for d in days], "d date").select(F.date_format(cal.close_time_utc(F.col("d")), "HH:mm").alias("t")).collect()
    assert [r["t"] for r in got] == ["21:00", "20:00", "20:00", "21:00"]


def test_friday_rules_differ_on_weekends(spark):
    d = frame(spark, [(dt.date(2026, 3, 7),)], "d date")  # a Saturday
    r = d.select(cal.display_friday(F.col("d")).alias("a"), cal.next_friday(F.col("d")).alias("b"), cal.iso_week_friday(F.col("d")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (dt.date(2026, 3, 6), dt.date(2026, 3, 13), dt.date(2026, 3, 6))


def test_midnight_only_column_holds_dates(spark):
    df = frame(spark, [(D(2024, 1, 5),), (D(2024, 1, 8),)], "t timestamp")
    assert {r["asof_time"] for r in cal.asof_time(df, "t").collect()} == {D(2024, 1, 5, 21), D(2024, 1, 8, 21)}
    mixed = frame(spark, [(D(2024, 1, 5),), (D(2024, 1, 8, 3),)], "t timestamp")
    assert {r["asof_time"] for r in cal.asof_time(mixed, "t").collect()} == {D(2024, 1, 5), D(2024, 1, 8, 3)}


def test_dte_text():
    assert cal.parse_dte("1, 3-5,4") == [1, 3, 4, 5]
    assert cal.parse_dte("") == []
    with pytest.raises(ValueError):
        cal.parse_dte("5-3")
    with pytest.raises(ValueError):
        cal.parse_dte("-2")


def test_downsample_edges(spark):
    t0 = D(2024, 1, 1)
    moving = [("m", t0 + dt.timedelta(minutes=i), i) for i in range(101)]
    flat = [("f", t0, i) for i in range(30)]
    short = [("s", t0 + dt.timedelta(minutes=i), i) for i in range(3)]
    df = frame(spark, moving + flat + short, "k string, timestamp_utc timestamp, i int")
    out = bars.downsample(df, 10, ["k"], tiebreak=["i"]).groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")).collect()
    assert {r["k"]: (r["n"], r["top"]) for r in out} == {"m": (11, 100), "f": (10, 9), "s": (3, 2)}


def test_bars_emit_empty_buckets_and_split_edges(spark):
    rows = [("m", D(2024, 1, 1, 0, 59, 59), 0.2, 1), ("m", D(2024, 1, 1, 1), 0.4, 2), ("m", D(2024, 1, 1, 3, 30), 0.6, 3), ("one", D(2024, 1, 1), 1.0, 4)]
    out = bars.ohlc(frame(spark, rows, "market_id string, timestamp_utc timestamp, price double, event_id int"), "1h")
    got = {(r["market_id"], r["timestamp_utc"].hour): r["close"] for r in out.collect()}
    assert got == {("m", 0): 0.2, ("m", 1): 0.4, ("m", 2): None, ("m", 3): 0.6, ("one", 0): 1.0}


def test_despike_uses_raw_neighbours(spark):
    prices = [0.5, 0.9, 0.5, 0.9, 0.5]
    rows = [("m", D(2024, 1, 1, i), p, i) for i, p in enumerate(prices)]
    out = bars.despike(frame(spark, rows, "market_id string, timestamp_utc timestamp, price double, event_id int"), 0.3, 0.05).orderBy("event_id").collect()
    assert [round(r["price"], 3) for r in out] == [0.5, 0.5, 0.9, 0.5, 0.5]
    assert [r["price_raw"] for r in out] == prices


def test_replace_range_and_backfill(spark):
    old = frame(spark, [("a", dt.date(2024, 1, i), i) for i in range(1, 6)], "k string, day date, v int")
    new = frame(spark, [("a", dt.date(2024, 1, 5), 50), ("b", dt.date(2024, 1, 3), 30)], "k string, day date, v int")
    out = bars.replace_range(old, new, ["k", "day"], F.col("day"), F.lit(dt.date(2024, 1, 2)), F.lit(dt.date(2024, 1, 3)))
    assert sorted((r["k"], r["day"].day, r["v"]) for r in out.collect()) == [("a", 1, 1), ("a", 4, 4), ("a", 5, 50), ("b", 3, 30)]


def test_window_total_counts_both_ends(spark):
    q = frame(spark, [("t", dt.date(2024, 12, 31)), ("t", dt.date(2024, 12, 30)), ("u", dt.date(2024, 1, 1))], "ticker string, day date")
    ev = frame(spark, [("t", dt.date(2024, 1, 1), 1.0), ("t", dt.date(2024, 12, 31), 2.0)], "ticker string, date date, amount double")
    out = lookups.window_total(q, ev, "amount", -365, 0, "s")
    assert sorted((r["ticker"], r["day"].day, r["s"]) for r in out.collect()) == [("t", 30, 1.0), ("t", 31, 3.0), ("u", 1, 0.0)]


def test_split_on_the_day_does_not_count(spark):
    q = frame(spark, [("t", dt.date(2024, 6, 9)), ("t", dt.date(2024, 6, 10))], "ticker string, day date")
    sp = frame(spark, [("t", dt.date(2024, 6, 10), 4.0)], "ticker string, date date, ratio double")
    got = {r["day"].day: r["split_factor"] for r in lookups.split_factor(q, sp).collect()}
    assert got[9] == pytest.approx(4.0) and got[10] == pytest.approx(1.0)


def test_weights_invariants(spark):
    rng = np.random.default_rng(0)
    rows = [(f"t{rng.integers(3)}", dt.date(2024, 1, 1 + int(rng.integers(20))), dt.date(2024, 2, 2), float(k), None) for k in range(400)]
    df = frame(spark, rows, "ticker string, asof_date date, expiry_date date, K double, snapshot_date date")
    w = weights.weighting_v3(df, mode="sqrt_inv")
    assert w.count() == 400
    assert w.agg(F.avg("weight_final")).first()[0] == pytest.approx(1.0, abs=1e-12)
    none = weights.weighting_v3(df).groupBy("weight_group_key").agg(F.sum(F.col("weight_group_w")).alias("s"))
    assert none.where(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0


def test_weights_fail_on_missing_keys_only_when_strict(spark):
    df = frame(spark, [("t", dt.date(2024, 1, 1), dt.date(2024, 1, 5), 1.0), ("t", None, dt.date(2024, 1, 5), 2.0)], "ticker string, asof_date date, expiry_date date, K double")
    assert weights.weighting_v3(df, strict=False).count() == 1
    with pytest.raises(Exception, match="weighting keys missing"):
        weights.weighting_v3(df).collect()


def test_folds_shrink_validation_to_keep_training_weeks():
    weeks = [dt.date(2024, 1, 5) + dt.timedelta(weeks=i) for i in range(12)]
    (f,) = splits.walk_forward(weeks, 1, 8, 20)
    assert (f.train_hi, f.val_lo) == (weeks[7], weeks[8])
    with pytest.raises(ValueError):
        splits.walk_forward(weeks[:6], 1, 2, 4)
    with pytest.raises(ValueError):
        splits.walk_forward(weeks, 3, 4, 20)


def test_short_history_has_an_empty_test_side(spark):
    df = frame(spark, [(dt.date(2024, 1, 5), 1), (dt.date(2024, 1, 12), 2)], "week date, i int")
    train, test = splits.split_test(df, "week", 2)
    assert (train.count(), test.count()) == (2, 0)


def test_leak_guard_stops_the_job(spark):
    df = frame(spark, [(D(2024, 1, 2), D(2024, 1, 2))], "t timestamp, f_time timestamp")
    with pytest.raises(Exception, match="not before decision"):
        splits.assert_no_leaks(df, "t", ["f_time"]).collect()


def test_many_to_one_refuses_repeated_keys(spark):
    a, b = frame(spark, [(1,)], "k int"), frame(spark, [(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        relational.many_to_one(a, b, ["k"])


def test_bootstrap_group_fallback(spark):
    df = frame(spark, [(1,)], "x int")
    assert metrics.bootstrap_group(df, "auto")[1] == "iid"
    assert metrics.bootstrap_group(df, "day", allow_iid=True)[1] == "iid"
    with pytest.raises(ValueError):
        metrics.bootstrap_group(df, "day")


def test_bootstrap_group_skips_columns_without_values(spark):
    df = frame(spark, [("t", None, dt.date(2024, 1, 5), None)], "ticker string, snapshot_date date, asof_date date, contract_id string")
    unit, name = metrics.bootstrap_group(df)
    assert (name, df.select(unit).first()[0]) == ("ticker_day", "T|2024-01-05")
    with pytest.raises(ValueError):
        metrics.bootstrap_group(df, "contract_id")
    assert metrics.bootstrap_group(df, "contract_id", allow_iid=True)[1] == "iid"


def test_title_dates_are_what_the_parser_accepts(spark):
    rows = [("Closes on Sept 5, 2025?",), ("Level 7 2024 or JULY 4th, 2025",), ("week of Jan 5-9, 2026",), ("above Feb 31 2025",)]
    found = frame(spark, rows, "q string").select(text.question_date(F.col("q"))).collect()
    assert [r[0] for r in found] == [dt.date(2025, 9, 5), dt.date(2025, 7, 4), dt.date(2026, 1, 5), None]


def test_features_are_added_only_on_request(spark):
    df = frame(spark, [(0.5, 100.0, 90.0)], "pRN double, K double, S_asof_close double")
    out = features.with_features(df, ["x_logit_prn"])
    assert out.columns == [*df.columns, "x_logit_prn"]
    kept = features.with_features(df.withColumn("log_m", F.lit(9.0)), ["log_m"]).first()
    assert kept["log_m"] == 9.0


def test_rules_stop_bad_rows(spark):
    df = frame(spark, [(1.0,), (-1.0,)], "T_days double")
    with pytest.raises(Exception, match="horizon_not_negative"):
        quality.require_clean(df, quality.snapshot_rules(df.columns)).collect()


def test_empty_tables_pass_through(spark):
    t = frame(spark, [], "market_id string, timestamp_utc timestamp, price double, event_id int")
    assert bars.ohlc(t, "1d").count() == 0
    assert bars.downsample(t, 5, ["market_id"]).count() == 0
    assert exact_percentiles(t, ["market_id"], "price", [0.5]).count() == 0
    assert pd.isna(metrics.point_metrics(t.withColumn("y", F.lit(1)), [], "y", "price").first()["logloss"])


@pytest.mark.parametrize("n,head", [(1, 0), (2, 1), (5, 4), (10, 8)])
def test_row_tail_keeps_both_sides(spark, n, head):
    a, b = splits.split_row_tail(spark.range(n), ["id"])
    assert (a.count(), b.count()) == (head, n - head)


def test_range_text():
    assert cal.parse_range("2024-01-02:2024-01-03") == (dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    assert cal.parse_range("2024-01-02") == (dt.date(2024, 1, 2), dt.date(2024, 1, 2))
    assert cal.parse_range(":2024-01-03") == (None, dt.date(2024, 1, 3))
    assert cal.parse_range("") == (None, None)
    with pytest.raises(ValueError):
        cal.parse_range("2024-02-01:2024-01-01")


def test_empty_raw_probability_column_counts_as_missing(spark):
    df = frame(spark, [(0.4, None, 100.0, 100.0, 2.0, D(2024, 1, 2), D(2024, 1, 5))], "pRN double, pRN_raw double, K double, S double, T_days double, snapshot_time_utc timestamp, event_endDate timestamp")
    r = features.enrich_snapshot(df).first()
    assert r["pRN_raw"] == 0.4 and r["rv20"] == 0.3 and r["asof_date"] == dt.date(2024, 1, 1)


def test_fold_masks_and_facts(spark):
    rng = np.random.default_rng(2)
    day = lambda i: dt.date(2024, 1, 5) + dt.timedelta(days=int(i))
    folds = [splits.Fold(k + 1, day(0), day(40 + 10 * k), day(41 + 10 * k), day(50 + 10 * k)) for k in range(3)]
    rows = [(day(a - a % 7), day(a) if i % 40 else None, f"g{rng.integers(300)}" if i % 9 else None, i) for i, a in enumerate(rng.integers(0, 80, 600))]
    df = frame(spark, rows, "week date, day date, g string, i int")
    masked = splits.fold_masks(df, folds, "week", "g", 4, "day")
    got = {r["i"]: r for r in masked.collect()}
    facts = {r["fold"]: r for r in splits.fold_facts(masked, folds, "day").collect()}
    kept = {(r["i"], r["fold"], r["role"]) for r in splits.assign_folds(df, folds, "week", "g", 4, "day").collect()}
    want = set()
    for k, f in enumerate(folds):
        val = [r for r in rows if f.val_lo <= r[0] <= f.val_hi]
        first = min(r[1] for r in val if r[1])
        groups = {r[2] for r in val if r[2]}
        train = [r for r in rows if f.train_lo <= r[0] <= f.train_hi]
        purged = [r for r in train if r[2] in groups]
        late = [r for r in train if r[2] not in groups and not (r[1] and r[1] < first - dt.timedelta(days=4))]
        rest = [r for r in train if r not in purged and r not in late]
        want |= {(r[3], f.fold, "val") for r in val} | {(r[3], f.fold, "train") for r in rest}
        assert all(got[r[3]]["purged_folds"] >> k & 1 for r in purged) and all(got[r[3]]["embargoed_folds"] >> k & 1 for r in late)
        x = facts[f.fold]
        assert (x["n_train"], x["n_val"], x["n_purged"], x["n_embargoed"]) == (len(rest), len(val), len(purged), len(late))
        assert (x["first_val"], x["gap_days"]) == (first, (first - max(r[1] for r in rest)).days)
    assert kept == want


def test_an_emptied_fold_is_an_error(spark):
    week = lambda k: dt.date(2024, 1, 5) + dt.timedelta(weeks=k)
    df = frame(spark, [(week(k), week(k), "same") for k in range(4)], "week date, day date, g string")
    fold = splits.Fold(1, week(0), week(1), week(2), week(3))
    splits.require_whole_folds(splits.fold_facts(splits.fold_masks(df, [fold], "week"), [fold], "day"))
    for options in ({"group": "g"}, {"embargo": 90, "date_col": "day"}):
        with pytest.raises(ValueError, match="empty after"):
            splits.require_whole_folds(splits.fold_facts(splits.fold_masks(df, [fold], "week", **options), [fold], "day"))


@pytest.mark.parametrize("resampling", ["draws", "poisson"])
def test_bootstrap_walks_cut_chunks_and_writes_no_counts_with_the_rows(spark, monkeypatch, resampling):
    """Chunks of 32 rows, so that edges fall inside chunks and between them; what is written of the rows grows with the rows alone."""
    written = {}
    keep = bootstrap.materialize
    monkeypatch.setattr(bootstrap, "materialize", lambda df, name="stage": written.setdefault(name, keep(df, name)))
    monkeypatch.setattr(bootstrap, "CHUNK", 32, raising=False)
    rng = np.random.default_rng(8)
    n, reps = 900, 12
    pm, pb, y = rng.random(n), np.round(rng.random(n), 1), rng.integers(0, 2, n)
    unit, tie = [f"u{v}" for v in rng.integers(0, 40, n)], [f"{i * 7919 % n:05d}" for i in range(n)]
    df = frame(spark, [(unit[i], float(pm[i]), float(pb[i]), int(y[i]), tie[i]) for i in range(n)], "u string, pm double, pb double, y int, t string")
    got = {r["rep"]: r for r in bootstrap.bootstrap_deltas(df.repartition(5), "u", "y", "pm", "pb", F.col("t"), reps, 7, resampling=resampling).collect()}
    assert "_m" not in written["resampled"].columns
    if resampling == "draws":
        copies = {(r["rep"], r["u"]): r["m"] for r in metrics.bootstrap_copies(df.select("u"), "u", reps, 7).collect()}
        m = np.array([[copies.get((rep, u), 0) for rep in range(reps)] for u in unit])
    else:
        key = {r[0]: r[1] for r in df.select("u", F.xxhash64("u")).distinct().collect()}
        m = bootstrap.poisson_counts(reps, 7)(np.array([key[u] for u in unit])).astype(int)
    for rep in range(reps):
        assert got[rep]["n_groups"] == len(set(unit))
        want = ece_q_brute(pm, y, tie, 10, m[:, rep]) - ece_q_brute(np.clip(pb, 1e-6, 1 - 1e-6), y, tie, 10, m[:, rep])
        assert got[rep]["delta_ece_q"] == pytest.approx(want, abs=1e-5)


def test_hourly_spine_deals_spans_by_their_number(spark, monkeypatch):
    """Spans are few bytes, so they arrive in one task; the hours they make must not be made there."""
    monkeypatch.setattr(asof, "SPANS_PER_TASK", 10, raising=False)
    spans = spark.range(95).coalesce(1).select(F.col("id").alias("market_id"))
    got = asof.hourly_spine(spans, F.lit("2024-01-02 00:30:00").cast("timestamp"), F.lit("2024-01-03 05:00:00").cast("timestamp"))
    per = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 95 * 30 and len(per) >= 9 and max(per) <= 30 * 30


def test_tables_of_splits_and_files_are_not_joined_by_shuffles(spark):
    """One key may be a whole split or file, so the rows must not be shuffled by it, whatever the size of the table."""
    from strikelake.plans import datasets

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = frame(spark, [(s, i % 2, 0.3, 0.4) for i, s in enumerate("aab")], "split string, y int, pm double, pb double")
        assert "SortMergeJoin" not in plan(metrics.stack_models(df, ["split"], "y", "pm", "pb"))
        rows = frame(spark, [("f1", "a", "2024-01-02", "2024-01-05", 1.0), ("f1", "a", "2024-01-02", "2024-01-05", 2.0), ("f1", "b", "2024-01-03", "2024-01-05", 1.0), ("f2", "b", "2024-01-03", "2024-01-05", None)],
                     "file string, ticker string, snapshot_date string, expiry_date string, K double")
        _, report = datasets.migrate_weights(rows)
        assert plan(report).count("SortMergeJoin") <= 3  # of small tables: groups with tickers, the report's own rows
        found = {r["file"]: r for r in report.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found["f2"]["status"] == "skipped_unfit" and found["f1"]["rows"] == 3 and found["f1"]["weight_groups"] == 2
    assert (found["f1"]["weight_min"], found["f1"]["weight_max"], found["f1"]["weight_mean"]) == (0.75, 1.5, pytest.approx(1.0))
