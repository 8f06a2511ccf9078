"""Scoring metrics: log loss, Brier, MAE/RMSE, calibration errors and grouped bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelake.functions.scalar import EPS, clip, finite
from strikelake.operators.ranks import with_running_sum
from strikelake.operators.skew import dense_index, text_bucket, with_scalars
from strikelake.session import materialize


def loss_log(y: Column, p: Column, eps: float = EPS) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return -F.when(y == 1, F.ln(q)).otherwise(F.ln(F.lit(1.0) - q))


def loss_squared(y: Column, p: Column, eps: float = EPS) -> Column:
    d = clip(p, eps, 1.0 - eps) - y
    return d * d


def point_metrics(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    yy, pp = F.col(y), F.col(p)
    q = clip(pp, EPS, 1.0 - EPS)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(loss_log(yy, pp)).alias("logloss"),
        F.avg(loss_squared(yy, pp)).alias("brier"),
        F.avg(F.abs(q - yy)).alias("mae"),
        F.sqrt(F.avg(loss_squared(yy, pp))).alias("rmse"),
    )


def weighted_logloss(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", w: str = "w") -> DataFrame:
    """Weighted mean over valid weights; without any valid weight the plain mean."""
    loss = loss_log(F.col(y), F.col(p))
    ok = (F.col(w) > 0) & (F.col(w) < float("inf")) & F.col(p).isNotNull()
    weighted = F.try_divide(F.sum(F.when(ok, F.col(w) * loss)), F.sum(F.when(ok, F.col(w))))
    return df.groupBy(*by).agg(F.coalesce(weighted, F.avg(loss)).alias("logloss"))


# --- calibration error ----------------------------------------------------------------------------


def width_bin(p: Column, n_bins: int) -> Column:
    """Bin by literal edges (the edge 3/10 is 0.30000000000000004, so floor(p*n) would differ)."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, n_bins + 1)[1:-1]]
    q = clip(p, EPS, 1.0 - EPS)
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= q))


def error_from_bins(bins: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """bins(by..., _c, _sp, _sy) -> sum over bins of share * |mean p - mean y|."""
    term = F.abs(F.col("_sp") - F.col("_sy"))
    return bins.groupBy(*by).agg((F.sum(term) / F.sum("_c")).alias(name))


def ece(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p", n_bins: int = 10) -> DataFrame:
    q = clip(F.col(p), EPS, 1.0 - EPS)
    bins = df.groupBy(*by, width_bin(F.col(p), n_bins).alias("_bin")).agg(
        F.count("*").alias("_c"), F.sum(q).alias("_sp"), F.sum(F.col(y).cast("double")).alias("_sy")
    )
    return error_from_bins(bins, by, "ece")


def equal_mass_bins(
    df: DataFrame,
    by: Sequence[str],
    y: str,
    p: str,
    tie: Column,
    n_bins: int = 10,
    copies: DataFrame | None = None,
    unit: str | None = None,
) -> DataFrame:
    """Bins of floor(n / n_bins) rows in order of p, the rest in the last: (by..., bin, _c, _sp, _sy).

    Equal predictions are ordered by `tie` (an md5 text), then y. There is no global sort: rows are
    first counted per distinct p; a value lying wholly inside a bin is done. Only the at most
    n_bins - 1 values per group that straddle a bin edge go back to their rows, and those are ranked
    per (value, md5 bucket), so one value holding a third of all rows still spreads out.

    `copies(unit, by-extra..., m)` gives each unit a multiplicity per replicate; the extra columns
    belong to `by`.
    """
    by = list(by)
    q = clip(F.col(p), EPS, 1.0 - EPS)
    base = df.withColumns({"_p": q, "_y": F.col(y).cast("double"), "_tie": tie})
    if copies is None:
        counts = base.groupBy(*by, "_p").agg(F.count("*").alias("_c"), F.sum("_y").alias("_sy"))
    else:
        extra = [c for c in copies.columns if c not in (unit, "m")]
        own = [c for c in by if c not in extra]
        small = base.groupBy(*own, unit, "_p").agg(F.count("*").alias("_c"), F.sum("_y").alias("_sy"))
        counts = small.join(copies, unit).groupBy(*by, "_p").agg(
            F.sum(F.col("_c") * F.col("m")).alias("_c"), F.sum(F.col("_sy") * F.col("m")).alias("_sy")
        )
    # Position of every distinct p: a prefix scan over the counts.
    placed = with_running_sum(counts, by, ["_p"], F.col("_c"), "_upto", "_total").withColumn("_first", F.col("_upto") - F.col("_c"))
    size = F.greatest(F.lit(1), F.floor(F.col("_total") / n_bins)).cast("long")
    bin_at = lambda pos: F.least(F.lit(n_bins - 1), F.floor(pos / F.col("_size"))).cast("int")
    placed = placed.withColumn("_size", size).withColumns(
        {"_b0": bin_at(F.col("_first")), "_b1": bin_at(F.col("_first") + F.col("_c") - 1)}
    )
    whole = placed.where(F.col("_b0") == F.col("_b1")).select(
        *by, F.col("_b0").alias("bin"), "_c", (F.col("_p") * F.col("_c")).alias("_sp"), "_sy"
    )
    split = placed.where(F.col("_b0") != F.col("_b1")).select(*by, "_p", "_first", "_size")
    if copies is None:
        rows = base.withColumn("m", F.lit(1).cast("long"))
        own_by = by
    else:
        touched = base.join(split.select("_p").distinct(), "_p", "left_semi")
        rows = touched.join(copies, unit)
        own_by = by
    rows = rows.select(*own_by, "_p", "_y", "_tie", F.col("m").cast("long").alias("m")).join(split, [*by, "_p"])
    # Rank inside md5 buckets of the straddling value; rows equal in (tie, y) may take any order.
    rows = rows.withColumn("_s", text_bucket(F.col("_tie")))
    buckets = rows.groupBy(*by, "_p", "_s").agg(F.sum("m").alias("_n"))
    run = Window.partitionBy(*by, "_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*by, "_p", "_s", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_p", "_s").orderBy("_tie", "_y").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(buckets, [*by, "_p", "_s"]).withColumn(
        "_at", F.col("_first") + F.col("_off") + F.coalesce(F.sum("m").over(inside), F.lit(0))
    )
    # A row with several copies may cross an edge: one output per bin it touches.
    rows = rows.withColumn("bin", F.explode(F.sequence(bin_at(F.col("_at")), bin_at(F.col("_at") + F.col("m") - 1))))
    lo = F.col("bin") * F.col("_size")
    hi = F.when(F.col("bin") == n_bins - 1, F.lit(2**62)).otherwise(lo + F.col("_size"))
    share = F.least(F.col("_at") + F.col("m"), hi) - F.greatest(F.col("_at"), lo)
    parts = rows.withColumn("_c", share).select(
        *by, "bin", "_c", (F.col("_p") * F.col("_c")).alias("_sp"), (F.col("_y") * F.col("_c")).alias("_sy")
    )
    return whole.unionByName(parts).groupBy(*by, "bin").agg(
        F.sum("_c").alias("_c"), F.sum("_sp").alias("_sp"), F.sum("_sy").alias("_sy")
    )


def weighted_mass_bins(df: DataFrame, by: Sequence[str], y: str, p: str, weight: str, tie: Column, n_bins: int = 10) -> DataFrame:
    """Greedy bins of equal weight in order of p: (by..., bin, _c, _sp, _sy) with weighted sums.

    A bin takes rows while its weight stays within total / n_bins, one row at least, and the last bin takes the rest. Rows are not
    sorted: weights are summed per cell of p, then, in the cells where an edge may fall, per value and md5 bucket, and only the
    rows of the buckets where an edge may fall are ranked. Weights are counted in units of 1e-9, so sums and edges don't
    depend on partitions; rows without a positive weight carry nothing.
    """
    by = list(by)
    attach = lambda left, right: left.join(right, by) if by else with_scalars(left, right)
    amount = F.col(weight).cast("decimal(20,9)")
    units = (amount * F.lit(10**9).cast("decimal(10,0)")).cast("decimal(20,0)")
    rows = df.select(*by, clip(F.col(p), 0.0, 1.0).alias("_p"), F.col(y).cast("double").alias("_y"), tie.alias("_tie"), units.alias("_w"), amount.cast("double").alias("_c"))
    rows = rows.where((F.col("_w") > 0) & F.col("_p").isNotNull() & F.col("_y").isNotNull()).withColumn("_cell", F.floor(F.col("_p") * 4096))
    sums = [F.sum("_w").alias("_w"), F.sum("_c").alias("_c"), F.sum(F.col("_c") * F.col("_p")).alias("_sp"), F.sum(F.col("_c") * F.col("_y")).alias("_sy")]
    out = [*by, "_end", "_c", "_sp", "_sy"]

    cells = with_running_sum(rows.groupBy(*by, "_cell").agg(*sums), by, ["_cell"], F.col("_w"), "_end", "_total")
    cells = materialize(cells, "weighted-cells")
    total = cells.groupBy(*by).agg(F.max("_total").alias("_total")).where(F.col("_total").isNotNull())
    ends = cells.select(*by, "_end")
    cells = _mark_edges(attach(cells, _edge_bounds(ends, total, by, n_bins)))
    open_cells = cells.where("_open").select(*by, "_cell", (F.col("_end") - F.col("_w")).alias("_from"))

    near = rows.withColumn("_s", text_bucket(F.col("_tie"))).join(F.broadcast(open_cells), [*by, "_cell"])  # a few cells for each edge
    buckets = near.groupBy(*by, "_cell", "_from", "_p", "_s").agg(*sums)
    buckets = with_running_sum(buckets, [*by, "_cell"], ["_p", "_s"], F.col("_w"), "_upto").withColumn("_end", F.col("_from") + F.col("_upto"))
    buckets = materialize(buckets, "weighted-buckets")
    ends = ends.unionByName(buckets.select(*by, "_end"))
    buckets = _mark_edges(attach(buckets, _edge_bounds(ends, total, by, n_bins)))
    open_buckets = buckets.where("_open").select(*by, "_p", "_s", (F.col("_end") - F.col("_w")).alias("_start"))

    ranked = with_running_sum(near.join(F.broadcast(open_buckets), [*by, "_p", "_s"]), [*by, "_p", "_s"], ["_tie", "_y"], F.col("_w"), "_upto")
    ranked = ranked.withColumns({"_end": F.col("_start") + F.col("_upto"), "_sp": F.col("_c") * F.col("_p"), "_sy": F.col("_c") * F.col("_y")})
    ranked = materialize(ranked.select(*out), "weighted-rows")
    edges = _edge_bounds(ends.unionByName(ranked.select(*by, "_end")), total, by, n_bins, whole=True)
    parts = cells.where("not _open").select(*out).unionByName(buckets.where("not _open").select(*out)).unionByName(ranked)
    at = F.size(F.filter("_los", lambda e: e < F.col("_end")))
    placed = attach(parts, edges.select(*by, "_los")).withColumn("bin", F.least(at, F.lit(n_bins - 1)))
    return placed.groupBy(*by, "bin").agg(F.sum("_c").alias("_c"), F.sum("_sp").alias("_sp"), F.sum("_sy").alias("_sy"))


def _edge_bounds(ends: DataFrame, total: DataFrame, by: list[str], n_bins: int, whole: bool = False) -> DataFrame:
    """(by..., _los, _his): between which cumulated weights each edge lies, known from some of the rows' cumulated weights.

    With `whole` the ends hold every edge and the row behind it, and _los are the edges.
    """
    bins = F.lit(n_bins).cast("decimal(3,0)")
    none = F.array().cast("array<decimal(38,0)>")
    zero = F.lit(0).cast("decimal(38,0)")
    state = total.select(*by, F.col("_total").cast("decimal(38,0)").alias("_total"), zero.alias("_lo"), zero.alias("_hi"), none.alias("_los"), none.alias("_his"))
    for _ in range(n_bins - 1):
        near = ends.join(F.broadcast(state), by) if by else with_scalars(ends, state)  # a row per group
        ahead = F.col("_end") > F.col("_lo")
        fits = ahead & ((F.col("_end") - F.col("_lo")) * bins <= F.col("_total"))
        beyond = (F.col("_end") - F.col("_hi")) * bins >= F.col("_total")
        least = lambda hit: F.min(F.when(hit, F.col("_end")))
        found = near.groupBy(*state.columns).agg(F.max(F.when(fits, F.col("_end"))).alias("_fit"), least(ahead).alias("_next"), least(beyond).alias("_past"))
        lo = F.coalesce("_fit", "_next", "_lo") if whole else F.coalesce("_fit", "_lo")
        hi = lo if whole else F.coalesce("_past", "_total")
        lo, hi = lo.cast("decimal(38,0)"), hi.cast("decimal(38,0)")
        state = found.select(*by, "_total", lo.alias("_lo"), hi.alias("_hi"), F.concat("_los", F.array(lo)).alias("_los"), F.concat("_his", F.array(hi)).alias("_his"))
    return materialize(state.select(*by, "_los", "_his"), "bin-edges")


def _mark_edges(placed: DataFrame) -> DataFrame:
    """`_open`: an edge may fall inside the cell, not only at its end."""
    inside = F.exists(F.arrays_zip("_los", "_his"), lambda e: (e["_los"] < F.col("_end")) & (e["_his"] > F.col("_end") - F.col("_w")))
    return placed.withColumn("_open", inside).drop("_los", "_his")


def ece_equal_mass(
    df: DataFrame, by: Sequence[str], y: str, p: str, tie: Column, n_bins: int = 10, copies: DataFrame | None = None, unit: str | None = None, weight: str | None = None
) -> DataFrame:
    if weight is not None:
        return error_from_bins(weighted_mass_bins(df, by, y, p, weight, tie, n_bins), by, "ece_q")
    return error_from_bins(equal_mass_bins(df, by, y, p, tie, n_bins, copies, unit), by, "ece_q")


# --- baseline against model -----------------------------------------------------------------------


def stack_models(df: DataFrame, by: Sequence[str], y: str, model: str, baseline: str) -> DataFrame:
    """Two rows per shared row: baseline and model. Where a split has no baseline at all, model only."""
    ok_m = F.col(y).isNotNull() & finite(F.col(model)).isNotNull()
    ok_b = finite(F.col(baseline)).isNotNull()
    has = df.groupBy(*by).agg(F.max(ok_b).alias("_has_base"))
    marked = df.join(F.broadcast(has), list(by)) if by else with_scalars(df, has)  # a row per split; a shuffle would send a split to one task
    use = marked.where(ok_m & (ok_b | ~F.col("_has_base")))
    pairs = F.array(
        F.struct(F.lit("baseline_pRN").alias("model"), F.col(baseline).alias("p")),
        F.struct(F.lit("logit").alias("model"), F.col(model).alias("p")),
    )
    tall = use.select("*", F.inline(pairs))
    return tall.where((F.col("model") == "logit") | F.col("_has_base")).drop("_has_base")


def split_metrics(
    df: DataFrame, by: Sequence[str], y: str, model: str, baseline: str, tie: Column, n_bins: int = 10, eceq_bins: int = 10
) -> DataFrame:
    tall = stack_models(df.withColumn("_t", tie), by, y, model, baseline)
    keys = [*by, "model"]
    yy, q = F.col(y), clip(F.col("p"), EPS, 1.0 - EPS)
    # Losses and equal-width bins share one pass: sums per bin, then per split and model.
    bins = tall.groupBy(*keys, width_bin(F.col("p"), n_bins).alias("_bin")).agg(
        F.count("*").alias("_c"), F.sum(q).alias("_sp"), F.sum(yy.cast("double")).alias("_sy"),
        F.sum(loss_log(yy, F.col("p"))).alias("_ll"), F.sum(loss_squared(yy, F.col("p"))).alias("_sq"),
    )
    total = F.sum("_c")
    out = bins.groupBy(*keys).agg(
        total.alias("n"), (F.sum("_ll") / total).alias("logloss"), (F.sum("_sq") / total).alias("brier"),
        (F.sum(F.abs(F.col("_sp") - F.col("_sy"))) / total).alias("ece"),
    )
    return out.join(ece_equal_mass(tall, keys, y, "p", F.col("_t"), eceq_bins), keys)


# --- bootstrap ------------------------------------------------------------------------------------

# Columns that may hold the day of a row, first usable one first, and id columns that may be units.
DAY_COLUMNS = (
    "snapshot_date", "asof_date", "snapshot_time_utc", "asof_datetime_utc", "asof_datetime", "snapshot_datetime_utc", "week_friday",
)
ID_UNITS = ("contract_id", "group_id")


def bootstrap_group(df: DataFrame, requested: str = "auto", ticker: str = "ticker", allow_iid: bool = False) -> tuple[Column | None, str]:
    """The resampling unit and its name; None means single rows. Unavailable units fail unless iid is allowed.

    A column counts only if it holds a usable value somewhere; one aggregate tests all of them.
    """
    texts = {c: F.date_format(F.col(c).try_cast("timestamp"), "yyyy-MM-dd") for c in DAY_COLUMNS if c in df.columns}
    texts |= {c: F.col(c).cast("string") for c in ID_UNITS if c in df.columns}
    filled = df.agg(*[F.count(text).alias(c) for c, text in texts.items()]).first().asDict() if texts else {}
    usable = {c: F.coalesce(text, F.lit("NA")) for c, text in texts.items() if filled[c]}
    units: dict[str, Column | None] = {c: usable[c] for c in ID_UNITS if c in usable} | {"iid": None}
    for day in [c for c in DAY_COLUMNS if c in usable][:1]:
        units["day"] = usable[day]
        if ticker in df.columns:
            units["ticker_day"] = F.concat_ws("|", F.upper(F.coalesce(F.col(ticker).cast("string"), F.lit("UNKNOWN"))), usable[day])
    asked = requested.strip().lower()
    known = asked in ("ticker_day", "day", "iid", *ID_UNITS)
    order = [asked, *(["iid"] if allow_iid else [])] if known else ["ticker_day", "day", "iid"]
    for name in order:
        if name in units:
            return units[name], name
    raise ValueError(f"bootstrap group {requested!r} is not available")


def bootstrap_copies(units: DataFrame, unit: str, replicates: int, seed: int = 7) -> DataFrame:
    """(unit, rep, m): how often each unit is drawn in each replicate of G draws with replacement.

    Draw d of replicate r takes unit floor(hash32(seed|r|d) * G / 2^32). The G draws are spread over
    the units themselves (unit number d makes draw d), so nothing is generated on the driver.
    """
    index = dense_index(units, unit, "_i")
    total = index.agg(F.count("*").alias("_g"))
    drawn = with_scalars(index.select("_i"), total).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("rep").cast("string"), F.col("_i").cast("string")))
    h = F.conv(F.substring(text, 1, 8), 16, 10).cast("long")
    picked = drawn.select("rep", F.floor(h * F.col("_g") / F.lit(4294967296)).cast("long").alias("_i"))
    m = picked.groupBy("rep", "_i").agg(F.count("*").alias("m"))
    return m.join(index, "_i").select(unit, "rep", "m")


def bootstrap_intervals(deltas: DataFrame, level: float = 95.0) -> DataFrame:
    """Percentile interval of each delta over the replicates (one row per replicate)."""
    alpha = max(0.1, min(49.9, (100.0 - level) / 2.0)) / 100.0
    names = [c for c in deltas.columns if c.startswith("delta_")]
    return deltas.agg(
        *[F.percentile(c, F.lit(a)).alias(f"{c}_ci_{tag}") for c in names for tag, a in (("lo", alpha), ("hi", 1.0 - alpha))],
        F.count("*").alias("bootstrap_b"), *([F.max("n_groups").alias("bootstrap_n_groups")] if "n_groups" in deltas.columns else []),
    )
