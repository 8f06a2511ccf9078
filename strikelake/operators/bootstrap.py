"""Bootstrap of model minus baseline: replicate counts are an array per unit, and tasks add up arrays over the replicates.

Rows are sorted once by prediction and written without counts; a pass sums chunks of neighbours over the replicates, and only
chunks that a bin edge of equal mass falls into are read row by row.

Two ways to resample. `draws` takes G units with replacement in each replicate, exactly; the G x replicates draws are made once
and folded into one array of small counts per unit. `poisson` gives every unit an independent Poisson(1) count per
replicate, computed where the unit's rows are from a hash of (seed, replicate, unit): nothing is drawn, shuffled or joined, so
single rows can be units whatever their number. Both weigh the same sums; the totals of a Poisson replicate vary.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelake.functions.scalar import EPS, clip, finite
from strikelake.operators.metrics import bootstrap_copies, error_from_bins
from strikelake.session import materialize

RESAMPLING = ("draws", "poisson")
CHUNK = 1 << 14  # rows in order of their prediction that are summed together
SUMS = ["_c", "_sp", "_sy", "_ll", "_sq"]


def unit_counts(units: DataFrame, unit: str, replicates: int, seed: int = 7) -> DataFrame:
    """(unit, _m): for each unit one array of its counts in all replicates; a unit that is never drawn has no row."""
    copies = bootstrap_copies(units, unit, replicates, seed)
    by_rep = F.map_from_entries(F.collect_list(F.struct("rep", F.col("m").cast("int").alias("m"))))  # at most one entry a replicate
    per = copies.groupBy(unit).agg(by_rep.alias("_by"))
    return per.select(unit, F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.coalesce(F.try_element_at("_by", r), F.lit(0))).alias("_m"))


def poisson_counts(replicates: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """A self-contained function (64-bit keys) -> counts, keys x replicates, to run in tasks."""
    steps = np.array([1.0 / math.factorial(i) for i in range(20)])
    limits = np.cumsum(steps) * math.exp(-1.0)

    # The leading 16 bits of a draw settle its count, except in the few cells that a limit falls into.
    cells = np.arange((1 << 16) + 1) / (1 << 16)
    below, above = np.searchsorted(limits, cells[:-1], side="right"), np.searchsorted(limits, cells[1:], side="left")
    table = np.where(below == above, below, 255).astype(np.uint8)
    # The multipliers of the splitmix64 generator.
    offsets = np.uint64(0x9E3779B97F4A7C15) * (np.arange(replicates, dtype=np.uint64) + np.uint64(1 + 100003 * seed))

    def counts(keys: np.ndarray) -> np.ndarray:
        out, whole = np.empty((len(keys), replicates), np.uint8), keys.astype(np.int64).view(np.uint64)
        for s in range(0, len(keys), 512):
            x = whole[s : s + 512, None] + offsets
            x ^= x >> np.uint64(30)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(27)
            x *= np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            m = table[x >> np.uint64(48)]
            at = np.nonzero(m == 255)
            m[at] = np.searchsorted(limits, (x[at] >> np.uint64(11)) / float(1 << 53), side="right")
            out[s : s + 512] = m
        return out

    return counts


def bootstrap_deltas(
    df: DataFrame, unit: str, y: str, model: str, baseline: str, tie: Column, replicates: int, seed: int = 7, n_bins: int = 10, eceq_bins: int = 10,
    resampling: str = "draws",
) -> DataFrame:
    """Per replicate: model minus baseline for log loss, Brier, ECE and equal-mass ECE, with `n_groups`, the number of units.

    Rows without a finite label or one of the predictions take no part. A replicate that draws no row at all has none.
    """
    if resampling not in RESAMPLING:
        raise ValueError(f"resampling must be one of {RESAMPLING}")
    usable = df.where(finite(F.col(y).cast("double")).isNotNull() & finite(F.col(model)).isNotNull() & finite(F.col(baseline)).isNotNull())
    q = lambda c: clip(F.col(c), EPS, 1.0 - EPS).alias("_p")
    both = F.array(F.struct(F.lit(0).alias("_model"), q(baseline)), F.struct(F.lit(1).alias("_model"), q(model)))
    if resampling == "draws":
        counts = unit_counts(usable.select(F.col(unit).alias("_unit")), "_unit", replicates, seed)
        counts = materialize(counts.withColumn("_m", F.col("_m").cast("array<tinyint>")), "unit_counts")
        key, groups, make = F.col(unit).alias("_unit"), usable.agg(F.count_distinct(unit)).first()[0], None
        with_counts = lambda x: x.join(counts, "_unit").drop("_unit")
    else:
        key, groups, make = F.xxhash64(F.col(unit).cast("string")).alias("_key"), usable.select(unit).distinct().count(), poisson_counts(replicates, seed)
        with_counts = lambda x: x
    tall = usable.select(key, F.col(y).cast("double").alias("_y"), tie.alias("_t"), F.inline(both))
    dealt = _chunked(tall)
    sums = materialize(_chunk_sums(with_counts(dealt.drop("_at")), make, replicates, n_bins), "chunk-sums")
    flat = sums.groupBy("_model", "_bin", "rep").agg(*[F.sum(c).alias(c) for c in SUMS])
    total = F.sum("_c")
    flat = flat.groupBy("rep", "_model").agg(
        (F.sum("_ll") / total).alias("logloss"), (F.sum("_sq") / total).alias("brier"), (F.sum(F.abs(F.col("_sp") - F.col("_sy"))) / total).alias("ece")
    )
    mass = error_from_bins(_mass_bins(dealt, sums, with_counts, make, eceq_bins), ["rep", "_model"], "ece_q")
    sign = F.when(F.col("_model") == 1, 1.0).otherwise(-1.0)
    names = ("logloss", "brier", "ece", "ece_q")
    return flat.join(mass, ["rep", "_model"]).groupBy("rep").agg(*[F.sum(F.col(n) * sign).alias(f"delta_{n}") for n in names], F.lit(groups).cast("long").alias("n_groups"))


def _chunked(tall: DataFrame) -> DataFrame:
    """The rows in order of (model, p, tie, y), written: `_at` rises along the order, CHUNK neighbours of a partition share a `_chunk`.

    The tie-break has done its work then and is dropped; replicate counts never travel with the rows.
    """
    order = ["_model", "_p", "_t", "_y"]
    ranked = tall.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return materialize(ranked.drop("_t").withColumn("_chunk", F.floor(F.col("_at") / F.lit(CHUNK)).cast("long")), "resampled")


def _chunk_sums(rows: DataFrame, make: Callable | None, replicates: int, n_bins: int) -> DataFrame:
    """(_model, _chunk, _bin, rep, sums): rows times their counts in each replicate, by chunk and bin of equal width, in one pass."""
    edges = np.linspace(0.0, 1.0, n_bins + 1)[1:-1]
    keys = ["_model", "_chunk", "_bin"]

    def frame(out: dict) -> pd.DataFrame:
        at, values = np.array(list(out), np.int64), np.stack(list(out.values()))
        made = pd.DataFrame(values.reshape(-1, len(SUMS)), columns=SUMS)
        for i, k in enumerate(keys):
            made[k] = np.repeat(at[:, i], replicates)
        made["rep"] = np.tile(np.arange(replicates), len(at))
        return made[made["_c"] > 0].astype({"_model": "int32", "_bin": "int32", "rep": "int32"})[[*keys, "rep", *SUMS]]

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            model, chunk, p, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_model", "_chunk", "_p", "_y"))
            m = make(b.column("_key").to_numpy()) if make else b.column("_m").flatten().to_numpy().reshape(-1, replicates)
            width = np.searchsorted(edges, p, side="right")
            values = np.column_stack([np.ones(len(p)), p, y, -np.log(np.where(y == 1, p, 1.0 - p)), (p - y) ** 2])
            order = np.lexsort((width, chunk, model))
            at = np.stack([model[order], chunk[order], width[order]], axis=1)
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)])
            for lo, hi in zip(starts, [*starts[1:], len(order)]):
                for s in range(lo, hi, 2048):
                    rows = order[s : min(s + 2048, hi)]
                    where = tuple(at[lo])
                    out[where] = out.get(where, 0.0) + m[rows].T.astype(float) @ values[rows]
            if len(out) >= 256:  # rows that come in another order than that of the chunks
                yield pa.RecordBatch.from_pandas(frame(out), preserve_index=False)
                out = {}
        if out:
            yield pa.RecordBatch.from_pandas(frame(out), preserve_index=False)

    found = rows.mapInArrow(shares, "_model int, _chunk long, _bin int, rep int, " + ", ".join(f"{s} double" for s in SUMS))
    return found.groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in SUMS])


def _mass_bins(dealt: DataFrame, sums: DataFrame, with_counts: Callable[[DataFrame], DataFrame], make: Callable | None, n_bins: int) -> DataFrame:
    """Bins of floor(N / n_bins) resampled rows in order of (p, tie, y), the rest in the last: (rep, _model, _bin, _c, _sp, _sy).

    A prefix scan over the chunks: a chunk inside one bin of a replicate counts as a whole. Only chunks with a bin edge of some
    replicate go back to their rows, which are walked with the totals before them.
    """
    per = sums.groupBy("_model", "_chunk", "rep").agg(*[F.sum(c).alias(c) for c in ("_c", "_sp", "_sy")])
    over = Window.partitionBy("_model", "rep")  # a row for each chunk
    before = F.coalesce(F.sum("_c").over(over.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumns({"_before": before, "_total": F.sum("_c").over(over)})
    per = per.withColumn("_size", F.greatest(F.lit(1.0), F.floor(F.col("_total") / n_bins).cast("double")))
    bin_at = lambda pos: F.least(F.lit(n_bins - 1), F.floor(pos / F.col("_size"))).cast("int")
    per = materialize(per.withColumns({"_bin": bin_at(F.col("_before")), "_last": bin_at(F.col("_before") + F.col("_c") - 1)}), "placed")
    whole = per.where(F.col("_bin") == F.col("_last")).select("rep", "_model", "_bin", "_c", "_sp", "_sy")
    cut = per.where(F.col("_bin") != F.col("_last"))
    heads = cut.groupBy("_model", "_chunk").agg(F.collect_list(F.struct("rep", "_before", "_total", "_size")).alias("_h"))
    heads = heads.select("_model", "_chunk", *[F.col(f"_h.{c}").alias(c) for c in ("rep", "_before", "_total", "_size")])
    rows = with_counts(dealt.join(heads.select("_model", "_chunk"), ["_model", "_chunk"], "left_semi"))

    def walk(part: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(part) and len(head):
            part, h = part.sort_values("_at"), head.iloc[0]
            reps = np.array(h["rep"])
            upto, last, size = (np.array(h[c]).astype(np.int64) for c in ("_before", "_total", "_size"))
            values = np.column_stack([np.ones(len(part)), part["_p"].to_numpy(), part["_y"].to_numpy()])
            for s in range(0, len(part), 2048):
                rows = part.iloc[s : s + 2048]
                m = make(rows["_key"].to_numpy())[:, reps] if make else np.vstack(rows["_m"].to_numpy())[:, reps]
                end = upto + np.cumsum(m, axis=0, dtype=np.int64)
                start, upto = end - m, end[-1]
                for k in range(min(n_bins - 1, int((start[0] // size).min())), min(n_bins - 1, int((upto // size).max())) + 1):
                    inside = np.maximum(np.minimum(end, last if k == n_bins - 1 else (k + 1) * size) - np.maximum(start, k * size), 0)
                    found.append(pd.DataFrame(inside.T @ values[s : s + 2048], columns=["_c", "_sp", "_sy"]).assign(rep=reps, _bin=k))
        out = pd.concat(found) if found else pd.DataFrame({c: [] for c in ("_c", "_sp", "_sy", "rep", "_bin")})
        out = out.groupby(["rep", "_bin"], as_index=False).sum()
        out["_model"] = head["_model"].iloc[0] if len(head) else 0
        return out.astype({"rep": "int32", "_model": "int32", "_bin": "int32"})[["rep", "_model", "_bin", "_c", "_sp", "_sy"]]

    keys = ("_model", "_chunk")  # at most CHUNK rows each
    walked = rows.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInPandas(walk, "rep int, _model int, _bin int, _c double, _sp double, _sy double")
    return whole.unionByName(walked).groupBy("rep", "_model", "_bin").agg(*[F.sum(c).alias(c) for c in ("_c", "_sp", "_sy")]).where("_c > 0")
