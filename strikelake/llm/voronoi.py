"""Exact top-k inner products by a Voronoi kNN join.

Inner products become distances: a vector x gets one more coordinate sqrt(M^2 - |x|^2), with M the largest norm, a query
gets 0, so the nearest neighbours of a query are those of the largest product. Pivots, a bounded sample, cut both sides into
cells. A first job sums up each data cell (largest distance to its pivot, and the k + 1 ids nearest to it) and each query cell
(its radius); from these bounded summaries follows, per query cell, an upper bound of the k-th nearest distance of
every query in it. A data row is replicated to the query cells whose bound its own lower bound does not exceed, and each cell is
solved by integer products. A cell is cut into slices of rows by a hash of the id and the vector, so neither a vector nor an
id repeated any number of times meets in one task; the slices' best k per query are merged by a second ranking.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id;
shorter vectors are padded with zeros; rows with the id of a query are not its candidates; a repeated query row is answered
once; ties go to the smaller id, then repeated rows of one id count separately; an empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 64
#: Queries of one cell are cut into blocks of this many rows, data into slices of about this many.
QUERY_BLOCK = 1024
SLICE_ROWS = 2048
SLACK = 1e-6


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v: array<double> of the rows that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)))


def quantised(v: Column, scale: int) -> Column:
    return F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column):
        values = x.values.to_numpy(zero_copy_only=False)
        out[i, : len(values)] = values
    return out


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _least(d: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` nearest distinct ids, each with its least distance, in order of distance."""
    order = np.lexsort((ids, d))
    d, ids = d[order], np.asarray(ids, np.int64)[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:most]
    return d[first], ids[first]


def _mixed(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """31 bits of hash of id and integer vector."""
    odd = np.random.default_rng(5).integers(0, 1 << 63, vectors.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    total = (vectors.astype(np.int64).view(np.uint64) * odd).sum(1, dtype=np.uint64) + ids.astype(np.uint64)
    return total * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)


def _lifted(points: np.ndarray, top: float, query: bool) -> np.ndarray:
    extra = np.zeros(len(points)) if query else np.sqrt(np.maximum(top**2 - (points**2).sum(1), 0))
    return np.hstack([points, extra[:, None]])


def top_k(queries: DataFrame, data: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` data rows of the largest integer product for each query row."""
    spark = data.sparkSession
    left = usable(queries, id_col, vec_col).select("vec_id", quantised(F.col("v"), scale).alias("v")).dropDuplicates(["vec_id"])
    right = usable(data, id_col, vec_col).select("vec_id", quantised(F.col("v"), scale).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = right.select(square.alias("s"), F.size("v").alias("w")).agg(F.max("s").alias("s"), F.max("w").alias("w"), F.count(F.lit(1)).alias("n")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    asked = left.select(F.size("v").alias("w")).agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("n")).first()
    if not facts["n"] or not asked["n"]:
        return spark.createDataFrame([], empty)
    width, top = max(facts["w"], asked["w"]), float(np.sqrt(facts["s"])) * (1 + SLACK) + SLACK
    wanted = k + 1  # so many ids hold k rows that aren't the query's own

    sample = right.sample(fraction=min(1.0, 4.0 * PIVOTS / facts["n"]), seed=7).limit(8 * PIVOTS).collect()
    points = np.zeros((max(1, len(sample)), width))
    for i, row in enumerate(sample):
        points[i, : len(row["v"])] = row["v"]
    points = np.unique(_lifted(points, top, False), axis=0)
    pivots = points[np.random.default_rng(7).permutation(len(points))[: max(1, min(PIVOTS, asked["n"] // 64))]]

    def celled(rows: DataFrame, query: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _distances(_lifted(_matrix(batch.column(1), width), top, query), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "v", "cell", "d"])

        return rows.mapInArrow(run, "vec_id long, v array<long>, cell int, d double")

    q, s = celled(left, True), celled(right, False)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per task and cell the rows, the largest distance and the ``wanted`` nearest ids with their least distances."""
        held: dict[int, list] = {}
        for batch in batches:
            for cell, part in batch.groupby("cell"):
                n, far, near = held.get(cell, [0, 0.0, (np.empty(0), np.empty(0, np.int64))])
                held[cell] = [n + len(part), max(far, part["d"].max()), _least(np.concatenate([near[0], part["d"]]), np.concatenate([near[1], part["vec_id"]]), wanted)]
        yield pd.DataFrame([(c, n, far, list(d), list(ids)) for c, (n, far, (d, ids)) in held.items()], columns=["cell", "n", "far", "near", "ids"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        d, ids = _least(np.concatenate(parts["near"].tolist()), np.concatenate(parts["ids"].tolist()), wanted)
        return pd.DataFrame([(parts["cell"].iloc[0], parts["n"].sum(), parts["far"].max(), list(d), list(ids))], columns=["cell", "n", "far", "near", "ids"])

    summary = "cell int, n long, far double, near array<double>, ids array<long>"
    parts = s.select("cell", "d", "vec_id").mapInPandas(nearest, summary)
    cells = {r["cell"]: r for r in parts.groupBy("cell").applyInPandas(merge, summary).collect()}  # one row of wanted ids per pivot
    radius = {r["cell"]: (r["far"], r["n"]) for r in q.groupBy("cell").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    apart = _distances(pivots, pivots)
    bound = {}
    for i, (far, _) in radius.items():
        upper, _ = _least(np.concatenate([far + apart[i, j] + np.array(r["near"]) for j, r in cells.items()]), np.concatenate([r["ids"] for r in cells.values()]), wanted)
        bound[i] = (upper[wanted - 1] if len(upper) >= wanted else np.inf) * (1 + SLACK) + SLACK
    targets = sorted(radius)
    # Rows a query cell may receive, from the cells' own ranges, give its number of slices.
    slices = {i: max(1, -(-sum(r["n"] for j, r in cells.items() if apart[i, j] - radius[i][0] - r["far"] <= bound[i]) // SLICE_ROWS)) for i in targets}
    blocks = {i: max(1, -(-radius[i][1] // QUERY_BLOCK)) for i in targets}

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each data row once for every query cell and block that needs it."""
        for batch in batches:
            ids, cell, d = (np.asarray(batch.column(i)) for i in (0, 2, 3))
            mixed = _mixed(ids, _matrix(batch.column(1), width))
            for i in targets:
                gap = apart[i, cell]
                # Both triangle bounds: around the row's own pivot and around the query cell's.
                need = np.flatnonzero(np.maximum(gap - radius[i][0] - d, d - gap - radius[i][0]) <= bound[i])
                if len(need):
                    part = batch.take(pa.array(need))
                    piece = mixed[need] % np.uint64(slices[i])
                    for b in range(blocks[i]):
                        n = len(need)
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(piece.astype(np.int32))], names=["vec_id", "v", "cell", "block", "slice"])

    replicated = s.mapInArrow(sent, "vec_id long, v array<long>, cell int, block int, slice int")
    block_of = F.create_map(*[F.lit(x) for i in targets for x in (i, blocks[i])])
    slice_of = F.create_map(*[F.lit(x) for i in targets for x in (i, slices[i])])
    asked_rows = q.select("vec_id", "v", "cell", F.pmod(F.xxhash64("vec_id"), block_of[F.col("cell")]).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), slice_of[F.col("cell")] - 1)).alias("slice"))

    def solve(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(a) and len(b):
            stack = lambda frame: np.array([np.pad(np.asarray(x, np.int64), (0, width - len(x))) for x in frame["v"]])
            order = np.argsort(b["vec_id"].to_numpy(), kind="stable")
            ids, points = b["vec_id"].to_numpy()[order], stack(b)[order]
            for query, scores in zip(a["vec_id"].to_numpy(), stack(a) @ points.T):
                keep = np.flatnonzero(ids != query)
                best = keep[np.argsort(-scores[keep], kind="stable")[:k]]
                out["query_id"] += [query] * len(best)
                out["vec_id"] += ids[best].tolist()
                out["score"] += scores[best].tolist()
        return pd.DataFrame(out)

    keys = ["cell", "block", "slice"]
    found = asked_rows.groupBy(*keys).cogroup(replicated.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
