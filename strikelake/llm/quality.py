"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

A document becomes STATISTICS, standardised and clipped. Random cosine features approximate a Gaussian kernel over them. Each
partition of the fitting rows adds up its part of the normal equations, of FEATURES^2 numbers; the sums are added and solved on
the driver, whose work doesn't depend on the rows. Scores of rows kept out of the fit are calibrated by isotonic
regression, made continuous between its steps.

Fit on a bounded sample: at most ``max_fit_rows`` labelled rows, by hash order of the id. Every document is scored on its
whole text. Defined cases: a null text is the empty one; rows with a null label or id aren't learnt from; of repeated
labels the largest counts; without labels the score is 0.5, with labels of one class their mean; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikelake.llm.common import byte_rows
from strikelake.llm.wordhash import word_bounds, word_hashes
from strikelake.session import materialize

FEATURES = 256
FIT_PARTITIONS = 8
SEGMENTS = 8
STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "long_words", "upper", "digits", "high_bytes", "stops", "commas", "marks", "symbols", "spaces", "newlines",
    "distinct_words", "top_word", "same_as_before", "repeated_pairs", "segment_upper", "segment_symbols", "segment_repeats", "bars",
)

_CLASS = np.zeros(256, np.int64)
for _name, _bytes in (("upper", range(65, 91)), ("digits", range(48, 58)), ("stops", b"."), ("commas", b","), ("marks", b"!?"), ("symbols", b"#$%&*@^~+=<>/\\_"), ("bars", b"|"), ("spaces", b" "), ("newlines", b"\n"), ("high", range(128, 256))):
    _CLASS[list(_bytes)] = {"upper": 1, "digits": 2, "stops": 3, "commas": 4, "marks": 5, "symbols": 6, "bars": 7, "spaces": 8, "newlines": 9, "high": 10}[_name]


def statistics(text: bytes) -> np.ndarray:
    """The values of STATISTICS for one text."""
    data = np.frombuffer(text, np.uint8)
    kinds = _CLASS[data]
    n = max(1, len(data))
    share = np.bincount(kinds, minlength=11) / n
    starts, ends = word_bounds(data)
    lengths, words = ends - starts, word_hashes(text)
    m = max(1, len(words))
    distinct, counts = np.unique(words, return_counts=True)
    pairs = words[:-1] * np.uint64(3) + words[1:]
    same = words[1:] == words[:-1]
    cut = np.linspace(0, len(data), SEGMENTS + 1).astype(int)[:-1]
    segment = lambda hit: float(np.max(np.add.reduceat(hit, cut) / max(1, len(data) / SEGMENTS))) if len(data) >= SEGMENTS else float(hit.mean() if len(hit) else 0)
    cut_words = np.linspace(0, len(same), SEGMENTS + 1).astype(int)[:-1]
    repeats = float(np.max(np.add.reduceat(same.astype(float), cut_words) / max(1, len(same) / SEGMENTS))) if len(same) >= SEGMENTS else float(same.mean() if len(same) else 0)
    return np.array([
        np.log1p(len(data)), np.log1p(len(words)), lengths.mean() if len(lengths) else 0, (lengths > 24).mean() if len(lengths) else 0, share[1], share[2], share[10], share[3], share[4], share[5], share[6], share[8], share[9],
        len(distinct) / m ** 0.8, counts.max() / m if len(counts) else 0, same.mean() if len(same) else 0, 1 - len(np.unique(pairs)) / max(1, len(pairs)) if len(pairs) else 0,
        segment((kinds == 1).astype(float)), segment(((kinds >= 5) & (kinds <= 7)).astype(float)), repeats, share[7],
    ])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    rotation: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip((raw - self.mean) / self.scale, -6, 6)
        rff = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.rotation + self.phase)
        return np.hstack([rff, z, np.ones((len(raw), 1))])

    def raw_score(self, raw: np.ndarray) -> np.ndarray:
        return self.features(raw) @ self.weights

    def score(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(self.raw_score(raw), self.knots, self.values)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing least-squares fit, one knot per pooled block at its mean score."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(scores[order], labels[order]):
        blocks.append([s, y, 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            s2, y2, n2 = blocks.pop()
            last = blocks[-1]
            last[0], last[1], last[2] = (last[0] * last[2] + s2 * n2) / (last[2] + n2), last[1] + y2, last[2] + n2
    knots, values = np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
    low, high = min(0.0, float(scores.min())) - 1, max(1.0, float(scores.max())) + 1
    return np.concatenate([[low], knots, [high]]), np.concatenate([[0.0], np.clip(values, 0.001, 0.999), [1.0]])


def _statistics_batches(text_at: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [statistics(t) for t in byte_rows(batch.column(text_at))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(values, pa.list_(pa.float64()))], names=[*keep, "x"])

    return run


def labelled(docs: DataFrame, labels: DataFrame, target: str, learn_from: Column, max_rows: int | None, id_col: str, text_col: str) -> DataFrame:
    """(id, y, text) of the labelled documents: all without ``max_rows``, else at most that many, whose labels are broadcast.

    An id that several documents share gives one row, with the smallest of their texts; copies go before the shuffle.
    """
    chosen = (
        labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{target}`").cast("double").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & learn_from)
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    if max_rows is not None:
        chosen = F.broadcast(chosen.orderBy(F.xxhash64("id"), "id").limit(max_rows))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(chosen, "id")
    return rows.groupBy("id", "y").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", learn_from: Column | None = None, max_fit_rows: int = 20_000, ridge: float = 1e-3, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = labelled(docs, labels, target, F.lit(True) if learn_from is None else learn_from, max_fit_rows, id_col, text_col)
    table = materialize(rows.select("text", "y", (F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(4)) == 0).alias("calibrate")).mapInArrow(_statistics_batches(0, ["y", "calibrate"]), "y double, calibrate boolean, x array<double>"), "quality-statistics")
    p = len(STATISTICS)
    moments = table.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[f(F.get("x", F.lit(i))).alias(f"{n}{i}") for i in range(p) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    rng = np.random.default_rng(seed)
    rotation, phase = rng.normal(size=(p, FEATURES)) * np.sqrt(1.0 / p), rng.uniform(0, 2 * np.pi, FEATURES)
    if not moments["n"] or moments["y"] in (0.0, 1.0):
        base = 0.5 if not moments["n"] else moments["y"]
        return Model(np.zeros(p), np.ones(p), rotation, phase, np.zeros(FEATURES + p + 1), np.array([-1.0, 1.0]), np.array([base, base]))
    mean, scale = (np.array([moments[f"{n}{i}"] for i in range(p)]) for n in "ms")
    model = Model(mean, np.maximum(scale, 1e-6), rotation, phase, np.zeros(0), np.zeros(0), np.zeros(0))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES + p + 1
        gram, moment = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column("x").to_pylist()))
                gram += z.T @ z
                moment += z.T @ np.asarray(batch.column("y"))
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([moment.tobytes()])], names=["gram", "moment"])

    parts = table.filter("not calibrate").select("y", "x").repartition(FIT_PARTITIONS).mapInArrow(sums, "gram binary, moment binary").collect()
    gram = sum(np.frombuffer(r["gram"]) for r in parts).reshape(FEATURES + p + 1, -1)
    moment = sum(np.frombuffer(r["moment"]) for r in parts)
    n = gram[-1, -1]
    model.weights = np.linalg.solve(gram + ridge * max(1.0, n) * np.eye(len(gram)), moment)
    held = table.filter("calibrate").select("x", "y").collect()  # a quarter of max_fit_rows
    if not held:
        held = table.select("x", "y").collect()
    model.knots, model.values = isotonic(model.raw_score(np.array([r["x"] for r in held])), np.array([r["y"] for r in held]))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """Adds ``out``, a double from 0 to 1, from the whole text alone."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.array([statistics(t) for t in byte_rows(batch.column(at))]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(raw), pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, out: str = "quality_score", id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    return score(docs, fit(docs, labels, learn_from=learn_from, id_col=id_col, text_col=text_col, **options), text_col, out)


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float, learn_from: Column | None = None) -> DataFrame:
    """The documents whose score reaches ``threshold``, with the columns they came with."""
    kept = classify(docs, labels, learn_from, out="quality_score__").filter(F.col("quality_score__") >= threshold)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
