"""Language identification by mixtures: each text is taken as a mixture of languages, whose proportions EM estimates.

Training counts hashed n-grams of letters per language over labelled texts. A text's n-grams are then draws from a mixture of the
languages' n-gram distributions. The most likely single language is the first set; EM on all languages orders them by
proportion, and the sets of the 2, 3, ... first languages are fitted in turn while the log-likelihood less a penalty for each
language rises. The proportions in the set selected are returned; the largest names the text's language.

N-grams are over letters: texts are lower-cased, everything else is one space. Neighbouring n-grams share letters, so their
likelihood is divided by n, here by raising the penalty. Fit on a bounded sample: about ``max_fit_rows`` labelled rows of each language, picked by a hash of
id and text; at most MAX_LANGUAGES languages, the most frequent ones, are learnt. Every text is read whole, in pieces of PIECE.

Defined cases: null texts and texts without a letter get ``und`` and score 0; rows with a null language, or whose text has no
letter, aren't learnt from; without learnt languages every text gets ``und``; of equal proportions the first language in
code-point order counts; repeated rows are learnt from as often as they come; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikelake.session import materialize

GRAM = 3
BUCKETS = 1 << 16
MAX_LANGUAGES = 256
PIECE = 1 << 20
#: Rounds of EM.
ROUNDS = 12
SMOOTHING = 0.5
UNKNOWN = "und"

#: Letters keep their byte, bytes of longer characters too; all else is a space.
_LETTER = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _gram_buckets(data: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of letters of a piece, in order; runs of spaces count as one."""
    symbols = _LETTER[data]
    symbols = symbols[(symbols != 32) | np.concatenate(([True], symbols[:-1] != 32))]
    code = np.zeros(max(0, len(symbols) - GRAM + 1), np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | symbols[k : k + len(code)]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text and how often each comes."""
    data = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    if len(data) <= PIECE:
        return np.unique(_gram_buckets(data), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(data) - GRAM + 1, PIECE):  # pieces overlap by an n-gram less one; a run of spaces may count twice
        total += np.bincount(_gram_buckets(data[start : start + PIECE + GRAM - 1]), minlength=BUCKETS)
    buckets = np.flatnonzero(total)
    return buckets.astype(np.uint32), total[buckets]


@dataclass
class Model:
    languages: list[str]
    #: BUCKETS x languages: the chance of an n-gram in each.
    chances: np.ndarray


def fit(docs: DataFrame, learn_from: Column | None = None, max_fit_rows: int = 5_000, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.lit(True) if learn_from is None else learn_from))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, max_fit_rows / r["n"]))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                if has_letter(words := text.as_py()):
                    buckets, n = gram_counts(words)
                    totals.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))[buckets] += n
        for lang, total in totals.items():
            buckets = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(buckets), pa.string()), pa.array(buckets, pa.int32()), pa.array(total[buckets], pa.int64())], names=["lang", "bucket", "n"])

    counted = picked.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row for each language: lists of at most BUCKETS numbers.
    found = materialize(counted.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")), "language-grams").orderBy("lang").toLocalIterator()
    languages, columns = [], []
    for row in found:
        total = np.full(BUCKETS, SMOOTHING)
        total[row["buckets"]] += row["counts"]
        languages.append(row["lang"])
        columns.append((total / total.sum()).astype(np.float32))
    return Model(languages, np.stack(columns, 1) if columns else np.zeros((BUCKETS, 0), np.float32))


def _mixture(chances: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by EM over all columns of ``chances`` (n-grams x languages), and their log-likelihood."""
    share, total = np.full(chances.shape[1], 1 / chances.shape[1], np.float32), counts.sum()
    for _ in range(ROUNDS):
        share = share * (counts / (chances @ share) @ chances) / total
    return share, float(counts @ np.log(chances @ share))


def proportions(model: Model, buckets: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The selected mixture of a text given by its n-gram counts."""
    chances, counts = model.chances[buckets], counts.astype(np.float32)
    k = chances.shape[1]
    price = GRAM * penalty * float(np.log(max(2.0, counts.sum())))
    alone = counts @ np.log(chances)
    best = np.zeros(k, np.float32)
    best[int(np.argmax(alone))] = 1
    value = float(alone.max())
    if float(counts @ np.log(chances.max(1))) - value <= price:
        return best  # no mixture can be worth a second language
    order = np.argsort(-_mixture(chances, counts)[0], kind="stable")
    for m in range(2, k + 1):
        share, likelihood = _mixture(np.ascontiguousarray(chances[:, order[:m]]), counts)
        if likelihood - price * (m - 1) <= value:
            break
        value = likelihood - price * (m - 1)
        best = np.zeros(k, np.float32)
        best[order[:m]] = share
    return best


def identify(docs: DataFrame, model: Model, penalty: float = 2.0, text_col: str = "text", out: str = "lang_pred", score: str = "lang_score", mixture: str = "lang_mixture") -> DataFrame:
    """Adds the language, its proportion (0 to 1) and the map of the selected languages' proportions.

    ``penalty`` counts for each language, times the logarithm of the number of n-grams.
    """
    added = [T.StructField(out, T.StringType(), False), T.StructField(score, T.DoubleType(), False), T.StructField(mixture, T.MapType(T.StringType(), T.DoubleType(), False), False)]
    schema = T.StructType([*docs.schema.fields, *added])
    at, names = docs.columns.index(text_col), model.languages
    shared = docs.sparkSession.sparkContext.broadcast(model.chances)  # BUCKETS x at most MAX_LANGUAGES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(names, shared.value)
        for batch in batches:
            found: list[tuple[str, float, list]] = []
            for text in batch.column(at):
                if not names or not text.is_valid or not has_letter(words := text.as_py()):
                    found.append((UNKNOWN, 0.0, []))
                    continue
                share = proportions(own, *gram_counts(words), penalty)
                top = int(np.argmax(share))
                found.append((names[top], min(1.0, float(share[top])), [(names[j], float(share[j])) for j in np.flatnonzero(share > 0)]))
            columns = [pa.array(x, kind) for x, kind in zip(zip(*found) if found else ((), (), ()), (pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, out, score, mixture])

    return docs.mapInArrow(run, schema)
