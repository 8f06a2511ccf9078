"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is embedded as the sum of two hashed rows, one for the word and one for its first PREFIX bytes; buckets that few texts
of the training rows have share a zero row, and one coordinate starts at a cautious log-odds of the bucket's texts. Filters of several
widths slide over the embeddings; each filter's largest response over the
whole text feeds a logistic output. Training is data parallel: shards of about SHARD_ROWS rows each run epochs of sparse
Adagrad steps from the same parameters, and Spark averages what they moved (an embedding row over the
shards that moved it). Thresholds are calibrated by language, which is guessed from the text's own letters, and are turned
into score shifts, so that 0.5 is the threshold of every language.

Fit on all labelled rows, of which a seventh sets the thresholds; more rows give more shards. Defined cases: null and empty texts score as texts without
words; rows with a null label or id aren't learnt from; of repeated labels the largest counts; without labels of both classes
the score is 0; very long texts are read in pieces that overlap by the widest filter; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikelake.llm.common import LOWER_BYTES, byte_rows
from strikelake.llm.quality import labelled
from strikelake.llm.wordhash import PUNCTUATION, word_hashes
from strikelake.operators.ranks import with_running_sum
from strikelake.session import materialize

BUCKETS, DIMENSION, WIDTHS, FILTERS, PREFIX = 1 << 18, 12, (1, 2, 3), 8, 5
SHARDS, SHARD_ROWS, ROUNDS = 6, 3_500, 4  # a row in SHARDS + 1 calibrates
PIECE = 1 << 16
LANGUAGES = ("plain", "acute", "umlaut", "grave")


def buckets(text: bytes) -> np.ndarray:
    """(words, 2): the buckets of each word and of its beginning."""
    low = text.translate(LOWER_BYTES)
    whole, head = word_hashes(low, PUNCTUATION), word_hashes(low, PUNCTUATION, PREFIX)
    return np.column_stack([whole >> np.uint64(46), (head * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(46)]).astype(np.int32)


def language(text: bytes) -> int:
    """Index of LANGUAGES: which accented letters a text has most of."""
    counts = [0, text.count(b"\xc3\xb1") + text.count(b"\xc3\xb3") + text.count(b"\xc3\xad"), text.count(b"\xc3\xa4") + text.count(b"\xc3\xbc") + text.count(b"\xc3\xb6") + text.count(b"\xc3\x9f"), text.count(b"\xc3\xa8") + text.count(b"\xc3\xaa") + text.count(b"\xc3\xa7") + text.count(b"\xc3\xa9")]
    best = int(np.argmax(counts))
    return best if counts[best] * 200 > len(text) else 0


@dataclass
class Network:
    ids: np.ndarray  # row of ``words`` for each bucket; row 0 is zero
    words: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIMENSION, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    @classmethod
    def start(cls, seed: int, having: np.ndarray, having_toxic: np.ndarray, n: int, n_toxic: int) -> Network:
        """Rows for the buckets that at least 5 texts, or one of a thousand, have; the counts are those of the training texts."""
        rng = np.random.default_rng(seed)
        f32 = lambda x: x.astype(np.float32)
        used = np.flatnonzero(having >= max(5, n // 1000))
        ids = np.zeros(BUCKETS, np.int32)
        ids[used] = np.arange(1, len(used) + 1)
        yes, no = having_toxic[used] + 0.5, having[used] - having_toxic[used] + 0.5
        odds = np.log(yes / (n_toxic + 1)) - np.log(no / (n - n_toxic + 1))
        odds = np.sign(odds) * np.maximum(np.abs(odds) - 2 * np.sqrt(1 / yes + 1 / no), 0)
        words = rng.normal(0, 0.02, (len(used) + 1, DIMENSION))
        words[1:, 0] = np.clip(odds, -3, 3) / 3
        words[0] = 0
        filters = [f32(rng.normal(0, 0.1, (w, DIMENSION, FILTERS))) for w in WIDTHS]
        for filt in filters:
            filt[:, 0, ::2] += 1.0 / len(filt)
        return cls(ids, f32(words), filters, np.full(len(WIDTHS) * FILTERS, -0.2, np.float32), f32(np.concatenate([np.full(len(WIDTHS) * FILTERS, 0.2), [-2.0]])))

    def embedded(self, tokens: np.ndarray) -> np.ndarray:
        return self.words[self.ids[tokens[:, 0]]] + self.words[self.ids[tokens[:, 1]]]

    def responses(self, tokens: np.ndarray) -> list[np.ndarray]:
        """Per width the filter responses at every position; the text is padded with zeros at its end."""
        x = self.embedded(tokens)
        made = []
        for w, filt in zip(WIDTHS, self.filters):
            r = x @ filt[0]
            for k in range(1, w):
                r[: len(x) - k] += x[k:] @ filt[k]
            made.append(r)
        return made

    def pooled(self, tokens: np.ndarray) -> np.ndarray:
        best = np.full(len(self.bias), -self.bias)  # a text without words: no response
        for start in range(0, len(tokens), PIECE):
            # The words after a piece are there to complete its own responses; theirs are cut and belong to the next piece.
            piece = tokens[start : start + PIECE + max(WIDTHS) - 1]
            own = np.concatenate([r[:PIECE].max(0) for r in self.responses(piece)])
            best = np.maximum(best, own) if start else own
        return np.maximum(best + self.bias, 0)

    def logit(self, tokens: np.ndarray) -> float:
        return float(self.pooled(tokens) @ self.out[:-1] + self.out[-1])

    def flat(self) -> list[np.ndarray]:
        return [self.words, *self.filters, self.bias, self.out]

    def copy(self) -> Network:
        return Network(self.ids, self.words.copy(), [f.copy() for f in self.filters], self.bias.copy(), self.out.copy())


def train_epoch(net: Network, texts: list[np.ndarray], labels: np.ndarray, seed: int, rate: float = 0.08, positive: float = 3.0, decay: float = 1e-5) -> None:
    """One pass of Adagrad steps, a text at a time; only the words under the winning positions move."""
    rng = np.random.default_rng(seed)
    memory = [np.full(p.shape if i else (len(p), 1), 1e-2, np.float32) for i, p in enumerate(net.flat())]
    for i in rng.permutation(len(texts)):
        tokens, y = texts[i], labels[i]
        if not len(tokens):
            continue
        rows = net.responses(tokens)
        where = [r.argmax(0) for r in rows]
        before = np.concatenate([r[at, np.arange(FILTERS)] for r, at in zip(rows, where)]) + net.bias
        pool = np.maximum(before, 0)
        logit = float(pool @ net.out[:-1] + net.out[-1])
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * (positive if y else 1.0)
        g_out = np.append(pool, 1.0).astype(np.float32) * error + decay * net.out
        g_pool = error * net.out[:-1] * (before > 0)
        for n, (w, at) in enumerate(zip(WIDTHS, where)):
            g = g_pool[n * FILTERS : (n + 1) * FILTERS].astype(np.float32)
            live = np.flatnonzero(g)
            if not len(live):
                continue
            filt = net.filters[n]
            for k in range(w):
                pos = at[live] + k
                inside = pos < len(tokens)
                f, p = live[inside], net.ids[tokens[pos[inside]]]
                x, column = net.words[p].sum(1), filt[k][:, f]
                step = np.zeros((DIMENSION, FILTERS), np.float32)
                step[:, f] = x.T * g[f]
                move = column.T * g[f][:, None]
                memory[1 + n][k] += step**2
                filt[k] -= rate * 0.3 * step / np.sqrt(memory[1 + n][k])
                for side in p.T:
                    np.add.at(memory[0][:, 0], side, (move**2).mean(1))
                    np.add.at(net.words, side, -rate * 0.3 * move / np.sqrt(memory[0][side]))
                net.words[0] = 0
        memory[-2] += g_pool**2
        net.bias -= rate * 0.3 * g_pool.astype(np.float32) / np.sqrt(memory[-2])
        memory[-1] += g_out**2
        net.out -= rate * 0.3 * g_out / np.sqrt(memory[-1])


def moves(base: Network, trained: Network) -> tuple[np.ndarray, np.ndarray]:
    """(row, values): the embedding rows that training has moved, and all other parameters in rows -1, -2 and so on."""
    words = trained.words - base.words
    hit = np.flatnonzero(np.abs(words).max(1) > 0)
    rest = np.concatenate([(t - b).ravel() for t, b in zip(trained.flat()[1:], base.flat()[1:])])
    rest = np.append(rest, np.zeros(-len(rest) % DIMENSION, np.float32)).reshape(-1, DIMENSION)
    return np.concatenate([hit, -1 - np.arange(len(rest))]), np.concatenate([words[hit], rest]).astype(np.float64)


def merge(base: Network, row: np.ndarray, mean: np.ndarray) -> Network:
    """The base with the mean move of each row of `moves` over the shards that moved it."""
    made = base.copy()
    made.words[row[row >= 0]] += mean[row >= 0].astype(np.float32)
    rest = mean[row < 0][np.argsort(-row[row < 0])].ravel()
    for p in made.flat()[1:]:
        p += rest[: p.size].reshape(p.shape).astype(np.float32)
        rest = rest[p.size :]
    return made


def best_thresholds(rated: DataFrame) -> dict[int, tuple[float, float]]:
    """Language (-1: all) -> (positives, the logit between two texts that gives the best F1), over all rows (y, g, z).

    Distinct logits are counted, and running sums in falling order give the hits above each of them.
    """
    tall = rated.select("y", "z", F.explode(F.array(F.lit(-1), F.col("g"))).alias("k"))
    counted = tall.groupBy("k", (-F.col("z")).alias("_o")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("hits"))
    upto = with_running_sum(counted, ["k"], ["_o"], F.col("n"), "_n")
    upto = with_running_sum(upto, ["k"], ["_o"], F.col("hits"), "_hits", "_all")
    f1 = 2 * F.col("_hits") / (F.col("_n") + F.col("_all"))
    best = upto.groupBy("k").agg(F.max("_all").alias("all"), F.min_by("_o", F.struct(-f1, "_o")).alias("o")).collect()  # a row per language
    if not best:
        return {}
    behind = [F.min(F.when((F.col("k") == b["k"]) & (F.col("_o") > F.lit(b["o"])), F.col("_o"))) for b in best]
    after = counted.agg(*behind).first()
    return {b["k"]: (float(b["all"]), -(b["o"] + (b["o"] + 1 if o is None else o)) / 2) for b, o in zip(best, after)}


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = list(byte_rows(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("part"), batch.column("h"), pa.array([language(t) for t in texts], pa.int32()), pa.array([buckets(t).tobytes() for t in texts], pa.binary())], names=["y", "part", "h", "lang_guess", "tokens"])


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", learn_from: Column | None = None, seed: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Network:
    rows = labelled(docs, labels, target, F.lit(True) if learn_from is None else learn_from, None, id_col, text_col)
    part = F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(SHARDS + 1)).cast("int")  # the last part calibrates
    table = materialize(rows.select("text", "y", part.alias("part"), F.xxhash64("id").alias("h")).mapInArrow(_tokens, "y double, part int, h long, lang_guess int, tokens binary"), "toxicity-tokens")
    wanted = max(1, -(-table.count() * SHARDS // ((SHARDS + 1) * SHARD_ROWS)))  # few rows are not thinned out over many shards
    shard = F.pmod("h", F.lit(wanted)).cast("int")
    # Dealt once; the rows of a shard are neighbours in a file, and every pass reads the files.
    shards = table.filter(F.col("part") < SHARDS).withColumn("part", shard).repartition(wanted, "part").sortWithinPartitions("part", "h")
    shards = materialize(shards, "toxicity-shards")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that have each bucket, all and toxic ones; bucket -1 counts the texts."""
        having = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for y, t in zip(batch.column("y"), batch.column("tokens")):
                own = np.append(np.unique(np.frombuffer(t.as_py(), np.int32)), -1)
                for side in (0, 1) if y.as_py() else (0,):
                    having[side, own] += 1
        met = np.flatnonzero(having[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.where(met == BUCKETS, -1, met)), pa.array(having[0, met]), pa.array(having[1, met])], names=["bucket", "n", "n_toxic"])

    counted = shards.mapInArrow(count, "bucket long, n long, n_toxic long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    rows = counted.filter("n >= 5 or bucket = -1").toArrow()  # at most BUCKETS rows of numbers
    bucket, counts = rows.column("bucket").to_numpy(), np.stack([rows.column("n").to_numpy(), rows.column("n_toxic").to_numpy()])
    n, n_toxic = counts[:, bucket < 0].sum(1)
    having = np.zeros((2, BUCKETS), np.int64)
    having[:, bucket[bucket >= 0]] = counts[:, bucket >= 0]
    net = Network.start(seed, having[0], having[1], n, n_toxic)
    if not 0 < n_toxic < n:
        net.out[:], net.shift[:] = 0, -30
        return net

    cells = [f"d{i}" for i in range(DIMENSION)]
    for turn in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def trained(part: int, texts: list, ys: list) -> pa.RecordBatch:
                own = shared.value.copy()
                train_epoch(own, texts, np.array(ys), seed * 100 + turn * 10 + part)
                row, values = moves(shared.value, own)
                return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *[pa.array(values[:, i]) for i in range(DIMENSION)]], names=["row", *cells])

            now, texts, ys = None, [], []
            for batch in batches:
                for part, y, t in zip(batch.column("part").to_pylist(), batch.column("y").to_pylist(), batch.column("tokens")):
                    if part != now and texts:
                        yield trained(now, texts, ys)
                        texts, ys = [], []
                    now = part
                    texts.append(np.frombuffer(t.as_py(), np.int32).reshape(-1, 2))
                    ys.append(y)
            if texts:
                yield trained(now, texts, ys)

        found = shards.mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in cells))
        mean = found.groupBy("row").agg(*[F.avg(c).alias(c) for c in cells]).toArrow()  # at most a row per bucket
        net = merge(net, mean.column("row").to_numpy(), np.column_stack([mean.column(c).to_numpy() for c in cells]))
        shared.destroy()

    rating = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = rating.value
        for batch in batches:
            values = [trained.logit(np.frombuffer(t.as_py(), np.int32).reshape(-1, 2)) for t in batch.column("tokens")]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("part"), batch.column("lang_guess"), pa.array(values, pa.float64())], names=["y", "part", "g", "z"])

    logits = materialize(table.mapInArrow(rated, "y double, part int, g int, z double"), "toxicity-logits")
    held = logits.filter(F.col("part") == SHARDS)
    if (held.agg(F.sum("y")).first()[0] or 0) < 8:  # too few to calibrate on
        held = logits
    best = best_thresholds(held)
    for i in range(len(LANGUAGES)):
        positives, at = best.get(i, (0, 0.0))
        net.shift[i] = -(at if positives >= 8 else best[-1][1])
    return net


def score(docs: DataFrame, net: Network, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """Adds ``out``, a double from 0 to 1; 0.5 is the threshold of the text's language."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            values = [net.logit(buckets(t)) + net.shift[language(t)] for t in byte_rows(batch.column(at))]
            made = 1 / (1 + np.exp(-np.clip(np.array(values, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, out: str = "toxicity", id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    return score(docs, fit(docs, labels, learn_from=learn_from, id_col=id_col, text_col=text_col, **options), text_col, out)
