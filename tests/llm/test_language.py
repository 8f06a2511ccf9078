"""Language identification: EM against a plain loop, the selection of languages, held-out accuracy, defined cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikelake.llm import language

WORDS = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "quick brown fox jumps over".split(), "cc": "zwölf große Straßen über Flüsse".split()}


def text_of(lang, n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def training():
    out = [(i, text_of(lang, 40, i), lang, "x", 0.5) for i, lang in enumerate(itertools.islice(itertools.cycle(WORDS), 90))]
    return out + [(200, None, "aa", "x", 0.5), (201, "", "bb", "x", 0.5), (202, "123 !?", "dd", "x", 0.5), (203, "lorem", None, "x", 0.5), (None, text_of("aa", 9, 1), "aa", "x", 0.5), out[0]]


SCHEMA = "doc_id long, text string, lang string, bucket string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(training(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs)


def test_counts_equal_a_plain_loop():
    text = "Été 12 l'été,  ÉTÉ x"
    clean = " " + " ".join("".join(c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in text.lower()).split()) + " "
    data = clean.encode()
    buckets, counts = language.gram_counts(text)
    want = {}
    for i in range(len(data) - 2):
        code = int.from_bytes(data[i : i + 3], "big") * 0x9E3779B1 % (1 << 32) >> 16
        want[code] = want.get(code, 0) + 1
    assert dict(zip(buckets.tolist(), counts.tolist())) == want


def test_pieces_count_alike(monkeypatch):
    text = "".join(random.Random(3).choice("abcdéx") for _ in range(5000))
    whole = [x.tolist() for x in language.gram_counts(text)]
    monkeypatch.setattr(language, "PIECE", 64)
    assert [x.tolist() for x in language.gram_counts(text)] == whole


def test_mixture_equals_a_plain_loop(model):
    buckets, counts = language.gram_counts(text_of("aa", 30, 1) + " " + text_of("cc", 10, 2))
    share, likelihood = language._mixture(model.chances[buckets], counts.astype(np.float32))
    p = [1 / 3] * 3
    for _ in range(language.ROUNDS):
        new = [0.0] * 3
        for c, n in zip(model.chances[buckets].tolist(), counts.tolist()):
            z = sum(x * y for x, y in zip(p, c))
            for k in range(3):
                new[k] += n * p[k] * c[k] / z
        p = [x / counts.sum() for x in new]
    assert np.allclose(share, p, atol=1e-4)
    assert np.isclose(likelihood, sum(n * np.log(sum(x * y for x, y in zip(p, c))) for c, n in zip(model.chances[buckets].tolist(), counts.tolist())), rtol=1e-4)


def test_selection_by_penalised_likelihood(model):
    buckets, counts = language.gram_counts(text_of("aa", 60, 1) + " " + text_of("cc", 20, 2))
    chances, n = model.chances[buckets], counts.astype(np.float32)
    value = {}
    for size in (1, 2, 3):
        for names in itertools.combinations(range(3), size):
            value[names] = language._mixture(np.ascontiguousarray(chances[:, names]), n)[1] / language.GRAM - 2.0 * size * np.log(n.sum())
    picked = tuple(np.flatnonzero(language.proportions(model, buckets, counts, 2.0)).tolist())
    assert picked == max(value, key=value.get) == (0, 2)
    assert np.count_nonzero(language.proportions(model, buckets, counts, 1e6)) == 1


def test_identify(spark, docs, model):
    assert model.languages == ["aa", "bb", "cc"]
    rows = [(i, text_of(lang, 30, 1000 + i), lang) for i, lang in enumerate(WORDS)] + [(7, None, "und"), (8, "", "und"), (9, "12 !?", "und"), (10, "日本語", None), (11, "quick " * 300_000, "bb")]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, bucket string"), model)
    assert found.columns == ["doc_id", "text", "bucket", "lang_pred", "lang_score", "lang_mixture"]
    for r in found.collect():
        assert r.lang_pred == r.bucket or r.bucket is None and r.lang_pred in WORDS
        assert 0 <= r.lang_score <= 1 and abs(sum(r.lang_mixture.values()) - (r.lang_pred != "und")) < 1e-3
    mixed = language.identify(spark.createDataFrame([(1, text_of("aa", 60, 1) + " " + text_of("bb", 30, 2))], "doc_id long, text string"), model).first()
    assert mixed.lang_pred == "aa" and set(mixed.lang_mixture) == {"aa", "bb"} and 0.5 < mixed.lang_score < 0.8


def test_nothing_learnt(spark, docs):
    model = language.fit(docs, learn_from=F.lit(False))
    assert {(r.lang_pred, r.lang_score) for r in language.identify(docs, model).collect()} == {("und", 0.0)}
    assert language.fit(docs.limit(0)).languages == [] and language.identify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    from strikelake.llm import queries

    found = queries.QUERIES["op12_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert held.n > 100 and held.right > 0.97
