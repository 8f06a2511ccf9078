"""Spelling variants against a brute force over all pairs of words."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from strikelake.llm import queries, spelling

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def random_counts(seed, n, letters, sizes):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.choice(sizes))): rng.choice((5, 6, 9, 30, 31, 200, 1000, 30000)) for _ in range(n)}


@pytest.mark.parametrize("counts", [
    random_counts(1, 400, "ab", (6, 7, 8, 9)), random_counts(2, 300, "aé", (6, 7)), random_counts(3, 200, "abcdefgh", (2, 3)),
    {"recieve": 5, "receive": 25, "recieves": 5, "receiver": 25, "x" * 500: 5, "x" * 501: 25, "x" * 250 + "y" + "x" * 249: 5}, {"lonely": 7}, {},
])
@pytest.mark.parametrize("hot", [1, spelling.HOT_PAIRS])
def test_variants_equal_brute_force(spark, counts, hot, monkeypatch):
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (hot,))
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.group_variants(rows).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(brute(counts))


def test_word_counts_with_edits(spark):
    rng = random.Random(5)
    pool = ["hydrogen", "oxygène", "Straßen", "ÀÉÎÕÜ×÷", "nitrogen", "short", "HELIUMS"]
    texts = [" ".join(rng.choice(pool) for _ in range(200)) + "9nitrogenß-oxygène" for _ in range(30)]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1), (3, texts[3], "x", 1), (90, None, "x", 1), (91, "", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)
    want = collections.Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += 1
    found = spelling.word_counts(docs, 6, 5, queries._edited)
    assert {r.word: r.n for r in found.collect()} == {w: n for w, n in want.items() if n >= 5 and len(w) >= 6}
    plain = spelling.word_counts(docs, 3, 1)
    assert plain.filter(F.col("word") == "short").first().n == sum(t.count("short") for _, t, *_ in rows if t)
    assert spelling.word_counts(docs.limit(0)).count() == 0


def test_long_chain_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(40)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {f"w{i}": "w40" for i in range(40)}
