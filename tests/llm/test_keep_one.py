"""One row per near-duplicate class, and the pipeline's stages, against brute force."""

import collections
import re

import pytest

from strikelake.llm import ngram_join, quality
from strikelake.llm.common import table

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    """Positions of each class; rows without shingles are classes of their own."""
    sets = [shingles(t) for t in texts]
    holders, root = collections.defaultdict(list), list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = collections.Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    groups = collections.defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(i)
    return list(groups.values())


def one_of_each(rows):
    """Ids that stay: the least of each class, nulls last."""
    groups = brute_groups([t for _, t in rows])
    return collections.Counter(min((rows[i][0] for i in g), key=lambda x: (x is None, x or 0)) for g in groups)


def text(seed, change=None):
    w = [f"w{seed}x{i}" for i in range(60)]
    if change is not None:
        w[change] = "changed"
    return " ".join(w)


CASES = {
    "another text of a copy's id": [(1, text(1)), (5, text(1, 30)), (5, text(2))],
    "copies under one id": [(7, text(1)), (7, text(1, 30)), (8, text(2))],
    "copies without ids": [(None, text(1)), (None, text(1, 30)), (None, text(2)), (3, text(2, 9))],
    "repeated rows": [(1, text(1)), (1, text(1)), (1, text(1, 5)), (2, text(1)), (None, text(3)), (None, text(3))],
    "no shingles": [(1, ""), (1, None), (None, " "), (2, "")],
}


@pytest.mark.parametrize("name", CASES)
def test_one_row_of_each_class_stays(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, t string")
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert collections.Counter(r.doc_id for r in found) == one_of_each(rows)
    assert len(brute_groups([r.text for r in found])) == len(found)


def test_stages_equal_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, sf, "documents")
    pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    ids = lambda rows: collections.Counter(i for i, _ in rows)

    good = stages["quality_filter"](spark, docs, sf).cache()
    scored = quality.classify(docs, table(spark, sf, "labels")).collect()
    assert ids(pairs(good)) == collections.Counter(r.doc_id for r in scored if r.quality_score >= corpus_pipeline.LEAST_QUALITY)
    for start in (good, docs):  # the filter may leave few copies
        best = {}
        for i, t in pairs(start):
            key = (t or "").translate(LOW)
            best[key] = max(best.get(key, i), i)
        single = stages["exact_copies"](spark, start, sf).cache()
        assert ids(pairs(single)) == collections.Counter(best.values())
        far = stages["near_copies"](spark, single, sf).cache()
        assert ids(pairs(far)) == one_of_each(pairs(single))
    mixed = stages["mixture"](spark, far, sf).cache()
    assert set(ids(pairs(mixed))) == set(ids(pairs(far)))
    made = stages["tokens"](spark, mixed, sf).collect()
    assert collections.Counter(r.doc_id for r in made) == ids(pairs(mixed)) and all(r.round_trip for r in made)
