"""One id over a third of the rows: right results, bounded summaries, spread slices."""

import numpy as np
import pytest

from strikelake.llm import voronoi


@pytest.mark.parametrize("slice_rows", [2048, 16])
def test_an_id_of_a_third_of_the_rows(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(voronoi, "SLICE_ROWS", slice_rows)
    kept = []
    least = voronoi._least
    monkeypatch.setattr(voronoi, "_least", lambda d, ids, most: kept.append(most) or least(d, ids, most))
    rng = np.random.default_rng(1)
    vectors = [(7 if i % 3 == 0 else i, rng.normal(size=6).tolist()) for i in range(900)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    made = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in vectors]
    asked = {i: v for i, v in made if i % 10 == 1}
    expected = set()
    for q, v in asked.items():
        best = sorted((-int(v @ x), i) for i, x in made if i != q)[:10]
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    found = voronoi.top_k(table.filter("vec_id % 10 = 1"), table).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == expected
    assert set(kept) == {11}  # ids a summary holds, whatever the rows of one id


def test_slices_part_the_vectors_of_one_id():
    vectors = np.floor(1024 * np.random.default_rng(2).normal(size=(4000, 5)))
    counts = np.bincount((voronoi._mixed(np.full(4000, 7), vectors) % np.uint64(8)).astype(int), minlength=8)
    assert counts.min() > 350
