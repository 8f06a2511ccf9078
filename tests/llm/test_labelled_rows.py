"""Labelled documents whose id repeats: one row per id, however many documents share it."""

from pyspark.sql import functions as F
from strikelake.llm import quality, toxicity


def shared_ids(spark):
    docs = [(7, f"text number {i}") for i in range(400)] + [(i, f"plain words of document {i} " * (1 + i % 5)) for i in range(100, 900)] + [(7, None), (None, "no id"), (8, None)]
    labels = [(i, i % 2, i % 2) for i in [7, 8, *range(100, 900)]]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
        spark.createDataFrame(labels + [(7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"),
    )


def test_one_row_per_labelled_id(spark):
    docs, labels = shared_ids(spark)
    rows = quality.labelled(docs, labels, "quality", F.lit(True), 10_000, "doc_id", "text")
    found = {r.id: (r.text, r.y) for r in rows.collect()}
    assert rows.count() == len(found) == 802
    assert found[7] == ("text number 0", 1.0) and found[8] == (None, 0.0)
    assert quality.labelled(docs, labels, "quality", F.lit(True), 50, "doc_id", "text").count() == 50


def test_models_score_every_document_of_a_shared_id(spark):
    docs, labels = shared_ids(spark)
    for module in (quality, toxicity):
        scores = [r[0] for r in module.classify(docs, labels, out="s").select("s").collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
