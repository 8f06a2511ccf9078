"""Toxicity learns from every labelled row, in more shards where there are more rows, and sets thresholds over all held ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from strikelake.llm import toxicity


def best_threshold(logits, labels):
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(hits) + 1) + labels.sum())
    best = int(np.argmax(f1))
    below = logits[order[best + 1]] if best + 1 < len(order) else logits[order[best]] - 1
    return float(logits[order[best]] + below) / 2


def test_every_labelled_row_is_learnt_from(spark, monkeypatch):
    written, keep = {}, toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, name="stage": written.setdefault(name, keep(df, name)))
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    n = 12_600
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), (F.col("id") % 40).cast("string"), F.when(F.col("id") % 7 == 0, " badword").otherwise(" fine")).alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0).alias("toxic"))
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1000, raising=False)
    net = toxicity.fit(docs, labels)
    assert written["toxicity-tokens"].count() == n
    shards = written["toxicity-shards"].groupBy("part").count().collect()
    assert len(shards) == 11 and sum(r["count"] for r in shards) == written["toxicity-tokens"].where(F.col("part") < toxicity.SHARDS).count()
    values = [net.logit(toxicity.buckets(t)) + net.shift[0] for t in (b"word3 badword", b"word3 fine")]
    assert values[0] > 0 > values[1]


def test_thresholds_equal_a_plain_search(spark):
    rng = np.random.default_rng(4)
    z, g = rng.normal(size=600), rng.integers(0, 3, 600)
    y = (z + rng.normal(size=600) > 1).astype(float)
    found = toxicity.best_thresholds(spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(y, g, z)], "y double, g int, z double").repartition(5))
    for k in (-1, 0, 1, 2):
        own = np.ones(600, bool) if k < 0 else g == k
        assert found[k][0] == y[own].sum() and found[k][1] == pytest.approx(best_threshold(z[own], y[own]), abs=1e-12)
    assert toxicity.best_thresholds(spark.createDataFrame([], "y double, g int, z double")) == {}
