"""Corpus pipeline: quality filter, exact dedup, near-duplicate dedup, mixing, tokens.

Each stage takes the documents its predecessor kept and works on all of them. Stages but the last return the columns they
were given; the last adds token ids. Nulls, empty texts, repeated rows, extra columns and empty tables are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelake.llm import bpe, exact_dedup, mixing, ngram_join, quality
from strikelake.llm.common import configure, table
from strikelake.llm.queries import tokenizer_path
from strikelake.session import materialize

#: Documents whose calibrated chance of being good is below this go.
LEAST_QUALITY = 0.5
#: Language shares are raised to this power; every document stays at least once.
MIXING_ALPHA = 0.8


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    domains = mixing.labelled_domains(docs, table(spark, sf_dir, "labels"))
    return mixing.resample(docs, domains, mixing.tempered_targets(MIXING_ALPHA), least=1.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding the ids gives the text back."""
    configure(spark)
    back = bpe.encode(docs.select("doc_id", "text"), tokenizer_path(), decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Models and tokens have no SQL form; the pipeline is tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
