"""Exact dedup by a content sort.

Sampled splitters range-partition the rows by their normalised text (a bounded prefix of its bytes, then a hash for the
many texts that start alike), an external sort puts equal texts next to each other, and the window compares neighbours by
their full text. Texts that a bounded sample shows to own more rows than one partition should get carry a salt, so
that they are sorted in several places; the totals of those few texts are one small aggregate.

Defined cases: a null text equals the empty one; lower-casing touches A-Z only; a null id never wins over another id;
rows that repeat an id and a text all count in ``group_size`` and exactly one of them is kept; an empty table gives an
empty result. Only the id and text columns are read, other columns pass through ``annotate`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikelake.llm.common import ascii_lower, shuffle_partitions

#: Rows sampled to find texts that own a large share; a text is salted from HOT_HITS of them. Neither changes results.
HOT_SAMPLE = 20_000
HOT_HITS = 8


def _normal(text_col: str):
    return ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def hot_texts(docs: DataFrame, text_col: str) -> list[int]:
    """Hashes of texts seen often in the sample; at most HOT_SAMPLE / HOT_HITS of them, about."""
    rows = docs.count()
    if not rows:
        return []
    spread = HOT_SAMPLE / (4 * shuffle_partitions(docs.sparkSession))
    sample = docs.sample(fraction=min(1.0, HOT_SAMPLE / rows), seed=11).select(F.xxhash64(_normal(text_col)).alias("h"))
    return [r["h"] for r in sample.groupBy("h").count().filter(F.col("count") >= max(HOT_HITS, spread)).select("h").collect()]


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``xd_keep_id``, ``xd_group_size``, ``xd_kept`` and ``xd_sha256``.

    Rows travel in a struct, so that their own names meet no name used inside. The one exchange is that by sampled splitters: the
    window's keys hold its keys.
    """
    hot = hot_texts(docs, text_col)
    norm = _normal(text_col)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.substring(norm.cast("binary"), 1, 16).alias("prefix"), F.xxhash64(norm).alias("hash"))
    keys = ["prefix", "hash"]
    if hot:
        spread = F.pmod(F.hash("id"), F.lit(max(16, shuffle_partitions(docs.sparkSession))))
        keyed, keys = keyed.withColumn("salt", F.when(F.col("hash").isin(hot), spread).otherwise(F.lit(-1))), [*keys, "salt"]
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    ranged = keyed.repartitionByRange(*keys).withColumn("norm", ascii_lower(text))
    near = Window.partitionBy(*keys, "norm").orderBy(F.col("id").desc_nulls_last())
    whole = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = ranged.select(
        "row",
        "id",
        F.max("id").over(whole).alias("keep"),
        F.count(F.lit(1)).over(whole).alias("size"),
        F.row_number().over(near).alias("rank"),
        F.sha2(F.col("norm"), 256).alias("sha256"),
    )
    if hot:
        totals = (
            docs.select(F.col(f"`{id_col}`").alias("all_id"), norm.alias("all_norm"))
            .filter(F.xxhash64("all_norm").isin(hot))
            .groupBy(F.sha2("all_norm", 256).alias("sha256"))
            .agg(F.max("all_id").alias("all_keep"), F.count(F.lit(1)).alias("all_size"))
        )
        runs = runs.join(F.broadcast(totals), "sha256", "left")  # one row per hot text
        runs = runs.withColumn("keep", F.when(F.col("all_size").isNull(), F.col("keep")).otherwise(F.col("all_keep")))
        runs = runs.withColumn("size", F.coalesce("all_size", "size"))
    kept = (F.col("rank") == 1) & F.col("id").eqNullSafe(F.col("keep"))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return runs.select(*own, F.col("keep").alias("xd_keep_id"), F.col("size").alias("xd_group_size"), kept.alias("xd_kept"), F.col("sha256").alias("xd_sha256"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    found = annotate(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), id_col, text_col)
    return found.select(
        F.col(f"`{id_col}`"),
        F.col("xd_keep_id").alias("keep_id"),
        F.col("xd_group_size").alias("group_size"),
        F.col("xd_kept").alias("kept"),
        F.col("xd_sha256").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns they came with."""
    return annotate(docs, id_col, text_col).filter("xd_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
