"""Connected components of a link table by alternating stars, and fixed-size filters of 64-bit keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikelake.session import materialize

FILTER_WORDS = 1 << 17


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the least node reachable.

    Large stars link each node's larger neighbours to its least one, small stars its smaller ones, until nothing changes.
    Every step is an aggregate joined back, which splits nodes with many links; each round is written to the shared folder.
    """
    edges = materialize(_down(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _down(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(_down(small), "stars")
        mark = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if known == (mark["n"], mark["h"]):
            break
        known = (mark["n"], mark["h"])
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()


def _down(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def key_filter(rows: DataFrame, key: str, words: int = FILTER_WORDS) -> np.ndarray:
    """A bitmap of 64 * ``words`` bits that holds every (uniformly hashed) key; its size doesn't grow with the rows."""
    picked = rows.selectExpr(f"cast(pmod(shiftright({key}, 6), {words}L) as int) as w", f"shiftleft(1L, cast({key} & 63L as int)) as b")
    bits = np.zeros(words, np.int64)
    for row in picked.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # at most ``words`` rows
        bits[row["w"]] = row["b"]
    return bits


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether signed 64-bit keys may be in the bitmap of ``key_filter``."""
    keys = keys.astype(np.int64)
    return (bits[np.mod(keys >> 6, len(bits))] >> (keys & 63)) & 1 > 0
