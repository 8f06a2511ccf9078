"""Readers and Arrow helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelake import session

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


#: Rows of an Arrow batch. Texts are long, so that the default of 10,000 would be tens of MB in the JVM and in each worker.
BATCH_ROWS = 1_000


def configure(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches of few rows."""
    session.configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` is exact, and much faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def byte_rows(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow string column, null as empty, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def binary_lists(arrays: list[np.ndarray], dtype: str) -> pa.Array:
    return pa.array([np.ascontiguousarray(a, dtype=dtype).tobytes() for a in arrays], type=pa.binary())
