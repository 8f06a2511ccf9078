"""Plans of exact dedup and of the archive reader, and rows whose column names are those used inside."""

import re

import pytest

from strikelake.llm import exact_dedup, warc
from strikelake.session import scratch_path

NAMES = ["xd_hash", "xd_prefix", "xd_norm", "row", "id", "hash", "norm", "salt", "sha256", "keep", "rank"]


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hot", [False, True])
def test_one_range_exchange_and_clashing_names(spark, hot):
    rows = [(i, "same" if hot and i % 3 else f"text {i % 700}", *[f"{n}{i}" for n in NAMES]) for i in range(2100)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{n} string' for n in NAMES)}")
    found = exact_dedup.annotate(docs)
    exchanges = re.findall(r"Exchange (rangepartitioning|hashpartitioning)", found._jdf.queryExecution().executedPlan().toString())
    assert exchanges.count("rangepartitioning") == 1 and exchanges.count("hashpartitioning") <= (1 if hot else 0)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES)
    assert kept.count() == (len({r[1] for r in rows}))


def test_archives_are_read_by_many_tasks(spark):
    rows = [(i, f"http://h/{i}", "".join(chr(97 + (i * k * k) % 26) for k in range(3000))) for i in range(60)]
    path = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = warc.read(spark, path, size=4096)
    assert found.rdd.getNumPartitions() > 4
    assert {(r.page_id, r.payload_bytes) for r in found.collect()} == {(i, 3000) for i, *_ in rows}
