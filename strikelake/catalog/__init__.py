"""Registered queries: each name has a Spark plan and, where SQL can say it, an oracle statement."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strikelake.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("landing", "scalars", "relations", "timeseries", "chains", "validation", "scoring", "refresh", "training", "search")


def register(name: str, *ctes: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Record a query; `ctes` are prepended to `sql` as a WITH list."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = (f"WITH {', '.join(ctes)} {sql}" if ctes else sql).strip()
        return fn

    return add


def load_all() -> None:
    for module in _MODULES:
        importlib.import_module(f"strikelake.catalog.{module}")
