"""Imputation, scaling and one-hot columns. What is fitted is a few numbers per column; what is applied
is plain column expressions, so scoring needs no Python and also runs on a stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.functions.scalar import to_number
from strikelake.operators.percentiles import column_medians


@dataclass(frozen=True)
class Preprocessor:
    numeric: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    categorical: tuple[str, ...] = ()
    fill: tuple[str, ...] = ()
    levels: tuple[tuple[str, ...], ...] = field(default=())

    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}={v}" for c, vs in zip(self.categorical, self.levels) for v in vs]]

    def columns(self) -> list[Column]:
        out = [
            (F.coalesce(to_number(F.col(c)), F.lit(med)) - mean) / scale
            for c, med, mean, scale in zip(self.numeric, self.medians, self.means, self.scales)
        ]
        # The first level is the reference; an unseen level is zero everywhere.
        for c, fill, values in zip(self.categorical, self.fill, self.levels):
            level = F.coalesce(F.col(c).cast("string"), F.lit(fill))
            out += [(level == v).cast("double") for v in values]
        return out


def _medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    clean = df.select(*[to_number(F.col(c)).alias(c) for c in columns])
    return {r["column"]: r["median"] for r in column_medians(clean, columns).collect()}


def fit_preprocessor(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), scale: bool = True) -> Preprocessor:
    """Exact medians; mean and population deviation after imputation; most frequent level, levels sorted."""
    numeric = list(numeric)
    med = _medians(df, numeric) if numeric else {}
    medians = [float(med.get(c) or 0.0) for c in numeric]
    means, scales = [0.0] * len(numeric), [1.0] * len(numeric)
    if scale and numeric:
        filled = [F.coalesce(to_number(F.col(c)), F.lit(m)) for c, m in zip(numeric, medians)]
        row = df.agg(
            *[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)]
        ).first()
        means = [float(row[f"m{i}"]) for i in range(len(numeric))]
        scales = [float(row[f"s{i}"]) or 1.0 for i in range(len(numeric))]
    fills, levels = [], []
    for c in categorical:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count("*").alias("n"))
        rows = counts.orderBy("v").collect()  # one row per level of a modelling category
        top = max(rows, key=lambda r: r["n"])["n"]
        fills.append(next(r["v"] for r in rows if r["n"] == top))
        levels.append(tuple(r["v"] for r in rows[1:]))
    return Preprocessor(
        tuple(numeric), tuple(medians), tuple(means), tuple(scales), tuple(categorical), tuple(fills), tuple(levels)
    )


def ticker_interactions(df: DataFrame, ticker: str, x: str, support: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One column per supported ticker: x where the ticker matches, zero elsewhere."""
    import re

    names = {}
    for t in support:
        safe = re.sub(r"[^A-Za-z0-9]+", "_", t).strip("_") or "UNK"
        names[f"x_ticker_{safe}"] = F.when(F.col(ticker).cast("string") == t, F.coalesce(to_number(F.col(x)), F.lit(0.0))).otherwise(F.lit(0.0))
    return (df.withColumns(names) if names else df), list(names)


def supported_tickers(df: DataFrame, ticker: str, min_support: int, preserve: Sequence[str] = ()) -> list[str]:
    name = F.upper(F.trim(F.col(ticker).cast("string")))
    rows = df.groupBy(name.alias("t")).agg(F.count("*").alias("n")).where(F.col("n") >= max(1, min_support)).collect()
    return sorted({r["t"] for r in rows} | {p.strip().upper() for p in preserve})
