"""Mixing to target weights by soft membership, in column expressions only.

A labelled table fits a Gaussian naive Bayes over the shares of some characters (one aggregate per domain); every document
gets posteriors of all domains from its whole text. Rates r >= least rate then minimise sum_k (e_k - t_k)^2 by projected
gradient, from rates of 1, where e_k is the tokens of domain k expected from the rates and posteriors and t_k its target. A step
needs only totals of size K and K^2, one aggregate over all documents; a document's rate is a nested expression of
the steps so far, so nothing else is stored between steps.

Defined cases: null text is empty and has no tokens; documents without labels take part with their posteriors; labelled rows
with a null id or domain are left out, of repeated labels the least domain counts; without labelled rows every rate is 1 and the
posteriors are empty; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikelake.session import materialize

#: Characters whose shares of a text are the features of the classifier.
PROBES = ("e", "a", "n", "i", "s", "r", "t", "o", "l", "d", "u", "c", "h", "g", "q", "é", "è", "ñ", "ó", "í", "ä", "ü", "ö", "ß", "ç", "th", "ch", "en")
#: Labelled rows the classifier is fitted on at most, by hash order; few enough to be broadcast.
MAX_FIT_ROWS = 20_000
STEPS = 20
TOLERANCE = 0.005

Targets = Callable[[dict[str, float]], dict[str, float]]


def labelled_domains(docs: DataFrame, labels: DataFrame, domain: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """(id, domain) of at most MAX_FIT_ROWS rows of the labelled table, the domain taken from the documents' own column."""
    chosen = labels.select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(MAX_FIT_ROWS)
    return docs.select(F.col(id_col).alias("id"), F.col(domain).cast("string").alias("domain")).join(F.broadcast(chosen), "id").filter("domain is not null").groupBy("id").agg(F.min("domain").alias("domain"))


def even_targets(totals: dict[str, float]) -> dict[str, float]:
    """The same number of tokens for every domain, of the same sum."""
    return {k: sum(totals.values()) / len(totals) for k in totals}


def tempered_targets(alpha: float) -> Targets:
    """Shares raised to ``alpha``, with a sum large enough that no domain shrinks."""

    def targets(totals: dict[str, float]) -> dict[str, float]:
        weights = {k: v**alpha for k, v in totals.items() if v > 0}
        budget = max((totals[k] / w for k, w in weights.items()), default=0.0)
        return {k: weights.get(k, 0.0) * budget for k in totals}

    return targets


def _features(text: Column) -> list[Column]:
    size = F.greatest(F.octet_length(text), F.lit(1)).cast("double")
    return [(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(p), F.lit("")))) / size for p in PROBES]


def fit(docs: DataFrame, domains: DataFrame, id_col: str, text_col: str) -> dict[str, tuple[float, list[float], list[float]]]:
    """Per domain: log prior, means and variances of the features."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    few = domains.orderBy(F.xxhash64("id"), "id").limit(MAX_FIT_ROWS)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).join(F.broadcast(few), "id").filter("text <> ''")
    rows = rows.select("domain", *[x.alias(f"x{i}") for i, x in enumerate(_features(F.col("text")))])
    every = range(len(PROBES))
    found = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in every], *[F.var_pop(f"x{i}").alias(f"v{i}") for i in every]).orderBy("domain").collect()
    total = sum(r["n"] for r in found)
    pooled = [sum(r["n"] * r[f"v{i}"] for r in found) / total + 1e-8 if found else 1.0 for i in every]
    return {r["domain"]: (float(np.log(r["n"] / total)), [r[f"m{i}"] for i in every], [0.8 * r[f"v{i}"] + 0.2 * pooled[i] for i in every]) for r in found}


def with_posteriors(docs: DataFrame, model: dict, text_col: str, temperature: float = 4.0) -> DataFrame:
    """Adds ``mix_tokens`` and ``mix_p``, the posteriors in the model's order. The temperature softens them."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = [f"mix_x{i}" for i in range(len(PROBES))]
    rows = docs.withColumns({"mix_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), **dict(zip(names, _features(text)))})
    scores = {}
    for k, (prior, means, variances) in enumerate(model.values()):
        value = F.lit(prior)
        for x, m, v in zip(names, means, variances):
            value = value - (((F.col(x) - m) * (F.col(x) - m)) / v + float(np.log(v))) / (2 * temperature)
        scores[f"mix_s{k}"] = value
    rows = rows.withColumns(scores)
    top = F.greatest(*scores) if len(scores) > 1 else F.col("mix_s0")
    rows = rows.withColumns({f"mix_e{k}": F.exp(F.col(f"mix_s{k}") - top) for k in range(len(scores))})
    total = sum((F.col(f"mix_e{k}") for k in range(len(scores))), F.lit(0.0))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], "mix_tokens", F.array(*[F.col(f"mix_e{k}") / total for k in range(len(scores))]).alias("mix_p"))


def rate_of(steps: list[list[float]], least: float) -> Column:
    """The rate after the steps: each moves it along the posteriors and projects it onto rates of ``least`` or more."""
    if not steps:
        return F.greatest(F.lit(least), F.lit(1.0))
    # One fold over the steps names the posteriors once, so the plan stays small.
    dot = lambda c: F.aggregate(F.zip_with("mix_p", c, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps]), F.lit(1.0), lambda r, c: F.greatest(F.lit(float(least)), r - dot(c)))


def solve(posteriors: DataFrame, names: list[str], targets: Targets, least: float = 0.0) -> list[list[float]]:
    """Steps of the projected gradient for rows of mix_tokens and mix_p.

    A step is the gradient, e - t for each domain, scaled by the inverse Gram matrix of the rows free to move: those above the
    least rate or drawn upwards. A step that doesn't lower the distance to the targets is halved.
    """
    k = len(names)
    p = [F.get("mix_p", F.lit(i)) for i in range(k)]
    tokens = F.col("mix_tokens")

    def totals(steps: list[list[float]], gradient: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray]:
        rows = posteriors.withColumn("mix_r", rate_of(steps, least))
        free = F.lit(True) if gradient is None else (F.col("mix_r") > least) | (sum((x * float(g) for x, g in zip(p, gradient)), F.lit(0.0)) < 0)
        rows = rows.withColumn("mix_free", F.when(free, tokens).otherwise(F.lit(0)))
        row = rows.agg(F.sum(tokens).alias("n"), *[F.sum(tokens * F.col("mix_r") * x).alias(f"e{i}") for i, x in enumerate(p)], *[F.sum(F.col("mix_free") * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
        n = float(row["n"] or 0)
        return n, np.array([row[f"e{i}"] or 0 for i in range(k)], float) / max(n, 1), np.array([[row[f"m{max(i, j)}_{min(i, j)}"] or 0 for j in range(k)] for i in range(k)], float) / max(n, 1)

    n, expected, gram = totals([], None)
    if not n:
        return []
    wanted = targets({name: float(e * n) for name, e in zip(names, expected)})
    goal = np.array([wanted[name] for name in names]) / n
    steps: list[list[float]] = []
    error = expected - goal
    for _ in range(STEPS):
        if np.abs(error).max() <= TOLERANCE * goal.max():
            break
        move = np.linalg.solve(gram + 1e-6 * np.trace(gram) * np.eye(k) + 1e-12 * np.eye(k), error)
        for _ in range(4):
            _, expected, after = totals([*steps, move.tolist()], error)
            if np.linalg.norm(expected - goal) < np.linalg.norm(error):
                break
            move = move / 2
        else:
            break  # the least rate holds; the targets can't be met any better along this way
        steps.append(move.tolist())
        error, gram = expected - goal, after
    return steps


def mix(docs: DataFrame, domains: DataFrame, targets: Targets, least: float = 0.0, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Adds ``mix_tokens``, ``mix_posteriors`` (map), ``mix_rate`` and ``mix_copies`` (the rate, rounded by a hash of the id).

    ``carry`` names the columns to return, the id among them; all by default.
    """
    kept = [F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]
    model = fit(docs, domains, id_col, text_col)
    if not model:
        plain = docs.withColumn("mix_tokens", F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
        return plain.select(*kept, "mix_tokens").withColumns({"mix_posteriors": F.create_map().cast("map<string,double>"), "mix_rate": F.lit(1.0), "mix_copies": F.lit(1).cast("long")})
    # Texts are classified once; the solver reads two columns of what is written, the result the rest.
    rated = materialize(with_posteriors(docs, model, text_col).select(*kept, "mix_tokens", "mix_p"), "posteriors")
    steps = solve(rated.select("mix_tokens", "mix_p"), list(model), targets, least)
    rated = rated.withColumn("mix_rate", rate_of(steps, least))
    draw = F.pmod(F.xxhash64(F.lit("mixing"), F.col(f"`{id_col}`")), F.lit(1 << 20)) / float(1 << 20)
    return rated.select(
        *kept,
        "mix_tokens",
        F.map_from_arrays(F.array(*[F.lit(name) for name in model]), F.col("mix_p")).alias("mix_posteriors"),
        "mix_rate",
        F.floor(F.col("mix_rate") + draw).cast("long").alias("mix_copies"),
    )


def resample(docs: DataFrame, domains: DataFrame, targets: Targets, least: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document as often as its rate says, with the columns it came with."""
    rated = mix(docs, domains, targets, least, id_col, text_col)
    # An outer generator: a filter on the number of copies would be pushed down and repeat the whole classifier.
    copies = rated.withColumn("mix_copy", F.explode_outer(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int")))).filter("mix_copy is not null")
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
