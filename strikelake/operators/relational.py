"""Column resolution, dedupes, guarded joins, overrides, labels, overlaps and backfill."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.operators.skew import pick_row
from strikelake.session import materialize


# --- columns ------------------------------------------------------------------------------------


def first_column(df: DataFrame, candidates: Sequence[str], with_values: bool = False) -> str | None:
    """First candidate present; with `with_values`, first one holding any value at all.

    The choice is for the whole column, never row by row. It reads one aggregate row.
    """
    return first_columns(df, (candidates,), with_values)[0]


def first_columns(df: DataFrame, lists: Sequence[Sequence[str]], with_values: bool = False) -> list[str | None]:
    """`first_column` of several lists of candidates, all from one aggregate row."""
    present = [[c for c in candidates if c in df.columns] for candidates in lists]
    names = sorted({c for p in present for c in p})
    if not with_values or not names:
        return [p[0] if p else None for p in present]
    seen = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in names]).first()
    return [next((c for c in p if seen[c]), None) for p in present]


def label_column(df: DataFrame, candidates: Sequence[str] = ("label", "outcome_ST_gt_K", "outcome")) -> str | None:
    """First candidate that holds any 0 or 1."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    seen = df.agg(*[F.max(F.col(c).try_cast("double").isin(0.0, 1.0)).alias(c) for c in present]).first()
    return next((c for c in present if seen[c]), None)


def ensure_columns(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    missing = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def column_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, non_null, variance) for each numeric column, one pass over the data."""
    stats = df.agg(
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.var_pop(F.col(c).cast("double")).alias(f"v_{i}") for i, c in enumerate(columns)],
    )
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").alias("non_null"), F.col(f"v_{i}").alias("variance"))
        for i, c in enumerate(columns)
    ]
    return stats.select(F.inline(F.array(*rows)))


def droppable_features(df: DataFrame, columns: Sequence[str], var_eps: float = 1e-12) -> tuple[list[str], list[str]]:
    """(all-NULL columns, near-constant columns)."""
    stats = column_fill(df, columns).collect()  # one row per column
    empty = [r["column"] for r in stats if r["non_null"] == 0]
    flat = [r["column"] for r in stats if r["non_null"] and (r["variance"] is None or r["variance"] < var_eps)]
    return empty, flat


def fold_rare(
    df: DataFrame, column: str, min_support: int, fit: Column, preserve: Sequence[str] = (), other: str = "OTHER"
) -> DataFrame:
    """Categories with fewer than `min_support` fit rows become OTHER, except the preserved ones."""
    name = F.upper(F.trim(F.col(column).cast("string")))
    if min_support <= 1:
        return df.withColumn(f"{column}_scoped", name)
    keep = df.where(fit).groupBy(name.alias("_cat")).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_support)
    joined = df.withColumn("_name", name).join(keep.select("_cat"), F.col("_name") == F.col("_cat"), "left")
    kept = F.col("_cat").isNotNull() | F.col("_name").isin([p.strip().upper() for p in preserve])
    return joined.withColumn(f"{column}_scoped", F.when(kept, F.col("_name")).otherwise(other)).drop("_name", "_cat")


# --- keys ---------------------------------------------------------------------------------------


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    if duplicate_keys(df, keys).limit(1).count():
        raise ValueError(f"{what}: key {list(keys)} is not unique")
    return df


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return pick_row(df, list(keys), [F.col(o) for o in order], last=True)


def best_source(df: DataFrame, key: str = "row_id", tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per id: fewest fallback days, best quote source, most strikes used, tightest spread."""
    far, none = F.lit(1e9), F.lit(-1.0)
    quote = F.lower("quote_source")
    order = [
        F.coalesce(F.col("asof_fallback_days").cast("double"), far),
        F.coalesce(F.col("expiry_fallback_days").cast("double"), far),
        F.when(quote == "bidask_mid", 0).when(quote == "close_fallback", 1).otherwise(9),
        -F.coalesce(F.col("n_chain_used").cast("double"), none),
        F.coalesce(F.col("rel_spread_median").cast("double"), far),
        *[F.col(t) for t in tiebreak],
    ]
    return pick_row(df, [key], order)


# --- joins --------------------------------------------------------------------------------------


def many_to_one(left: DataFrame, right: DataFrame, on: Sequence[str], check: bool = True) -> DataFrame:
    """Left join that refuses a right side with repeated keys."""
    if check:
        require_unique(right, on, "right side of a many-to-one join")
    return left.join(right, list(on), "left")


def rounded_key_join(market: DataFrame, benchmark: DataFrame, places: int = 4) -> DataFrame:
    """Attach benchmark values on (ticker, date, strike rounded)."""
    left = market.withColumn("_k", F.round("K", places))
    right = benchmark.withColumn("_k", F.round("K", places)).drop("K")
    return many_to_one(left, right, ["ticker", "event_date", "_k"]).drop("_k")


def restrict_to(df: DataFrame, **allowed: DataFrame) -> DataFrame:
    """Keep rows whose column value occurs in each allowed one-column set (semi joins)."""
    for column, values in allowed.items():
        df = df.join(values.select(F.col(values.columns[0]).alias(column)), column, "left_semi")
    return df


def common_values(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).dropna().intersect(b.select(column).dropna())


def drop_shared_groups(train: DataFrame, held_out: DataFrame, group: str) -> DataFrame:
    return train.join(held_out.select(group).dropna().distinct(), group, "left_anti")


def overlap_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(key, shared): distinct non-null values present on both sides, one row per key column."""
    def tall(df: DataFrame, flag: str) -> DataFrame:
        pairs = [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]
        return df.select(F.inline(F.array(*pairs))).dropna().select("key", "value", F.lit(flag).alias("side"))

    both = tall(left, "l").unionByName(tall(right, "r")).groupBy("key", "value")
    shared = both.agg(F.min("side").alias("_a"), F.max("side").alias("_b"))
    return shared.groupBy("key").agg(F.count_if(F.col("_a") != F.col("_b")).alias("shared"))


def apply_overrides(dim: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual fixes matched by market_id, else condition_id, else slug; non-empty fields win."""
    fields = [c for c in overrides.columns if c in dim.columns]
    keys = ("market_id", "condition_id", "slug")
    blank_free = overrides.select(
        *[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)).alias(c) for c in overrides.columns if c != "line"], "line"
    )
    out = dim
    for key in keys:
        # The last override line for a key is the one in force.
        latest = pick_row(blank_free.where(F.col(key).isNotNull()), [key], [F.col("line")], last=True)
        packed = latest.select(F.col(key).cast("string").alias(f"_m_{key}"), F.struct(*fields).alias(f"_o_{key}"))
        out = out.join(packed, F.col(key).cast("string") == F.col(f"_m_{key}"), "left")
    chosen = F.coalesce(*[F.col(f"_o_{k}") for k in keys])
    out = out.withColumn("_o", chosen)
    hit = F.col("_o").isNotNull()
    final = []
    for c in dim.columns:
        base = F.col(c)
        if c in fields:
            base = F.coalesce(F.col("_o")[c].cast(dim.schema[c].dataType), F.col(c))
        if c == "source":
            base = F.when(hit, F.lit("manual")).otherwise(F.col(c))
        if c == "mapping_confidence":
            given = F.col("_o")[c].cast("double") if c in fields else F.lit(None).cast("double")
            given = F.when(given != 0, given)
            base = F.when(hit, F.coalesce(given, F.lit(1.0))).otherwise(F.col(c))
        final.append(base.alias(c))
    return out.select(*final)


def payout_labels(dim: DataFrame, conditions: DataFrame, positions: DataFrame) -> DataFrame:
    """market_id -> 1 when YES paid more, 0 when less, NULL on a tie; unresolvable markets are left out.

    conditions(id, payout_numerators array, payout_denominator), positions(id, condition, outcome_index).
    """
    pos = positions.select(F.col("condition").alias("condition_id"), F.col("id").alias("_tok"), F.col("outcome_index").cast("int").alias("_idx"))
    pos = pick_row(pos.dropna(subset=["condition_id", "_tok"]), ["condition_id", "_tok"], [F.col("_idx")], last=True)
    def outcome(df: DataFrame, token: str, name: str) -> DataFrame:
        side = pos.select("condition_id", F.col("_tok").alias(token), F.col("_idx").alias(name))
        return df.join(side, ["condition_id", token], "left")

    m = outcome(outcome(dim, "outcome_yes_token_id", "_iy"), "outcome_no_token_id", "_in")
    den = F.col("payout_denominator").try_cast("double")
    paid = conditions.select(F.col("id").alias("condition_id"), "payout_numerators", den.alias("_den")).where(F.col("_den") != 0)
    known = F.col("_iy").isNotNull() & F.col("_in").isNotNull()
    joined = m.join(paid, "condition_id").select(
        "market_id",
        F.when(known, F.col("_iy")).otherwise(0).alias("_iy"),
        F.when(known, F.col("_in")).otherwise(1).alias("_in"),
        "payout_numerators",
        "_den",
    )
    share = lambda idx: F.try_divide(F.try_element_at("payout_numerators", F.col(idx) + 1).try_cast("double"), F.col("_den"))
    out = joined.where((F.col("_iy") < F.size("payout_numerators")) & (F.col("_in") < F.size("payout_numerators")))
    out = out.withColumn("_py", share("_iy")).withColumn("_pn", share("_in"))
    return out.select(
        "market_id", F.when(F.col("_py") > F.col("_pn"), 1).when(F.col("_py") < F.col("_pn"), 0).alias("label")
    )


# --- unions -------------------------------------------------------------------------------------


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def backfill(existing: DataFrame, extra: DataFrame, key: str = "row_id", write: bool = False) -> DataFrame:
    """Rows of `extra` with ids not stored yet are added; the caller recomputes weights on the whole.

    `write` looks for the added rows once and writes them, for callers that read the result more than once.
    """
    added = extra.join(existing.select(key), key, "left_anti")
    return union_all(existing, materialize(added, "backfill") if write else added)


def output_order(df: DataFrame, dates: Sequence[str] = ("asof_date", "snapshot_date", "week_friday"), strike: Sequence[str] = ("K", "threshold")) -> DataFrame:
    """Deterministic order of a written dataset: first date column, ticker, strike. Only for final output."""
    keys = [first_column(df, dates), "ticker" if "ticker" in df.columns else None, first_column(df, strike)]
    return df.orderBy(*[k for k in keys if k])
