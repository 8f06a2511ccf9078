"""Row predicates of the calibration set, the market feed and the snapshot quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.functions.scalar import loose_bool, string_list

EPS = 1e-6


def tail_bounds(below: float | None = None, above: float | None = None, eps: float = 1e-3) -> tuple[float, float]:
    """Both ends default to eps; with one end given the other defaults to 1e-6."""
    if below is None and above is None:
        below, above = eps, 1.0 - eps
    lo = EPS if below is None else below
    hi = 1.0 - EPS if above is None else above
    if not 0.0 <= lo < hi <= 1.0:
        raise ValueError("probability bounds must satisfy 0 <= below < above <= 1")
    return lo, hi


def inside_tails(p: Column, below: float | None = None, above: float | None = None, eps: float = 1e-3) -> Column:
    lo, hi = tail_bounds(below, above, eps)
    return (p > lo) & (p < hi)


def near_money(df: DataFrame, bound: float) -> DataFrame:
    name = next((c for c in ("log_m_fwd", "log_m") if c in df.columns), None)
    return df.where(F.abs(F.col(name)) <= bound) if name else df


def horizon_is(days: int, column: str = "T_days") -> Column:
    if days not in (1, 2, 3, 4):
        raise ValueError("the horizon must be one of 1, 2, 3, 4 days")
    return F.col(column).try_cast("double") == float(days)


# Accepted spellings of the as-of weekdays.
DAY_NAMES = {
    "mon": 0, "monday": 0, "tue": 1, "tues": 1, "tuesday": 1, "wed": 2, "wednesday": 2,
    "thu": 3, "thur": 3, "thurs": 3, "thursday": 3,
}


def parse_weekdays(text: str, single: bool = True) -> list[int]:
    """Training allows one weekday of Monday to Thursday, previews a set."""
    days = set()
    for token in filter(None, (t.strip().lower() for t in text.split(","))):
        day = int(token) if token.isdigit() else DAY_NAMES.get(token)
        if day is None or not 0 <= day <= 3:
            raise ValueError(f"as-of weekday {token!r} is not Monday to Thursday")
        days.add(day)
    if single and len(days) > 1:
        raise ValueError("only one as-of weekday may be selected")
    return sorted(days)


def asof_weekday_in(day: Column, days: Sequence[int]) -> Column:
    return F.weekday(day).isin(list(days))


def ticker_in(column: str, tickers: Sequence[str], exclude: bool = False) -> Column:
    hit = F.upper(F.trim(F.col(column).cast("string"))).isin([t.strip().upper() for t in tickers])
    return ~hit if exclude else hit


def binary_label(column: str) -> Column:
    return F.col(column).try_cast("double").isin(0.0, 1.0)


def tradeable_reason(df_columns: Sequence[str]) -> Column:
    """'ok' or the first rule a market breaks."""
    tokens = string_list(F.col("clobTokenIds").cast("string"))
    first, second = F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(2))
    missing = F.coalesce((first == "") | (second == ""), F.lit(True))
    out = F.when(missing, "missing_clob_tokens")
    # Flag, the value that bars trading, the reason given.
    rules = (
        ("enableOrderBook", False, "orderbook_disabled"),
        ("closed", True, "closed"),
        ("archived", True, "archived"),
        ("active", False, "inactive"),
        ("isResolved", True, "resolved"),
        ("acceptingOrders", False, "not_accepting_orders"),
    )
    for flag, bars, reason in rules:
        if flag in df_columns:
            out = out.when(F.coalesce(loose_bool(F.col(flag)) == F.lit(bars), F.lit(False)), reason)
    return out.otherwise("ok")


def two_sided_market(df: DataFrame) -> DataFrame:
    """Bid = lower, ask = higher of the two quotes per token; a single quote serves as both."""
    bid = lambda s: F.least(f"{s}_buy", f"{s}_sell")
    ask = lambda s: F.greatest(f"{s}_buy", f"{s}_sell")
    out = df.withColumns({"_yb": bid("yes"), "_ya": ask("yes"), "_nb": bid("no"), "_na": ask("no")})
    ok = F.col("_ya").isNotNull() | F.col("_na").isNotNull()
    return out.withColumns(
        {
            "pPM_buy": F.col("_ya"), "qPM_buy": F.col("_na"),
            "pPM_mid": (F.col("_yb") + F.col("_ya")) * 0.5, "qPM_mid": (F.col("_nb") + F.col("_na")) * 0.5,
            "yes_spread": F.col("_ya") - F.col("_yb"), "no_spread": F.col("_na") - F.col("_nb"),
            "pm_ok": ok, "pm_reason": F.when(ok, "ok").otherwise("no_clob_price"),
        }
    ).drop("_yb", "_ya", "_nb", "_na")
