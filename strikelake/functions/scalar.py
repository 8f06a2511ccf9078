"""Scalar column functions: coercion, guarded arithmetic, pricing and rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

EPS = 1e-6


def finite(c: Column) -> Column:
    """NaN and +-inf become NULL, so later comparisons behave like pandas' (Spark sorts NaN highest)."""
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def to_number(c: Column) -> Column:
    return finite(c.try_cast("double"))


def to_timestamp(c: Column, fmt: str | None = None) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else c.try_cast("timestamp")


def safe_divide(num: Column, den: Column) -> Column:
    return finite(F.try_divide(num, den))


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    """Clamp that keeps NULL as NULL (least/greatest would skip it)."""
    if lo is None:
        return F.when(c > hi, F.lit(float(hi))).otherwise(c)
    out = F.when(c < lo, F.lit(float(lo)))
    if hi is not None:
        out = out.when(c > hi, F.lit(float(hi)))
    return out.otherwise(c)


def logit(p: Column, eps: float = EPS) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.ln(q / (F.lit(1.0) - q))


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def round_half_up(c: Column, places: int) -> Column:
    """Same floating-point steps in any SQL engine: floor(x * 10^k + 0.5) / 10^k."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / F.lit(scale)


def round_half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def fix_negative_zero(c: Column, eps: float = 5e-13) -> Column:
    return F.when(F.abs(c) < eps, F.lit(0.0)).otherwise(c)


def forward_price(spot: Column, r: Column, q: Column, t_years: Column, guarded: bool = True) -> Column:
    fwd = spot * F.exp((r - q) * t_years)
    if not guarded:
        return finite(fwd)
    ok = (spot > 0) & (t_years > 0) & r.between(0.0, 1.0) & q.between(0.0, 1.0)
    return F.when(ok, finite(fwd))


def d2(spot: Column, strike: Column, t: Column, r: Column, sigma: Column) -> Column:
    ok = (spot > 0) & (strike > 0) & (t > 0) & (sigma > 0)
    # Guard the inputs too: ANSI evaluation must never reach ln/sqrt of a bad value.
    s, k = F.when(ok, spot), F.when(ok, strike)
    tt, sg = F.when(ok, t), F.when(ok, sigma)
    return (F.ln(s / k) + (r - sg * sg * 0.5) * tt) / (sg * F.sqrt(tt))


# Zelen & Severo (Abramowitz & Stegun 26.2.17), |error| < 7.5e-8.
_CDF_GAMMA = 0.2316419
_CDF_COEF = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF as a codegen-friendly polynomial, no Python in the row path."""
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(x) * _CDF_GAMMA)
    poly = F.lit(0.0)
    for coef in reversed(_CDF_COEF):
        poly = (poly + coef) * t
    upper = F.exp(-(x * x) * 0.5) * (1.0 / math.sqrt(2.0 * math.pi)) * poly
    return F.when(x >= 0, F.lit(1.0) - upper).otherwise(upper)


def with_lognormal_tail(
    df: DataFrame, name: str, spot: Column, strike: Column, t: Column, r: Column, sigma: Column
) -> DataFrame:
    """Adds N(d2). Staged in columns so that the generated code stays small."""
    staged = df.withColumn("_d2", d2(spot, strike, t, r, sigma))
    staged = staged.withColumn("_w", F.lit(1.0) / (F.lit(1.0) + F.abs(F.col("_d2")) * _CDF_GAMMA))
    poly = F.lit(0.0)
    for coef in reversed(_CDF_COEF):
        poly = (poly + coef) * F.col("_w")
    density = F.exp(-(F.col("_d2") * F.col("_d2")) * 0.5) * (1.0 / math.sqrt(2.0 * math.pi))
    staged = staged.withColumn("_w", density * poly)
    return staged.withColumn(name, F.when(F.col("_d2") >= 0, F.lit(1.0) - F.col("_w")).otherwise(F.col("_w"))).drop("_d2", "_w")


def dividend_yield(trailing_sum: Column, spot: Column, lookback_days: int, default: float = 0.0) -> Column:
    annual = trailing_sum * (365.25 / lookback_days)
    return F.when((spot > 0) & annual.isNotNull(), annual / spot).otherwise(F.lit(float(default)))


def execution_price(price: Column, side: Column, slippage_bps: float, fee_bps: float) -> Column:
    cost = (slippage_bps + fee_bps) / 10_000.0
    moved = F.when(side == "buy", price * (1 + cost)).when(side == "sell", price * (1 - cost))
    return clip(moved, 0.0, 1.0)


def execution_time(decision: Column, latency_ms: int) -> Column:
    return F.timestamp_micros(F.unix_micros(decision) + F.lit(int(latency_ms) * 1000))


def symmetric_quote(mid: Column, spread_bps: float) -> tuple[Column, Column]:
    s = spread_bps / 10_000.0
    return clip(mid * (1 - s), 0.0, 1.0), clip(mid * (1 + s), 0.0, 1.0)


def string_list(c: Column) -> Column:
    """A JSON text list as array<string>; anything that is not a bracketed list is NULL."""
    text = F.trim(c)
    return F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>"))


def loose_bool(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return (
        F.when(text.isin("true", "t", "yes", "y", "1"), F.lit(True))
        .when(text.isin("false", "f", "no", "n", "0"), F.lit(False))
    )
