"""Feature catalogue: name -> column, added only when asked for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from strikelake.functions.scalar import clip, finite, forward_price, logit, safe_divide, to_number
from strikelake.operators.relational import ensure_columns, first_column


@dataclass(frozen=True)
class Feature:
    build: Callable[[DataFrame], Column | None]
    needs: tuple[str, ...] = ()
    keep_existing: bool = False


def num(df: DataFrame, name: str) -> Column:
    return to_number(F.col(name)) if name in df.columns else F.lit(None).cast("double")


def _ln_ratio(a: Column, b: Column) -> Column:
    return F.ln(clip(a, 1e-12, None) / clip(b, 1e-12, None))


def _years(df: DataFrame) -> Column:
    return num(df, "T_years") if "T_years" in df.columns else num(df, "T_days") / 365.0


def _has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def _over_vol(name: str) -> Callable[[DataFrame], Column]:
    return lambda df: safe_divide(num(df, name), num(df, "rv20") * num(df, "sqrt_T_years"))


def _ratio(a: str, b: str) -> Callable[[DataFrame], Column]:
    return lambda df: safe_divide(num(df, a), num(df, b))


def _times(a: str, b: str) -> Callable[[DataFrame], Column]:
    return lambda df: num(df, a) * num(df, b)


def _fallback(df: DataFrame) -> Column:
    zero = F.lit(0.0)
    a, e = (F.coalesce(num(df, f"{s}_fallback_days"), zero) for s in ("asof", "expiry"))
    return ((a != 0) | (e != 0)).cast("double")


def _intrinsic_drop(df: DataFrame) -> Column:
    src = num(df, "drop_intrinsic_frac") if _has(df, "drop_intrinsic_frac") else _ratio("dropped_intrinsic", "n_chain_raw")(df)
    return (F.coalesce(src, F.lit(0.0)) > 0).cast("double")


def _band_clip(df: DataFrame) -> Column:
    src = num(df, "band_inside_frac") if _has(df, "band_inside_frac") else _ratio("n_band_inside", "n_band_raw")(df)
    return (F.coalesce(src, F.lit(1.0)) < 1.0).cast("double")


def _moneyness(df: DataFrame) -> Column | None:
    name = first_column(df, ("log_m_fwd", "log_m"), with_values=True)
    return num(df, name) if name else None


def _pm(df: DataFrame) -> Column:
    src = "pm_mid" if _has(df, "pm_mid") else "pPM_mid"
    return logit(num(df, src))


def _x_m(absolute: bool) -> Callable[[DataFrame], Column | None]:
    def build(df: DataFrame) -> Column | None:
        m = _moneyness(df)
        return None if m is None else num(df, "x_logit_prn") * (F.abs(m) if absolute else m)

    return build


CATALOG: dict[str, Feature] = {
    "x_logit_prn": Feature(lambda df: logit(num(df, "pRN")), keep_existing=True),
    "x_logit_pm": Feature(_pm),
    "log_m": Feature(
        lambda df: _ln_ratio(num(df, "K"), num(df, "S_asof_close")) if _has(df, "K", "S_asof_close") else None, keep_existing=True
    ),
    "abs_log_m": Feature(lambda df: F.abs(num(df, "log_m")) if _has(df, "log_m") else None, keep_existing=True),
    "forward_price": Feature(
        lambda df: forward_price(num(df, "S_asof_close"), num(df, "r"), num(df, "dividend_yield"), _years(df), guarded=False)
        if _has(df, "S_asof_close", "r", "dividend_yield")
        else None,
        keep_existing=True,
    ),
    "log_m_fwd": Feature(
        lambda df: _ln_ratio(num(df, "K"), num(df, "forward_price")) if _has(df, "K", "forward_price") else None,
        ("forward_price",), True,
    ),
    "abs_log_m_fwd": Feature(
        lambda df: F.abs(num(df, "log_m_fwd")) if _has(df, "log_m_fwd") else None, ("forward_price",), True
    ),
    "log_T_days": Feature(lambda df: F.log1p(clip(num(df, "T_days"), 0.0, None))),
    "sqrt_T_years": Feature(lambda df: F.sqrt(clip(_years(df), 0.0, None))),
    "rv20_sqrtT": Feature(_times("rv20", "sqrt_T_years"), ("sqrt_T_years",)),
    "log_m_over_volT": Feature(_over_vol("log_m"), ("sqrt_T_years",)),
    "abs_log_m_over_volT": Feature(_over_vol("abs_log_m"), ("sqrt_T_years",)),
    "log_m_fwd_over_volT": Feature(_over_vol("log_m_fwd"), ("forward_price", "sqrt_T_years")),
    "abs_log_m_fwd_over_volT": Feature(_over_vol("abs_log_m_fwd"), ("forward_price", "sqrt_T_years")),
    "log_rel_spread": Feature(lambda df: F.log1p(clip(num(df, "rel_spread_median"), 0.0, None))),
    "chain_used_frac": Feature(_ratio("n_chain_used", "n_chain_raw")),
    "band_inside_frac": Feature(_ratio("n_band_inside", "n_band_raw")),
    "drop_intrinsic_frac": Feature(_ratio("dropped_intrinsic", "n_chain_raw")),
    "fallback_any": Feature(_fallback),
    "had_fallback": Feature(_fallback),
    "had_intrinsic_drop": Feature(_intrinsic_drop),
    "had_band_clip": Feature(_band_clip),
    "prn_raw_gap": Feature(lambda df: num(df, "pRN") - num(df, "pRN_raw")),
    "x_prn_x_tdays": Feature(_times("x_logit_prn", "T_days")),
    "x_prn_x_rv20": Feature(_times("x_logit_prn", "rv20")),
    "x_prn_x_logm": Feature(_times("x_logit_prn", "log_m")),
    "x_m": Feature(_x_m(False), ("x_logit_prn",)),
    "x_abs_m": Feature(_x_m(True), ("x_logit_prn",)),
}


def with_features(df: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Adds the requested features (and what they rest on), in catalogue order."""
    wanted = set(requested)
    for name in requested:
        if name in CATALOG:
            wanted.update(CATALOG[name].needs)
    for name, feature in CATALOG.items():
        if name not in wanted or (feature.keep_existing and name in df.columns):
            continue
        column = feature.build(df)
        if column is not None:
            df = df.withColumn(name, finite(column.cast("double")))
    return df


# Defaults of snapshot columns a feed may lack.
SNAPSHOT_DEFAULTS = {
    "rv20": 0.30,
    "rv20_source": "fallback",
    "rv20_window": 0,
    "is_missing_rv20": True,
    "dividend_yield": 0.0,
    "rel_spread_median": None,
    "n_chain_raw": None,
    "n_chain_used": None,
    "n_band_raw": None,
    "n_band_inside": None,
    "dropped_intrinsic": None,
    "asof_fallback_days": None,
    "expiry_fallback_days": 0,
    "split_events_in_preload_range": None,
    "spot_scale_used": "raw",
}


def fallback_days(spot_source: Column) -> Column:
    return F.when(spot_source == "intraday_1m", 0).when(spot_source == "prev_close", 1)


def enrich_snapshot(df: DataFrame, rate: float = 0.03, zone: str = "America/New_York") -> DataFrame:
    """Baseline columns with defaults plus all derived features, on a 365-day year.

    A raw probability or fallback-day column that is wholly empty counts as missing.
    """
    filled = lambda name: first_column(df, (name,), with_values=True) is not None
    expiry = F.col("expiry_ts_utc" if "expiry_ts_utc" in df.columns else "event_endDate").cast("timestamp")
    out = ensure_columns(
        df, {k: F.lit(v) if v is not None else F.lit(None).cast("double") for k, v in SNAPSHOT_DEFAULTS.items()}
    )
    spot = num(out, "S")
    asof = F.to_date(F.from_utc_timestamp("snapshot_time_utc", zone)) if _has(df, "snapshot_time_utc") else F.lit(None).cast("date")
    lag = fallback_days(F.col("spot_source")).cast("double") if _has(df, "spot_source") else F.lit(None).cast("double")
    if filled("asof_fallback_days"):
        lag = F.col("asof_fallback_days").cast("double")
    out = out.withColumns(
        {
            "expiry_date": F.to_date(expiry),
            "expiry_close_date_used": F.to_date(F.from_utc_timestamp(expiry, zone)),
            "asof_date": asof,
            "S_asof_close": spot, "S_asof_close_adj": spot, "S_expiry_close": spot, "S_expiry_close_adj": spot,
            "r": F.lit(rate),
            "asof_fallback_days": lag,
            "spot_scale_used": F.coalesce("spot_scale_used", F.lit("raw")),
            "T_days": num(out, "T_days"),
            "T_years": num(out, "T_days") / 365.0,
            "pRN": num(out, "pRN"),
            "dividend_yield": F.coalesce(num(out, "dividend_yield"), F.lit(0.0)),
        }
    )
    if not filled("pRN_raw"):
        out = out.withColumn("pRN_raw", F.col("pRN"))
    fwd = forward_price(spot, F.lit(rate), F.col("dividend_yield"), F.col("T_years"))
    own = num(out, "forward_price")
    out = out.withColumn("forward_price", F.coalesce(own, fwd))
    out = out.drop("log_m", "abs_log_m", "x_logit_prn", "log_m_fwd", "abs_log_m_fwd")
    return with_features(
        out,
        [
            "x_logit_prn", "log_m", "abs_log_m", "log_m_fwd", "abs_log_m_fwd", "log_T_days", "sqrt_T_years", "rv20_sqrtT",
            "log_m_over_volT", "abs_log_m_over_volT", "log_m_fwd_over_volT", "abs_log_m_fwd_over_volT", "prn_raw_gap",
            "x_prn_x_tdays", "x_prn_x_rv20", "x_prn_x_logm",
        ],
    )
