"""Option chains to labelled training rows: closes, curve, benchmark probability, band, label, weights.

The raw quotes are joined once with the (small) table of wanted chains and reduced to one row per
(chain, scale, strike); everything after that is bounded by strikes per chain. Stages read several
times (closes, usable jobs, chains, chosen curves) are written once to the shared folder, which keeps
each job's plan small and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from strikelake.functions import calendar, keys
from strikelake.functions.scalar import dividend_yield, fix_negative_zero
from strikelake.operators import chain as C, lookups, relational
from strikelake.operators.weights import weighting_v3
from strikelake.session import materialize

YEAR = 365.25  # fixed value: the build counts years of 365.25 days


@dataclass(frozen=True)
class BuildRules:
    rate: float = 0.03
    asof_forward_days: int = 3
    expiry_backward_days: int = 3
    rv_lookback: int = 20
    dividend_lookback: int = 365
    dividend_default: float = 0.0
    saturday_fallback: bool = True
    forward_moneyness: bool = True
    min_prn: float = 0.10
    max_prn: float = 0.90
    min_in_prn_band: int = 7
    curve: C.CurveRules = field(default_factory=C.CurveRules)


CHAIN = ["ticker", "asof_date", "week_friday"]
SCALED = [*CHAIN, "spot_scale"]


def with_closes(jobs: DataFrame, closes: DataFrame, rules: BuildRules) -> tuple[DataFrame, DataFrame]:
    """(usable jobs, drop log): as-of close looking ahead, expiry close looking back, positive horizon.

    jobs(ticker, week_monday, week_friday, asof_target); closes(ticker, date, close_raw, close_adj).
    """
    px = closes.select("ticker", "date", F.col("close_adj").alias("close"), "close_raw")
    a = lookups.nearest_close(jobs, px, "forward", rules.asof_forward_days, "asof_target", "s0", ("close_raw",))
    b = lookups.nearest_close(a, px, "backward", rules.expiry_backward_days, "week_friday", "st", ("close_raw",))
    b = b.withColumn("T_days", F.date_diff("week_friday", "s0_date"))
    reason = F.when(F.col("s0_px").isNull(), "missing_S0").when(F.col("st_px").isNull(), "missing_ST").when(F.col("T_days") <= 0, "bad_T_days")
    marked = b.withColumn("drop_reason", reason)
    ok = marked.where(F.col("drop_reason").isNull()).select(
        "ticker", "week_monday", "week_friday", "asof_target", F.col("s0_date").alias("asof_date"), "T_days",
        F.col("s0_px").alias("S0_adj"), F.col("s0_close_raw").alias("S0_raw"), F.col("st_px").alias("ST_adj"), F.col("st_close_raw").alias("ST_raw"),
        F.col("s0_lag").alias("asof_fallback_days"), F.col("st_lag").alias("expiry_fallback_days"), F.col("st_date").alias("expiry_close_date_used"),
    )
    return ok, marked.where(F.col("drop_reason").isNotNull()).select("ticker", "week_monday", "week_friday", "asof_target", "drop_reason")


def chain_table(jobs: DataFrame, quotes: DataFrame, closes: DataFrame, dividends: DataFrame, rules: BuildRules) -> DataFrame:
    """Distinct chains with spot, volatility and yield per scale, and the expiration that is quoted."""
    chains = jobs.select(*CHAIN, "T_days", "S0_adj", "S0_raw", "ST_adj", "ST_raw", "expiry_close_date_used").distinct()
    total = lookups.window_total(chains, dividends, "amount", -rules.dividend_lookback, 0, "dividend_sum_lookback", "asof_date")
    vols = []
    for scale in ("adj", "raw"):
        v = lookups.realized_vol(closes.select("ticker", "date", F.col(f"close_{scale}").alias("close")), rules.rv_lookback, f"rv_{scale}")
        vols.append(v.select("ticker", F.col("date").alias("asof_date"), f"rv_{scale}"))
    out = total.join(vols[0], ["ticker", "asof_date"], "left").join(vols[1], ["ticker", "asof_date"], "left")
    listed = quotes.select("ticker", "asof_date", "expiration").distinct()
    at = lambda days, name: listed.select("ticker", "asof_date", F.date_sub("expiration", days).alias("week_friday"), F.lit(True).alias(name))
    out = out.join(at(0, "_fri"), CHAIN, "left")
    out = out.join(at(1, "_sat"), CHAIN, "left") if rules.saturday_fallback else out.withColumn("_sat", F.lit(None).cast("boolean"))
    used = F.when(F.col("_fri").isNotNull(), F.col("week_friday")).when(F.col("_sat").isNotNull(), F.date_add("week_friday", 1))
    return out.withColumns(
        {
            "expiration": used, "expiry_convention": F.when(F.col("_fri").isNull() & F.col("_sat").isNotNull(), "SAT_FALLBACK").otherwise("FRI"),
            "t_years": F.col("T_days") / YEAR,
        }
    ).drop("_fri", "_sat")


def scaled_chains(chains: DataFrame, rules: BuildRules) -> DataFrame:
    """Two candidate rows per chain: split-adjusted and raw spot, each with its yield and forward."""
    side = lambda tag, label: F.struct(
        F.lit(label).alias("spot_scale"), F.col(f"S0_{tag}").alias("spot"), F.col(f"ST_{tag}").alias("spot_expiry"), F.col(f"rv_{tag}").alias("rv20")
    )
    out = chains.where(F.col("expiration").isNotNull()).select("*", F.inline(F.array(side("adj", "split_adj"), side("raw", "raw"))))
    out = out.withColumn(
        "div_yield", dividend_yield(F.col("dividend_sum_lookback"), F.col("spot"), rules.dividend_lookback, rules.dividend_default)
    ).withColumn("rate", F.lit(rules.rate))
    fwd = F.col("spot") * F.exp((F.col("rate") - F.col("div_yield")) * F.col("t_years"))
    return out.withColumn("forward_price", fwd).withColumn("spot_ref", F.col("forward_price") if rules.forward_moneyness else F.col("spot"))


def probabilities(scaled: DataFrame, quotes: DataFrame, tiebreak: list[str], rules: BuildRules) -> DataFrame:
    """Banded strikes of the chosen scale with raw and monotone probability and chain diagnostics."""
    wanted = scaled.select(*SCALED, "expiration", "spot", "t_years", "rate", "div_yield")
    rows = quotes.join(wanted, ["ticker", "asof_date", "expiration"])
    strikes = C.strike_table(rows, SCALED, tiebreak, rules.curve).repartition(*CHAIN)  # both scales of a chain together, for all windows
    curve = C.call_curve(strikes, SCALED, rules.curve)
    curve = curve.join(scaled.select(*SCALED, "spot_ref"), SCALED)
    banded = C.choose_scale(C.with_band(curve, SCALED, "spot_ref", rules.curve), CHAIN, rules=rules.curve)
    thick = materialize(banded.where(F.col("n_band_inside") >= rules.curve.min_inside), "curves")
    spacing = C.strike_spacing(thick, CHAIN)
    knots = materialize(C.isotonic_knots(C.interval_probability(thick, CHAIN), CHAIN), "knots")
    flags = knots.groupBy(*CHAIN).agg(F.max("intervals_adjusted").alias("prn_monotone_adj_intervals"))
    targets = thick.where("in_band").drop("mid", "call_monotone", "call_smooth", "in_band", "rate", "div_yield", "t_years", "spot", "spot_ref")
    out = C.interpolate(knots, targets, CHAIN, "k_mid", ["p_interval", "p_isotonic"])
    # Interpolating a non-increasing curve at sorted strikes is non-increasing already, so the second
    # isotonic pass over the targets can change nothing.
    out = out.join(spacing.withColumnsRenamed({"median_dk": "median_dK", "min_dk": "min_dK"}), CHAIN).join(flags, CHAIN)
    return out.withColumn("prn_monotone_adj_targets", F.lit(False))


def training_rows(
    jobs: DataFrame, closes: DataFrame, dividends: DataFrame, quotes: DataFrame, tiebreak: list[str], rules: BuildRules = BuildRules(), weight: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(training rows, drop log) for a schedule of (ticker, week, as-of) jobs."""
    closes = materialize(closes, "closes")
    usable, drops = with_closes(jobs, closes, rules)
    usable = materialize(usable, "jobs")
    chains = materialize(chain_table(usable, quotes, closes, dividends, rules), "chains")
    scaled = scaled_chains(chains, rules)
    p = probabilities(scaled, quotes, tiebreak, rules)
    r7 = lambda c: F.bround(c, 7)
    p = p.withColumns({"pRN": fix_negative_zero(r7(F.col("p_isotonic"))), "pRN_raw": r7(F.col("p_interval")), "K": r7(F.col("strike"))})
    p = p.where(F.col("pRN").between(rules.min_prn, rules.max_prn))
    enough = p.groupBy(*CHAIN).agg(F.count("*").alias("_n")).where(F.col("_n") >= rules.min_in_prn_band).select(*CHAIN)
    p = materialize(p.join(enough, CHAIN, "left_semi"), "probabilities")
    attributes = scaled.drop("T_days", "S0_adj", "S0_raw", "ST_adj", "ST_raw", "rv_adj", "rv_raw", "rate", "t_years", "spot_ref", "expiry_close_date_used")
    rows = usable.join(p, CHAIN).join(attributes, SCALED)
    log_m = F.ln(F.col("K") / F.col("spot"))
    log_f = F.ln(F.col("K") / F.col("forward_price"))
    r9 = lambda c: F.bround(c, 9)
    stamp = F.concat(F.date_format("asof_date", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    expiry = F.col("expiration").cast("string")
    ticker = F.col("ticker").cast("string")
    built = rows.select(
        keys.row_id(stamp, ticker, expiry, F.col("K"), F.lit("call")).alias("row_id"), stamp.alias("asof_ts"), F.lit("call").alias("option_type"),
        ticker.alias("ticker"), "week_monday", "week_friday", "asof_target", "asof_date", F.col("asof_date").alias("snapshot_date"),
        calendar.weekday_label(F.lit(None).cast("string"), F.col("asof_date")).alias("snapshot_dow"), "expiry_close_date_used",
        F.col("expiration").alias("expiry_date"), F.col("week_friday").alias("week_id"), F.col("week_friday").alias("option_expiration_requested"),
        F.col("expiration").alias("option_expiration_used"), "expiry_convention", "T_days", r9(F.col("T_days") / YEAR).alias("T_years"),
        F.lit(rules.rate).alias("r"), r7(F.col("S0_raw")).alias("S_asof_close_raw"), r7(F.col("ST_raw")).alias("S_expiry_close_raw"),
        r7(F.col("S0_adj")).alias("S_asof_close_adj"), r7(F.col("ST_adj")).alias("S_expiry_close_adj"), "dividend_sum_lookback",
        F.bround("div_yield", 8).alias("dividend_yield"), "spot_scale", r7(F.col("spot")).alias("S_asof_close"), r7(F.col("spot_expiry")).alias("S_expiry_close"),
        r7(F.col("forward_price")).alias("forward_price"), "asof_fallback_days", "expiry_fallback_days", "K", r9(log_m).alias("log_m"),
        r9(F.abs(log_m)).alias("abs_log_m"), r9(log_f).alias("log_m_fwd"), r9(F.abs(log_f)).alias("abs_log_m_fwd"), F.bround("rv20", 8).alias("rv20"),
        "pRN", r7(F.lit(1.0) - F.col("pRN")).alias("qRN"), "pRN_raw", r7(F.lit(1.0) - F.col("pRN_raw")).alias("qRN_raw"),
        F.when(F.col("spot_expiry") > F.col("K"), 1).otherwise(0).alias("outcome_ST_gt_K"), F.bround("used_band", 6).alias("used_max_abs_logm"),
        "n_band_raw", "n_band_inside", F.lit("forward" if rules.forward_moneyness else "spot").alias("moneyness_ref"),
        r7(F.col("k_min")).alias("calls_k_min"), r7(F.col("k_max")).alias("calls_k_max"), "quote_source",
        "n_chain_raw", "n_chain_used", "rel_spread_median", "dropped_liquidity", "dropped_intrinsic", "dropped_insane", "prn_monotone_adj_intervals",
        "prn_monotone_adj_targets", "median_dK", "min_dK",
    ).withColumnRenamed("spot_scale", "spot_scale_used")
    best = relational.best_source(built, tiebreak=["asof_target", "week_friday"])
    out = weighting_v3(best, probe=False) if weight else best
    return out, drops.unionByName(_chain_drops(usable, scaled, chains, p))


def _chain_drops(usable: DataFrame, scaled: DataFrame, chains: DataFrame, kept: DataFrame) -> DataFrame:
    """Jobs lost after the closes were found: no chain listed, or no usable curve, band or probability."""
    listed = chains.where(F.col("expiration").isNotNull()).select(*CHAIN, F.lit(1).alias("_listed"))
    done = kept.select(*CHAIN).distinct().withColumn("_done", F.lit(1))
    marked = usable.join(listed, CHAIN, "left").join(done, CHAIN, "left").where(F.col("_done").isNull())
    reason = F.when(F.col("_listed").isNull(), "empty_option_chain").otherwise("no_usable_probability")
    return marked.select("ticker", "week_monday", "week_friday", "asof_target", reason.alias("drop_reason"))


def probabilities_at_strikes(
    quotes: DataFrame, chains: DataFrame, strikes: DataFrame, chain: list[str], tiebreak: list[str], on: Sequence[str] = ("ticker", "asof_date"), rules: C.CurveRules = C.CurveRules()
) -> DataFrame:
    """Benchmark probability at requested strikes (`on`..., strike) that lie inside the quoted range of a chain.

    Requests meet the chains of their own `on` columns, some of `chain`: a row per request and chain of that ticker and date.
    """
    rows = quotes.join(chains, [c for c in chain if c in quotes.columns])
    curve = C.call_curve(C.strike_table(rows, chain, tiebreak, rules), chain, rules)
    knots = C.isotonic_knots(C.interval_probability(curve, chain), chain)
    span = curve.groupBy(*chain).agg(F.min("strike").alias("_lo"), F.max("strike").alias("_hi"))
    wanted = strikes.select(*on, F.round("strike", 2).alias("strike")).distinct()
    inside = span.join(wanted, list(on)).where(F.col("strike").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    out = C.interpolate(knots, inside, chain, "k_mid", ["p_isotonic"])
    return out.withColumnRenamed("p_isotonic", "pRN")


def overlay(rows: DataFrame, tiebreak: list[str]) -> DataFrame:
    """Per (ticker, strike rounded to cents): ordered (date, days, pRN) points for horizons 1..4, first per date and horizon."""
    ok = rows.where(F.col("T_days").isin(1, 2, 3, 4) & F.col("pRN").isNotNull() & F.col("K").isNotNull())
    ok = ok.withColumn("strike", F.round("K", 2))
    first = ok.groupBy("ticker", "strike", "asof_date", "T_days").agg(F.min_by("pRN", F.struct(*tiebreak)).alias("pRN"))
    # Points per strike are bounded by calendar days times four horizons.
    return first.groupBy("ticker", "strike").agg(F.sort_array(F.collect_list(F.struct("asof_date", "T_days", "pRN"))).alias("points"))
