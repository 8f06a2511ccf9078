"""Live snapshot: probability at the market's strikes, monotone in strike, merged with quotes and enriched."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strikelake.functions.features import enrich_snapshot
from strikelake.operators import chain as C
from strikelake.operators.filters import two_sided_market
from strikelake.operators.relational import rounded_key_join

RULES = C.rules_with(min_curve_strikes=3, intrinsic_tol=0.0, insane_multiple=1e12)


def snapshot_probabilities(
    targets: DataFrame, quotes: DataFrame, chain: list[str], tiebreak: list[str], rules: C.CurveRules = RULES, monotone: bool = True
) -> DataFrame:
    """targets(chain..., K, spot, t_years, rate, atm_sigma) to pRN_raw, pRN, method and bracket width.

    Unlike the training build, prices below 0.8 of intrinsic are dropped and the rest lifted to it. Every target with a K
    comes back: where no chain is left to read, with NULL probabilities and the reason as its method.
    """
    strikes = C.strike_table(quotes, chain, tiebreak, rules)
    clipped = C.clip_to_no_arbitrage(C.call_curve(strikes, chain, rules), chain, window=rules.smooth_window)
    raw = C.bracket_probability(targets, C.thick_chains(clipped, chain, rules.min_curve_strikes), chain)
    raw = C.label_missing_chains(raw, strikes, clipped, chain, rules).withColumn("pRN_raw", F.bround("p_rn", 7)).drop("p_rn")
    if not monotone:
        return raw.withColumns({"pRN": F.col("pRN_raw"), "rn_monotone_adjusted": F.lit(False)})
    return C.monotone_snapshot(raw, chain)


def snapshot_table(market: DataFrame, probabilities: DataFrame, rate: float = 0.03) -> DataFrame:
    """Market quotes with their probability on (ticker, date, strike to 4 places), plus all derived features."""
    quoted = two_sided_market(market)
    merged = rounded_key_join(quoted, probabilities)
    return enrich_snapshot(merged.withColumn("qRN", F.bround(F.lit(1.0) - F.col("pRN"), 7)), rate)
