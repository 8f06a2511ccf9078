"""Option-chain queries: cleaning, curves, probabilities, bands, snapshot values."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelake.catalog import register
from strikelake.functions.scalar import round_half_up as r
from strikelake.operators import chain as C
from strikelake.session import materialize
from strikelake.sources.tables import QUOTES, option_quotes

CHAIN = ["ticker", "asof_date"]
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
T_YEARS, RATE, DIV = 0.0821, 0.03, 0.01


def r9(expr: str) -> str:
    return f"floor(({expr}) * 1000000000.0::DOUBLE + 0.5) / 1000000000.0::DOUBLE"


def quotes(spark, d):
    return option_quotes(spark, d).withColumns(
        {"spot": F.lit(100.0), "t_years": F.lit(T_YEARS), "rate": F.lit(RATE), "div_yield": F.lit(DIV)}
    )


def strikes(spark, d):
    return C.strike_table(quotes(spark, d), CHAIN, TIE)


def curve(spark, d, **rules):
    rule = C.rules_with(**rules)
    return C.call_curve(C.strike_table(quotes(spark, d), CHAIN, TIE, rule), CHAIN, rule)


W = "PARTITION BY ticker, asof_date"
CLEAN = (
    QUOTES,
    "q0 AS (SELECT *, CASE WHEN bid >= 0 AND ask > 0 AND ask >= bid THEN (bid + ask) * 0.5::DOUBLE END AS mid_ba FROM option_quotes)",
    f"q1 AS (SELECT *, (ask - bid) / mid_ba AS rel, count(mid_ba) OVER ({W}) AS nm FROM q0)",
    """q2 AS (SELECT *, CASE WHEN nm >= 10 THEN mid_ba ELSE close END AS px,
  CASE WHEN nm >= 10 THEN mid_ba > 0 AND (rel IS NULL OR rel <= 2.0) ELSE close > 0 END AS ok,
  0.98::DOUBLE * greatest(100.0::DOUBLE * exp(-0.01::DOUBLE * 0.0821::DOUBLE) - strike * exp(-0.03::DOUBLE * 0.0821::DOUBLE), 0.0) AS fl FROM q1)""",
    "q3 AS (SELECT *, ok AND px >= fl AND px <= 150.0 AS pass FROM q2)",
    """used AS (SELECT ticker, asof_date, strike, px, rel, nm FROM (SELECT *, row_number() OVER (PARTITION BY ticker, asof_date, strike
  ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn FROM q3 WHERE pass) WHERE rn = 1)""",
)
CURVE = (
    *CLEAN,
    f"thick AS (SELECT *, count(*) OVER ({W}) AS n_used FROM used QUALIFY count(*) OVER ({W}) >= 5)",
    f"mono AS (SELECT *, max(px) OVER ({W} ORDER BY strike DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cm FROM thick)",
    f"smooth AS (SELECT *, quantile_cont(cm, 0.5) OVER ({W} ORDER BY strike ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS cs FROM mono)",
)
INTERVALS = (
    *CURVE,
    f"""iv AS (SELECT *, (strike + lag(strike) OVER w) * 0.5::DOUBLE AS k_mid,
   least(greatest(-exp(0.03::DOUBLE * 0.0821::DOUBLE) * ((cs - lag(cs) OVER w) / (strike - lag(strike) OVER w)), 0.0), 1.0) AS p,
   row_number() OVER w - 1 AS i FROM smooth WINDOW w AS ({W} ORDER BY strike))""",
)
ISOTONIC = (
    *INTERVALS,
    f"pre AS (SELECT ticker, asof_date, i, k_mid, p, sum(p) OVER ({W} ORDER BY i) AS s FROM iv WHERE i >= 1)",
    """spans AS (SELECT a.ticker, a.asof_date, a.i AS a, b.i AS b, (b.s - a.s + a.p) / (b.i - a.i + 1) AS m
  FROM pre a JOIN pre b ON a.ticker = b.ticker AND a.asof_date = b.asof_date AND a.i <= b.i)""",
    "hi AS (SELECT x.ticker, x.asof_date, x.i, s.a, max(s.m) AS m FROM pre x JOIN spans s ON s.ticker = x.ticker AND s.asof_date = x.asof_date AND s.a <= x.i AND s.b >= x.i GROUP BY 1, 2, 3, 4)",
    "iso AS (SELECT h.ticker, h.asof_date, h.i, min(h.m) AS p_iso FROM hi h GROUP BY 1, 2, 3)",
    "knots AS (SELECT pre.*, iso.p_iso FROM pre JOIN iso USING (ticker, asof_date, i))",
)


@register(
    "chain_quote_filter",
    *CLEAN,
    """g AS (SELECT ticker, asof_date, count(*) AS n_raw, CASE WHEN max(nm) >= 10 THEN 'bidask_mid' ELSE 'close_fallback' END AS quote_source,
  count_if(ok AND px < fl) AS dropped_intrinsic, count_if(ok AND px >= fl AND px > 150.0) AS dropped_insane FROM q3 GROUP BY 1, 2)""",
    "u AS (SELECT ticker, asof_date, count(*) AS n_used, quantile_cont(rel, 0.5) AS med FROM used GROUP BY 1, 2)",
    sql=f"""SELECT g.ticker, g.asof_date, g.n_raw, g.quote_source, CAST(g.dropped_intrinsic AS BIGINT) AS dropped_intrinsic,
  CAST(g.dropped_insane AS BIGINT) AS dropped_insane, CAST(coalesce(u.n_used, 0) AS BIGINT) AS n_used, {r9('u.med')} AS rel_spread_median
  FROM g LEFT JOIN u USING (ticker, asof_date)""",
)
def chain_quote_filter(spark, d):
    out = C.chain_diagnostics(strikes(spark, d), CHAIN).drop("dropped_liquidity")
    return out.withColumn("rel_spread_median", r(F.col("rel_spread_median"), 9))


@register(
    "monotone_call_curve",
    *CURVE,
    sql="SELECT ticker, asof_date, strike, px AS mid, cm AS call_monotone, cs AS call_smooth, n_used AS n_chain_used FROM smooth",
)
def monotone_call_curve(spark, d):
    return curve(spark, d).select("ticker", "asof_date", "strike", "mid", "call_monotone", "call_smooth", "n_chain_used")


@register(
    "strike_spacing",
    *CLEAN,
    f"gaps AS (SELECT *, strike - lag(strike) OVER ({W} ORDER BY strike) AS gap FROM used)",
    sql="""SELECT ticker, asof_date, CASE WHEN count(*) >= 3 THEN quantile_cont(gap, 0.5) END AS median_dk, CASE WHEN count(*) >= 3 THEN min(gap) END AS min_dk
  FROM gaps GROUP BY 1, 2""",
)
def strike_spacing(spark, d):
    return C.strike_spacing(curve(spark, d, min_curve_strikes=1), CHAIN)


@register(
    "interval_probabilities",
    *INTERVALS,
    sql=f"SELECT ticker, asof_date, k_mid, {r9('p')} AS p_interval FROM iv WHERE i >= 1",
)
def interval_probabilities(spark, d):
    out = C.interval_probability(curve(spark, d), CHAIN).where(F.col("k_mid").isNotNull())
    return out.select("ticker", "asof_date", "k_mid", r(F.col("p_interval"), 9).alias("p_interval"))


@register(
    "isotonic_probabilities",
    *ISOTONIC,
    sql=f"SELECT ticker, asof_date, k_mid, {r9('p')} AS p_interval, {r9('p_iso')} AS p_isotonic FROM knots",
)
def isotonic_probabilities(spark, d):
    knots = C.isotonic_knots(C.interval_probability(curve(spark, d), CHAIN), CHAIN)
    return knots.select(
        "ticker", "asof_date", "k_mid", r(F.col("p_interval"), 9).alias("p_interval"), r(F.col("p_isotonic"), 9).alias("p_isotonic")
    )


@register(
    "strike_interpolation",
    *ISOTONIC,
    "tg AS (SELECT ticker, asof_date, strike FROM smooth)",
    """br AS (SELECT t.ticker, t.asof_date, t.strike, max_by(struct_pack(x := k.k_mid, a := k.p, b := k.p_iso), k.k_mid) FILTER (WHERE k.k_mid <= t.strike) AS l,
   min_by(struct_pack(x := k.k_mid, a := k.p, b := k.p_iso), k.k_mid) FILTER (WHERE k.k_mid > t.strike) AS r
   FROM tg t JOIN knots k ON t.ticker = k.ticker AND t.asof_date = k.asof_date GROUP BY 1, 2, 3)""",
    sql=f"""SELECT ticker, asof_date, strike,
  {r9('CASE WHEN l IS NULL THEN r.a WHEN r IS NULL THEN l.a ELSE (r.a - l.a) / (r.x - l.x) * (strike - l.x) + l.a END')} AS p_raw,
  {r9('CASE WHEN l IS NULL THEN r.b WHEN r IS NULL THEN l.b ELSE (r.b - l.b) / (r.x - l.x) * (strike - l.x) + l.b END')} AS p
  FROM br""",
)
def strike_interpolation(spark, d):
    c = curve(spark, d)
    knots = C.isotonic_knots(C.interval_probability(c, CHAIN), CHAIN)
    out = C.interpolate(knots, c.select("ticker", "asof_date", "strike"), CHAIN, "k_mid", ["p_interval", "p_isotonic"])
    return out.select(
        "ticker", "asof_date", "strike", r(F.col("p_interval"), 9).alias("p_raw"), r(F.col("p_isotonic"), 9).alias("p")
    )


_WIDTHS = C.band_widths(C.CurveRules(band_start=0.06, band_cap=0.26, band_step=0.05))


@register(
    "adaptive_strike_band",
    *CURVE,
    f"x AS (SELECT *, abs(ln(strike / 100.0::DOUBLE)) AS d, strike > min(strike) OVER ({W}) AND strike < max(strike) OVER ({W}) AS inner_k FROM smooth)",
    "n AS (SELECT ticker, asof_date, "
    + ", ".join(f"count_if(d <= {w!r}::DOUBLE AND inner_k) AS n{i}" for i, w in enumerate(_WIDTHS))
    + " FROM x GROUP BY 1, 2)",
    "u AS (SELECT ticker, asof_date, CASE "
    + " ".join(f"WHEN n{i} >= 3 THEN {w!r}::DOUBLE" for i, w in enumerate(_WIDTHS))
    + " ELSE 0.26::DOUBLE END AS used FROM n)",
    sql=f"""SELECT x.ticker, x.asof_date, {r9('max(used)')} AS used_band, CAST(count_if(d <= used) AS BIGINT) AS n_band_raw,
  CAST(count_if(d <= used AND inner_k) AS BIGINT) AS n_band_inside FROM x JOIN u USING (ticker, asof_date) GROUP BY 1, 2""",
)
def adaptive_strike_band(spark, d):
    rules = C.rules_with(band_start=0.06, band_cap=0.26, band_step=0.05, min_inside=3)
    banded = C.with_band(curve(spark, d).withColumn("spot_ref", F.lit(100.0)), CHAIN, rules=rules)
    return banded.groupBy(*CHAIN).agg(
        r(F.max("used_band"), 9).alias("used_band"), F.max("n_band_raw").alias("n_band_raw"), F.max("n_band_inside").alias("n_band_inside")
    )


@register(
    "nearest_strikes",
    *CURVE,
    f"x AS (SELECT *, row_number() OVER ({W} ORDER BY abs(ln(strike / 100.0::DOUBLE)), strike) AS rn FROM smooth)",
    sql="SELECT ticker, asof_date, strike FROM x WHERE rn <= 4 AND abs(ln(strike / 100.0::DOUBLE)) <= 0.3::DOUBLE AND strike > 0",
)
def nearest_strikes(spark, d):
    rules = C.rules_with(max_band_strikes=4, adaptive_band=False, band_start=0.3)
    banded = C.with_band(curve(spark, d).withColumn("spot_ref", F.lit(100.0)), CHAIN, rules=rules)
    # The cap keeps the nearest strikes; edge strikes of the chain still count as raw band members.
    near = F.row_number().over(C.Window.partitionBy(*CHAIN).orderBy(F.abs(F.ln(F.col("strike") / 100.0)), "strike")) <= 4
    return banded.where(F.abs(F.ln(F.col("strike") / 100.0)) <= F.col("used_band")).withColumn("_n", near).where("_n").select("ticker", "asof_date", "strike")


@register(
    "spot_scale_choice",
    QUOTES,
    "scales(scale, spot) AS (VALUES ('split_adj', 100.0::DOUBLE), ('raw', 80.0::DOUBLE))",
    "q0 AS (SELECT *, CASE WHEN bid >= 0 AND ask > 0 AND ask >= bid THEN (bid + ask) * 0.5::DOUBLE END AS mid_ba FROM option_quotes, scales)",
    f"q1 AS (SELECT *, (ask - bid) / mid_ba AS rel, count(mid_ba) OVER ({W}, scale) AS nm FROM q0)",
    """q2 AS (SELECT *, CASE WHEN nm >= 10 THEN mid_ba ELSE close END AS px, CASE WHEN nm >= 10 THEN mid_ba > 0 AND (rel IS NULL OR rel <= 2.0) ELSE close > 0 END AS ok,
  0.98::DOUBLE * greatest(spot * exp(-0.01::DOUBLE * 0.0821::DOUBLE) - strike * exp(-0.03::DOUBLE * 0.0821::DOUBLE), 0.0) AS fl FROM q1)""",
    "u AS (SELECT DISTINCT ticker, asof_date, scale, spot, strike FROM q2 WHERE ok AND px >= fl AND px <= 1.5::DOUBLE * spot)",
    f"""x AS (SELECT *, count(*) OVER ({W}, scale) AS n_used, abs(ln(strike / spot)) AS d,
    strike > min(strike) OVER ({W}, scale) AND strike < max(strike) OVER ({W}, scale) AS inner_k FROM u)""",
    "n AS (SELECT ticker, asof_date, scale, max(n_used) AS n_used, "
    + ", ".join(f"count_if(d <= {w!r}::DOUBLE AND inner_k) AS n{i}" for i, w in enumerate(_WIDTHS))
    + " FROM x WHERE n_used >= 5 GROUP BY 1, 2, 3)",
    "s AS (SELECT *, CASE "
    + " ".join(f"WHEN n{i} >= 3 THEN n{i}" for i in range(len(_WIDTHS)))
    + f" ELSE n{len(_WIDTHS) - 1} END AS n_in FROM n)",
    """b AS (SELECT *, row_number() OVER (PARTITION BY ticker, asof_date ORDER BY CASE WHEN n_in >= 3 THEN 1000000 ELSE 0 END + n_in DESC, n_used DESC, scale = 'split_adj' DESC) AS rn FROM s)""",
    sql="SELECT ticker, asof_date, scale AS spot_scale, CAST(n_in AS BIGINT) AS n_band_inside, n_used AS n_chain_used FROM b WHERE rn = 1",
)
def spot_scale_choice(spark, d):
    rules = C.rules_with(band_start=0.06, band_cap=0.26, band_step=0.05, min_inside=3)
    scales = F.array(
        F.struct(F.lit("split_adj").alias("spot_scale"), F.lit(100.0).alias("spot")),
        F.struct(F.lit("raw").alias("spot_scale"), F.lit(80.0).alias("spot")),
    )
    q = quotes(spark, d).drop("spot").select("*", F.inline(scales))
    keys = [*CHAIN, "spot_scale"]
    # No spread is asked for, so none is shuffled. Both scales of a chain come together, for all windows.
    priced = lambda name: F.when(F.col(name).isNotNull(), F.struct(F.col(name)["px"].alias("px"), F.lit(None).cast("double").alias("rel")))
    table = C.strike_table(q, keys, TIE, rules).withColumns({name: priced(name) for name in ("mid_q", "close_q")}).repartition(*CHAIN)
    c = C.call_curve(table, keys, rules).withColumn("spot_ref", F.col("spot"))
    best = C.choose_scale(C.with_band(c, keys, rules=rules), CHAIN, rules=rules)
    return best.groupBy(*CHAIN).agg(
        F.max("spot_scale").alias("spot_scale"), F.max("n_band_inside").alias("n_band_inside"), F.max("n_chain_used").alias("n_chain_used")
    )


@register(
    "snapshot_bracket_probability",
    *CURVE,
    """tg AS (SELECT DISTINCT ticker, asof_date, strike + 0.5::DOUBLE AS K, CASE WHEN ticker % 2 = 0 THEN 0.35::DOUBLE END AS sig FROM used)""",
    """e AS (SELECT t.*, list(s.strike ORDER BY s.strike) AS ks, list(s.cs ORDER BY s.strike) AS cs, CAST(count_if(s.strike < t.K) AS INT) AS i
  FROM tg t JOIN smooth s ON s.ticker = t.ticker AND s.asof_date = t.asof_date GROUP BY ALL)""",
    "f AS (SELECT *, greatest(i - 2, 0) + 1 AS a, least(i + 1, len(ks) - 1) + 1 AS b FROM e)",
    "g AS (SELECT *, ks[b] - ks[a] AS gap, K <= ks[1] AS low, K >= ks[len(ks)] AS high FROM f)",
    "h AS (SELECT *, CASE WHEN NOT low AND NOT high AND gap > 0 THEN gap END AS dk, (cs[b] - cs[a]) / nullif(gap, 0) AS sl FROM g)",
    "o AS (SELECT *, CASE WHEN dk IS NOT NULL AND sl <= 0 THEN least(greatest(-exp(0.03::DOUBLE * 0.0821::DOUBLE) * sl, 0.0), 1.0) END AS own FROM h)",
    "z AS (SELECT *, own IS NULL OR coalesce(dk > 30.0, false) AS poor FROM o)",
    """y AS (SELECT *, (ln(100.0::DOUBLE / K) + (0.03::DOUBLE - sig * sig * 0.5) * 0.0821::DOUBLE) / (sig * sqrt(0.0821::DOUBLE)) AS d2 FROM z)""",
    "v AS (SELECT *, 1.0 / (1.0 + abs(d2) * 0.2316419::DOUBLE) AS t FROM y)",
    """p AS (SELECT *, exp(-(d2 * d2) * 0.5) * (1.0 / sqrt(2.0 * pi())) * t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE
  + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE)))) AS up FROM v)""",
    "n AS (SELECT *, CASE WHEN d2 >= 0 THEN 1.0 - up ELSE up END AS tail FROM p)",
    sql=f"""SELECT ticker, asof_date, K, {r9('CASE WHEN low THEN 1.0 WHEN high THEN 0.0 WHEN poor THEN coalesce(tail, own) ELSE own END')} AS p_rn, dk AS delta_k,
  CASE WHEN low THEN 'extrap_lowK' WHEN high THEN 'extrap_highK' WHEN NOT poor THEN 'call_slope' WHEN tail IS NOT NULL THEN 'bs_atm_iv_fallback' ELSE 'missing_no_iv' END AS rn_method
  FROM n""",
)
def snapshot_bracket_probability(spark, d):
    # Written once: the curves asked of are those of the chains with enough strikes.
    kept = C.call_curve(strikes(spark, d), CHAIN, C.rules_with(min_curve_strikes=1))
    kept = materialize(kept.select(*CHAIN, "strike", "call_smooth", "n_chain_used"), "curves")
    c = kept.where(F.col("n_chain_used") >= C.CurveRules().min_curve_strikes)
    targets = kept.select(
        *CHAIN, (F.col("strike") + 0.5).alias("K"), F.when(F.col("ticker") % 2 == 0, 0.35).alias("atm_sigma"),
        F.lit(100.0).alias("spot"), F.lit(T_YEARS).alias("t_years"), F.lit(RATE).alias("rate"),
    )
    # The SQL asks only for targets whose chain has a curve; snapshot_probability_table returns the others too.
    # (No calls used is the method no_chain; a filter on the method would work out its nested cases again for every row.)
    out = C.bracket_probability(targets, c, CHAIN).where(F.col("n_calls_used") > 0)
    return out.select(*CHAIN, "K", r(F.col("p_rn"), 9).alias("p_rn"), "delta_k", "rn_method")


@register(
    "snapshot_monotone_projection",
    QUOTES,
    "k0 AS (SELECT ticker, asof_date, strike AS K, max(close / 137.0::DOUBLE) AS c, max(l_partkey) AS pk FROM option_quotes GROUP BY 1, 2, 3)",
    f"k1 AS (SELECT *, CASE WHEN pk % 3 <> 0 THEN c END AS raw, row_number() OVER ({W} ORDER BY K) AS i FROM k0)",
    f"""k2 AS (SELECT *, last_value(CASE WHEN raw IS NOT NULL THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li,
   last_value(least(greatest(raw, 0), 1) + CASE WHEN raw IS NULL THEN NULL ELSE 0 END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv,
   first_value(CASE WHEN raw IS NOT NULL THEN i END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri,
   first_value(least(greatest(raw, 0), 1) + CASE WHEN raw IS NULL THEN NULL ELSE 0 END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv
   FROM k1 WINDOW w AS ({W} ORDER BY K))""",
    "k3 AS (SELECT *, CASE WHEN li IS NULL THEN rv WHEN ri IS NULL OR li = ri THEN lv ELSE lv + (rv - lv) * ((i - li)::DOUBLE / (ri - li)) END AS p FROM k2)",
    f"k4 AS (SELECT *, max(p) OVER ({W} ORDER BY K DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM k3)",
    sql="SELECT ticker, asof_date, K, floor(round_even(m, 7) * 100000.0::DOUBLE + 0.5) / 100000.0::DOUBLE AS pRN FROM k4",
)
def snapshot_monotone_projection(spark, d):
    q = option_quotes(spark, d).groupBy(*CHAIN, F.col("strike").alias("K")).agg(
        F.max(F.col("close") / 137.0).alias("c"), F.max("l_partkey").alias("pk")
    )
    q = q.select(*CHAIN, "K", F.when(F.col("pk") % 3 != 0, F.col("c")).alias("pRN_raw"))
    return C.monotone_snapshot(q, CHAIN).select(*CHAIN, "K", r(F.col("pRN"), 5).alias("pRN"))


@register(
    "chain_group_sanity",
    QUOTES,
    """g AS (SELECT concat(CAST(ticker AS VARCHAR), '|', strftime(asof_date, '%Y-%m-%d')) AS group_id, strike AS K, 50.0 + (ticker % 12) * 10.0 AS S,
   abs(ln(strike / (50.0::DOUBLE + (ticker % 12) * 10.0))) AS alm FROM (SELECT DISTINCT ticker, asof_date, strike FROM option_quotes))""",
    """s AS (SELECT group_id, count(*) AS n, quantile_cont(alm, 0.5) AS ma, quantile_cont(K / S, 0.5) AS mk, min(K / S) AS lo, max(K / S) AS hi FROM g GROUP BY 1)""",
    sql=f"""SELECT group_id, n, {r9('ma')} AS med_abs_log_m, {r9('mk')} AS med_k_over_s, {r9('lo')} AS min_k_over_s, {r9('hi')} AS max_k_over_s,
  NOT (ma <= 0.4::DOUBLE AND mk BETWEEN 0.75 AND 1.5) AS broken FROM s""",
)
def chain_group_sanity(spark, d):
    s = C.group_sanity(_sanity_rows(spark, d))
    bad = C.broken_groups(s, 0.4, 0.75, 1.5).select("group_id", F.lit(True).alias("broken"))
    out = s.join(bad, "group_id", "left").withColumn("broken", F.coalesce("broken", F.lit(False)))
    return out.select("group_id", "n", *[r(F.col(c), 9).alias(c) for c in s.columns[2:]], "broken")


def _sanity_rows(spark, d):
    q = option_quotes(spark, d).select("ticker", "asof_date", "strike").distinct()
    spot = F.lit(50.0) + (F.col("ticker") % 12) * 10.0
    return q.select(
        F.concat(F.col("ticker").cast("string"), F.lit("|"), F.date_format("asof_date", "yyyy-MM-dd")).alias("group_id"),
        F.col("strike").alias("K"), spot.alias("S"), F.abs(F.ln(F.col("strike") / spot)).alias("abs_log_m"),
    )


@register(
    "worst_chain_groups",
    QUOTES,
    """g AS (SELECT concat(CAST(ticker AS VARCHAR), '|', strftime(asof_date, '%Y-%m-%d')) AS group_id, strike AS K, 50.0 + (ticker % 12) * 10.0 AS S,
   abs(ln(strike / (50.0::DOUBLE + (ticker % 12) * 10.0))) AS alm FROM (SELECT DISTINCT ticker, asof_date, strike FROM option_quotes))""",
    "s AS (SELECT group_id, quantile_cont(alm, 0.5) AS ma, quantile_cont(K / S, 0.5) AS mk FROM g GROUP BY 1)",
    sql="""(SELECT group_id, 'abs_log_m' AS criterion FROM s ORDER BY ma DESC, group_id LIMIT 5)
 UNION ALL (SELECT group_id, 'k_over_s' FROM s ORDER BY abs(mk - 1.0) DESC, group_id LIMIT 5)""",
)
def worst_chain_groups(spark, d):
    return C.worst_groups(C.group_sanity(_sanity_rows(spark, d))).select("group_id", "criterion")
