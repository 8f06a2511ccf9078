"""Training-set builds, models, selection and edge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikelake.catalog import chains as CH_, register
from strikelake.catalog.scoring import labelled, tie
from strikelake.functions.scalar import round_half_up as r
from strikelake.models import logistic as L, mixed as X, selection as S
from strikelake.operators import chain as C, lookups, quality as Q
from strikelake.plans import datasets as D, option_training as O
from strikelake.sources.tables import DIVIDENDS, LABELLED, dividends, load


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1000000.0::DOUBLE + 0.5) / 1000000.0::DOUBLE"


# --- option training build ------------------------------------------------------------------------

TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
RULES = O.BuildRules(min_in_prn_band=3, curve=C.rules_with(min_inside=5))

FEED = """feed AS (SELECT o_custkey % 10 AS ticker, CAST(o_orderdate AS DATE) AS date, 95.0::DOUBLE + (max(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) % 1000) / 100.0::DOUBLE AS close
  FROM orders GROUP BY 1, 2)"""
FSPLITS = """fsplits AS (SELECT p_partkey % 10 AS ticker, CAST(DATE '1995-06-01' + CAST(p_partkey % 2000 AS INT) AS DATE) AS date, 2.0::DOUBLE AS ratio FROM part WHERE p_partkey % 250 IN (7, 11))"""
FQUOTES = """fq AS (SELECT l_suppkey % 10 AS ticker, CAST(wk + CAST(date_diff('day', DATE '1995-01-02', wk) // 7 % 4 AS INT) AS DATE) AS ad, CAST(wk + 4 + CASE WHEN date_diff('day', DATE '1995-01-02', wk) // 7 % 5 = 0 THEN 1 ELSE 0 END AS DATE) AS ex,
  CAST(90 + l_partkey % 21 AS DOUBLE) AS strike, greatest(100.0::DOUBLE - (90 + l_partkey % 21), 0.0::DOUBLE) + 0.5 + l_quantity / 50.0 AS bid,
  greatest(100.0::DOUBLE - (90 + l_partkey % 21), 0.0::DOUBLE) + 0.5 + l_quantity / 50.0 + 0.1 + l_discount AS ask, l_quantity / 10.0 AS close, l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) - CAST(isodow(l_shipdate) - 1 AS INT) AS DATE) AS wk FROM lineitem))"""


def feed(spark, d):
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint")
    return load(spark, d, "orders").groupBy((F.col("o_custkey") % 10).alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(
        (F.lit(95.0) + (F.max(cents) % 1000) / 100.0).alias("close")
    )


def feed_splits(spark, d):
    p = F.col("p_partkey")
    return load(spark, d, "part").where((p % 250).isin(7, 11)).select(
        (p % 10).alias("ticker"), F.date_add(F.lit("1995-06-01").cast("date"), (p % 2000).cast("int")).alias("date"), F.lit(2.0).alias("ratio")
    )


def feed_quotes(spark, d):
    day = F.to_date("l_shipdate")
    wk = F.date_sub(day, F.weekday(day))
    n = F.floor(F.date_diff(wk, F.lit("1995-01-02").cast("date")) / 7).cast("int")
    k = F.lit(90) + F.col("l_partkey") % 21
    base = F.greatest(F.lit(100.0) - k, F.lit(0.0)) + 0.5 + F.col("l_quantity") / 50.0
    return load(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("ticker"), F.date_add(wk, n % 4).alias("asof_date"),
        F.date_add(wk, F.when(n % 5 == 0, 5).otherwise(4)).alias("expiration"), k.cast("double").alias("strike"), base.alias("bid"),
        (base + 0.1 + F.col("l_discount")).alias("ask"), (F.col("l_quantity") / 10.0).alias("close"), *TIE,
    )


def jobs(spark, d):
    """Every week that has a shipment, Monday to Thursday, for every ticker of the feed."""
    day = F.to_date("l_shipdate")
    weeks = load(spark, d, "lineitem").select(F.date_sub(day, F.weekday(day)).alias("week_monday")).distinct()
    # The feed's tickers are 0 to 9.
    names = feed(spark, d).select("ticker").distinct()
    grid = weeks.withColumn("ticker", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint")))).join(names, "ticker", "left_semi")
    offset = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("_o")
    return grid.select("ticker", "week_monday", F.date_add("week_monday", 4).alias("week_friday"), offset).select(
        "ticker", "week_monday", "week_friday", F.date_add("week_monday", F.col("_o")).alias("asof_target")
    )


def build(spark, d, weight=False):
    both = lookups.both_scales(feed(spark, d), feed_splits(spark, d))
    divs = dividends(spark, d).withColumn("amount", F.col("amount") / 16)
    return O.training_rows(jobs(spark, d), both, divs, feed_quotes(spark, d), TIE, RULES, weight)


CH = "PARTITION BY ticker, ad, fri, sc"
BUILD = (
    DIVIDENDS, FEED, FSPLITS, FQUOTES,
    """sf AS (SELECT f.ticker, f.date, f.close, coalesce(exp(sum(ln(s.ratio))), 1.0::DOUBLE) AS factor FROM feed f LEFT JOIN fsplits s ON s.ticker = f.ticker AND s.date > f.date GROUP BY 1, 2, 3)""",
    """ev AS (SELECT s.ticker, s.date, s.ratio, max_by(c.close, c.date) FILTER (WHERE c.date < s.date) AS pre, min_by(c.close, c.date) FILTER (WHERE c.date >= s.date) AS post FROM fsplits s JOIN feed c ON c.ticker = s.ticker GROUP BY ALL)""",
    """st AS (SELECT ticker, min_by(v, date) AS adj FROM (SELECT *, CASE WHEN abs(pre / post - ratio) / ratio <= 0.25 THEN false WHEN abs(pre / post - 1.0) <= 0.25 THEN true END AS v FROM ev) WHERE v IS NOT NULL GROUP BY 1)""",
    """cl AS (SELECT sf.ticker, sf.date, CASE WHEN coalesce(adj, false) THEN close * factor ELSE close END AS raw, CASE WHEN coalesce(adj, false) THEN close ELSE close / factor END AS adj FROM sf LEFT JOIN st USING (ticker))""",
    "wks AS (SELECT DISTINCT CAST(CAST(l_shipdate AS DATE) - CAST(isodow(l_shipdate) - 1 AS INT) AS DATE) AS mon FROM lineitem)",
    "jb AS (SELECT t.ticker, mon, CAST(mon + 4 AS DATE) AS fri, CAST(mon + o AS DATE) AS tgt FROM wks, (SELECT DISTINCT ticker FROM feed) t, (SELECT unnest([0, 1, 2, 3]) AS o))",
    "j1 AS (SELECT j.*, min(c.date) AS ad FROM jb j LEFT JOIN cl c ON c.ticker = j.ticker AND c.date BETWEEN j.tgt AND j.tgt + 3 GROUP BY ALL)",
    "j2 AS (SELECT j.*, max(c.date) AS ed FROM j1 j LEFT JOIN cl c ON c.ticker = j.ticker AND c.date BETWEEN j.fri - 3 AND j.fri GROUP BY ALL)",
    """j3 AS (SELECT j2.*, CAST(fri - ad AS INT) AS td, a.raw AS s0r, a.adj AS s0a, e.raw AS str, e.adj AS sta FROM j2 JOIN cl a ON a.ticker = j2.ticker AND a.date = ad JOIN cl e ON e.ticker = j2.ticker AND e.date = ed WHERE fri > ad)""",
    """ck AS (SELECT DISTINCT j3.ticker, j3.ad, j3.fri, td, s0r, s0a, str, sta, CASE WHEN x.ticker IS NOT NULL THEN fri WHEN y.ticker IS NOT NULL THEN fri + 1 END AS ex FROM j3
   LEFT JOIN (SELECT DISTINCT ticker, ad, ex FROM fq) x ON x.ticker = j3.ticker AND x.ad = j3.ad AND x.ex = j3.fri LEFT JOIN (SELECT DISTINCT ticker, ad, ex FROM fq) y ON y.ticker = j3.ticker AND y.ad = j3.ad AND y.ex = j3.fri + 1)""",
    """dz AS (SELECT ck.ticker, ck.ad, sum(v.amount / 16) AS ds FROM (SELECT DISTINCT ticker, ad FROM ck) ck JOIN dividends v ON v.ticker = ck.ticker AND v.date BETWEEN ck.ad - 365 AND ck.ad GROUP BY 1, 2)""",
    "dv AS (SELECT ck.*, coalesce(dz.ds, 0.0::DOUBLE) AS ds FROM ck LEFT JOIN dz USING (ticker, ad) WHERE ex IS NOT NULL)",
    """sc0 AS (SELECT ticker, ad, fri, td, ex, td / 365.25::DOUBLE AS t, 'split_adj' AS sc, s0a AS s, sta AS se, ds FROM dv UNION ALL SELECT ticker, ad, fri, td, ex, td / 365.25::DOUBLE, 'raw', s0r, str, ds FROM dv)""",
    "sc1 AS (SELECT *, (ds * (365.25::DOUBLE / 365)) / s AS q FROM sc0)",
    "sc2 AS (SELECT *, s * exp((0.03::DOUBLE - q) * t) AS fw FROM sc1)",
    """q0 AS (SELECT c.*, f.strike, (f.bid + f.ask) * 0.5::DOUBLE AS mid, f.ask - f.bid AS sp, f.close, f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_extendedprice FROM sc2 c JOIN fq f ON f.ticker = c.ticker AND f.ad = c.ad AND f.ex = c.ex)""",
    f"q1 AS (SELECT *, count(*) OVER ({CH}) AS nm FROM q0)",
    "q2 AS (SELECT *, CASE WHEN nm >= 10 THEN mid ELSE close END AS px, CASE WHEN nm >= 10 THEN mid > 0 AND sp / mid <= 2 ELSE close > 0 END AS ok FROM q1)",
    "q3 AS (SELECT * FROM q2 WHERE ok AND px >= 0.98::DOUBLE * greatest(s * exp(-q * t) - strike * exp(-0.03::DOUBLE * t), 0.0) AND px <= 1.5::DOUBLE * s)",
    "u0 AS (SELECT * FROM q3 QUALIFY row_number() OVER (PARTITION BY ticker, ad, fri, sc, strike ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1)",
    f"u1 AS (SELECT *, count(*) OVER ({CH}) AS nu, min(strike) OVER ({CH}) AS kmin, max(strike) OVER ({CH}) AS kmax, abs(ln(strike / fw)) AS dd FROM u0 QUALIFY count(*) OVER ({CH}) >= 5)",
    f"u2 AS (SELECT *, max(px) OVER ({CH} ORDER BY strike DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cm, strike > kmin AND strike < kmax AS inn FROM u1)",
    f"u3 AS (SELECT *, quantile_cont(cm, 0.5) OVER ({CH} ORDER BY strike ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS cs FROM u2)",
    "b0 AS (SELECT ticker, ad, fri, sc, max(nu) AS nu, "
    + ", ".join(f"count_if(dd <= {w!r}::DOUBLE AND inn) AS n{i}" for i, w in enumerate(C.band_widths(C.CurveRules())))
    + " FROM u3 GROUP BY 1, 2, 3, 4)",
    "b1 AS (SELECT *, "
    + "CASE " + " ".join(f"WHEN n{i} >= 5 THEN n{i}" for i in range(5)) + " ELSE n4 END AS nin, "
    + "CASE " + " ".join(f"WHEN n{i} >= 5 THEN {w!r}::DOUBLE" for i, w in enumerate(C.band_widths(C.CurveRules()))) + " ELSE 0.1::DOUBLE END AS used FROM b0)",
    "b2 AS (SELECT * FROM b1 QUALIFY row_number() OVER (PARTITION BY ticker, ad, fri ORDER BY CASE WHEN nin >= 5 THEN 1000000 ELSE 0 END + nin DESC, nu DESC, sc = 'split_adj' DESC) = 1)",
    "v0 AS (SELECT u3.*, b2.used FROM u3 JOIN b2 USING (ticker, ad, fri, sc) WHERE nin >= 5)",
    """v1 AS (SELECT *, (strike + lag(strike) OVER w) * 0.5::DOUBLE AS km, least(greatest(-exp(0.03::DOUBLE * t) * ((cs - lag(cs) OVER w) / (strike - lag(strike) OVER w)), 0.0), 1.0) AS p, row_number() OVER w - 1 AS i
   FROM v0 WINDOW w AS (PARTITION BY ticker, ad, fri ORDER BY strike))""",
    "v2 AS (SELECT ticker, ad, fri, i, km, p, sum(p) OVER (PARTITION BY ticker, ad, fri ORDER BY i) AS s FROM v1 WHERE i >= 1)",
    "v3 AS (SELECT a.ticker, a.ad, a.fri, a.i AS a, b.i AS b, (b.s - a.s + a.p) / (b.i - a.i + 1) AS m FROM v2 a JOIN v2 b ON a.ticker = b.ticker AND a.ad = b.ad AND a.fri = b.fri AND a.i <= b.i)",
    "v4 AS (SELECT x.ticker, x.ad, x.fri, x.i, s.a, max(s.m) AS m FROM v2 x JOIN v3 s ON s.ticker = x.ticker AND s.ad = x.ad AND s.fri = x.fri AND s.a <= x.i AND s.b >= x.i GROUP BY 1, 2, 3, 4, 5)",
    "v5 AS (SELECT v2.*, z.m AS iso FROM v2 JOIN (SELECT ticker, ad, fri, i, min(m) AS m FROM v4 GROUP BY 1, 2, 3, 4) z USING (ticker, ad, fri, i))",
    """t0 AS (SELECT t.ticker, t.ad, t.fri, t.strike, max_by(struct_pack(x := k.km, a := k.p, b := k.iso), k.km) FILTER (WHERE k.km <= t.strike) AS l, min_by(struct_pack(x := k.km, a := k.p, b := k.iso), k.km) FILTER (WHERE k.km > t.strike) AS r
   FROM v0 t JOIN v5 k ON t.ticker = k.ticker AND t.ad = k.ad AND t.fri = k.fri WHERE t.inn AND t.dd <= t.used GROUP BY 1, 2, 3, 4)""",
    """t1 AS (SELECT *, round_even(CASE WHEN l IS NULL THEN r.b WHEN r IS NULL THEN l.b ELSE (r.b - l.b) / (r.x - l.x) * (strike - l.x) + l.b END, 7) AS prn,
   CASE WHEN l IS NULL THEN r.a WHEN r IS NULL THEN l.a ELSE (r.a - l.a) / (r.x - l.x) * (strike - l.x) + l.a END AS praw FROM t0)""",
    "t2 AS (SELECT *, count(*) OVER (PARTITION BY ticker, ad, fri) AS nk FROM t1 WHERE prn BETWEEN 0.10 AND 0.90)",
    """o0 AS (SELECT j.*, t.strike, t.prn, t.praw, v.sc, v.s, v.se, v.fw, v.q, v.nu, v.ex, v.used FROM t2 t JOIN v0 v ON v.ticker = t.ticker AND v.ad = t.ad AND v.fri = t.fri AND v.strike = t.strike JOIN j3 j ON j.ticker = t.ticker AND j.ad = t.ad AND j.fri = t.fri WHERE nk >= 3)""",
    "o1 AS (SELECT *, row_number() OVER (PARTITION BY ticker, ad, ex, strike ORDER BY date_diff('day', tgt, ad), date_diff('day', ed, fri), tgt) AS rn FROM o0)",
)
ROW_ID = "substr(sha1(concat_ws('|', strftime(ad, '%Y-%m-%dT00:00:00Z'), CAST(ticker AS VARCHAR), strftime(ex, '%Y-%m-%d'), printf('%.7f', strike), 'call')), 1, 16)"


@register(
    "option_training_rows",
    *BUILD,
    sql=f"""SELECT {ROW_ID} AS row_id, CAST(ticker AS VARCHAR) AS ticker, tgt AS asof_target, ad AS asof_date, ed AS expiry_close_date_used, CAST(ex AS DATE) AS expiry_date, td AS "T_days", sc AS spot_scale_used,
  strike AS "K", {r6('prn')} AS "pRN", {r6('round_even(praw, 7)')} AS "pRN_raw", CASE WHEN se > strike THEN 1 ELSE 0 END AS "outcome_ST_gt_K", {r6('round_even(ln(strike / fw), 9)')} AS log_m_fwd, {r6('round_even(q, 8)')} AS dividend_yield, nu AS n_chain_used,
  {r6('used')} AS used_max_abs_logm FROM o1 WHERE rn = 1""",
)
def option_training_rows(spark, d):
    rows, _ = build(spark, d)
    six = ("pRN", "pRN_raw", "log_m_fwd", "dividend_yield", "used_max_abs_logm")
    return rows.select(
        "row_id", "ticker", "asof_target", "asof_date", "expiry_close_date_used", "expiry_date", "T_days", "spot_scale_used", "K", "outcome_ST_gt_K",
        "n_chain_used", *[r(F.col(c), 6).alias(c) for c in six],
    )


@register(
    "option_build_drop_reasons",
    *BUILD,
    "done AS (SELECT DISTINCT ticker, ad, fri FROM t2 WHERE nk >= 3)",
    """dr AS (SELECT CASE WHEN j.ad IS NULL THEN 'missing_S0' WHEN j.ed IS NULL THEN 'missing_ST' WHEN j.fri <= j.ad THEN 'bad_T_days' WHEN ck.ex IS NULL THEN 'empty_option_chain' WHEN done.ticker IS NULL THEN 'no_usable_probability' END AS drop_reason
   FROM j2 j LEFT JOIN ck ON ck.ticker = j.ticker AND ck.ad = j.ad AND ck.fri = j.fri LEFT JOIN done ON done.ticker = j.ticker AND done.ad = j.ad AND done.fri = j.fri)""",
    sql="SELECT drop_reason, count(*) AS dropped FROM dr WHERE drop_reason IS NOT NULL GROUP BY 1",
)
def option_build_drop_reasons(spark, d):
    _, drops = build(spark, d)
    return drops.groupBy("drop_reason").agg(F.count("*").alias("dropped"))


@register(
    "training_projections",
    *BUILD,
    sql=f"""SELECT {ROW_ID} AS row_id, CASE WHEN ex = fri THEN 'requested' ELSE 'fallback_next' END AS expiry_used_reason, concat('closes_', sc) AS "S0_close_source",
  concat_ws('|', CAST(ticker AS VARCHAR), strftime(ex, '%Y-%m-%d'), strftime(ad, '%Y-%m-%d'), 'isotonic|v1') AS curve_id, {r6('prn')} AS "pRN" FROM o1 WHERE rn = 1""",
)
def training_projections(spark, d):
    """The snapshot and benchmark projections of one build, joined again by row id."""
    rows, _ = build(spark, d)
    rows = D.training_view(rows)
    snap = D.snapshot_view(rows).select("row_id", "expiry_used_reason", "S0_close_source")
    prn = D.prn_view(rows, "isotonic", "v1", "hash").select("row_id", "curve_id", r(F.col("pRN"), 6).alias("pRN"))
    return snap.join(prn, "row_id")


@register(
    "horizon_overlay",
    LABELLED,
    """o AS (SELECT ticker, round(w + discount, 2) AS strike, asof_date, l_linenumber AS td, arg_min(p_model, (group_id, l_partkey, price)) AS p FROM labelled WHERE l_linenumber BETWEEN 1 AND 4 GROUP BY 1, 2, 3, 4)""",
    sql=f"""SELECT ticker, strike, count(*) AS points, min(asof_date) AS first_date, {r6('sum(p)')} AS total FROM o GROUP BY 1, 2""",
)
def horizon_overlay(spark, d):
    x = labelled(spark, d).select(
        "ticker", (F.col("w") + F.col("discount")).alias("K"), "asof_date", F.col("l_linenumber").alias("T_days"), F.col("p_model").alias("pRN"),
        "group_id", "l_partkey", "price",
    )
    o = O.overlay(x, ["group_id", "l_partkey", "price"])
    total = F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["pRN"])
    return o.select(
        "ticker", "strike", F.size("points").cast("bigint").alias("points"), F.col("points")[0]["asof_date"].alias("first_date"), r(total, 6).alias("total")
    )


@register(
    "probability_at_market_strikes",
    *CH_.ISOTONIC,
    "sp AS (SELECT ticker, asof_date, min(strike) AS lo, max(strike) AS hi FROM smooth GROUP BY 1, 2)",
    "tg AS (SELECT DISTINCT q.ticker, q.asof_date, q.strike + 0.25::DOUBLE AS strike FROM option_quotes q JOIN sp ON sp.ticker = q.ticker AND sp.asof_date = q.asof_date AND q.strike + 0.25::DOUBLE BETWEEN lo AND hi)",
    """br AS (SELECT t.ticker, t.asof_date, t.strike, max_by(struct_pack(x := k.k_mid, b := k.p_iso), k.k_mid) FILTER (WHERE k.k_mid <= t.strike) AS l,
   min_by(struct_pack(x := k.k_mid, b := k.p_iso), k.k_mid) FILTER (WHERE k.k_mid > t.strike) AS r
   FROM tg t JOIN knots k ON t.ticker = k.ticker AND t.asof_date = k.asof_date GROUP BY 1, 2, 3)""",
    sql=f"""SELECT ticker, asof_date, strike, {CH_.r9('CASE WHEN l IS NULL THEN r.b WHEN r IS NULL THEN l.b ELSE (r.b - l.b) / (r.x - l.x) * (strike - l.x) + l.b END')} AS "pRN" FROM br""",
)
def probability_at_market_strikes(spark, d):
    q = CH_.quotes(spark, d)
    wanted = q.select(*CH_.CHAIN, (F.col("strike") + 0.25).alias("strike"))
    out = O.probabilities_at_strikes(q, q.select(*CH_.CHAIN).distinct(), wanted, CH_.CHAIN, CH_.TIE)
    return out.select(*CH_.CHAIN, "strike", r(F.col("pRN"), 9).alias("pRN"))


# --- models ---------------------------------------------------------------------------------------


def _newton(steps: int) -> list[str]:
    """Unrolled Newton steps for a one-feature logistic fit on grouped rows g(x, n, s)."""
    out = ["n0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for i in range(steps):
        out.append(
            f"""n{i + 1} AS (SELECT a - (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b - (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM (
   SELECT any_value(a) AS a, any_value(b) AS b, sum(x * (n * p - s)) + any_value(a) * 1e-6 AS g1, sum(n * p - s) AS g2, sum(x * x * n * p * (1 - p)) + 1e-6 AS h11, sum(x * n * p * (1 - p)) AS h12, sum(n * p * (1 - p)) AS h22
   FROM (SELECT g.*, a, b, 1.0 / (1.0 + exp(-(a * x + b))) AS p FROM g, n{i})))"""
        )
    return out


@register(
    "platt_calibration",
    LABELLED,
    "g AS (SELECT ln(p_model / (1 - p_model)) AS x, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM labelled GROUP BY p_model)",
    *_newton(8),
    sql="SELECT floor(a * 10000 + 0.5) / 10000 AS slope, floor(b * 10000 + 0.5) / 10000 AS intercept FROM n8",
)
def platt_calibration(spark, d):
    from strikelake.functions.scalar import logit

    x = labelled(spark, d)
    cal = L.fit_platt(x, logit(F.col("p_model")))
    # Two fitted numbers, attached to one aggregate row of the same table.
    one = x.agg(F.count("*").alias("n")).withColumns({"slope": F.lit(cal.slope), "intercept": F.lit(cal.intercept)})
    return one.select(r(F.col("slope"), 4).alias("slope"), r(F.col("intercept"), 4).alias("intercept"))


PREP = L.Preprocessor(
    ("w", "tax"), (25.0, 0.04), (25.5, 0.04), (14.4, 0.026), ("ticker",), ("1",), (("2", "3", "4"),)
)
MODEL = L.LogitModel(PREP, -0.7, (0.05, -0.11, 0.2, -0.3, 0.4), L.Platt(0.9, 0.05))
ETA = """-0.7::DOUBLE + (coalesce(w, 25.0) - 25.5::DOUBLE) / 14.4::DOUBLE * 0.05::DOUBLE + (coalesce(tax, 0.04) - 0.04::DOUBLE) / 0.026::DOUBLE * -0.11::DOUBLE
  + CASE ticker WHEN 2 THEN 0.2::DOUBLE WHEN 3 THEN -0.3::DOUBLE WHEN 4 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"""
SCORED = (
    LABELLED,
    f"sc AS (SELECT *, {ETA} AS eta FROM labelled)",
    "pr AS (SELECT *, 1.0 / (1.0 + exp(-(eta * 0.9::DOUBLE + 0.05::DOUBLE))) AS phat FROM sc)",
)


@register(
    "model_scoring",
    *SCORED,
    sql=f"""SELECT group_id, l_linenumber, l_partkey, price, {r6('phat')} AS "pHAT", {r6('CASE WHEN discount > 0.05 THEN p_model ELSE phat END')} AS p_final,
  CASE WHEN discount > 0.05 THEN 'stage_b' ELSE 'stage_a' END AS stage_used FROM pr""",
)
def model_scoring(spark, d):
    x = labelled(spark, d)
    signal = F.when(F.col("discount") > 0.05, F.col("discount"))
    base, final, stage = L.two_stage(MODEL.probability(), F.col("p_model"), signal)
    return x.select(
        "group_id", "l_linenumber", "l_partkey", "price", r(base, 6).alias("pHAT"), r(final, 6).alias("p_final"), stage.alias("stage_used")
    )


@register(
    "ticker_scoping_and_offset_stage",
    LABELLED,
    """t AS (SELECT *, CASE WHEN ticker IN (1, 2) THEN 'FOUNDATION' WHEN ticker IN (5, 6) THEN CAST(ticker AS VARCHAR) ELSE 'OTHER' END AS tf,
   ln(p_model / (1 - p_model)) + CASE WHEN ticker IN (1, 2) THEN 0.0 ELSE tax * 3.0 END AS eta FROM labelled)""",
    sql=f"SELECT tf AS ticker_level, count(*) AS n, {r6('avg(1.0 / (1.0 + exp(-eta)))')} AS p FROM t GROUP BY 1",
)
def ticker_scoping_and_offset_stage(spark, d):
    x = labelled(spark, d)
    level = L.ticker_feature("non_foundation", ["1", "2"], ["FOUNDATION", "5", "6"])
    p = L.offset_stage(F.col("p_model"), F.col("tax") * 3.0, F.col("ticker").isin(1, 2))
    return x.select(level.alias("ticker_level"), p.alias("p")).groupBy("ticker_level").agg(F.count("*").alias("n"), r(F.avg("p"), 6).alias("p"))


@register(
    "mixed_model_blend",
    LABELLED,
    "m AS (SELECT *, p_base AS pm, p_model AS prn, least(greatest(tax * 20 - 0.4::DOUBLE, 0.0), 1.0) AS wgt FROM labelled)",
    sql=f"""SELECT group_id, l_linenumber, l_partkey, price, {r6('least(greatest(pm + (tax - 0.04::DOUBLE) * 10, 0.0), 1.0)')} AS residual, {r6('least(greatest(wgt * prn + (1.0 - wgt) * pm, 0.0), 1.0)')} AS blend,
  {r6('least(greatest(CASE WHEN abs(prn - pm) < 1e-6 THEN 0.5 ELSE (y - pm) / (prn - pm) END, 0.0), 1.0)')} AS blend_target FROM m""",
)
def mixed_model_blend(spark, d):
    x = labelled(spark, d)
    pm, prn = F.col("p_base"), F.col("p_model")
    return x.select(
        "group_id", "l_linenumber", "l_partkey", "price", r(X.combine("residual", (F.col("tax") - 0.04) * 10, pm, prn), 6).alias("residual"),
        r(X.combine("blend", F.col("tax") * 20 - 0.4, pm, prn), 6).alias("blend"), r(X.target("blend", F.col("y"), pm, prn), 6).alias("blend_target"),
    )


EDGE = (
    *SCORED,
    "pp AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE p_base END AS yb, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 1.02::DOUBLE - p_base END AS nb, p_model BETWEEN 0.15 AND 0.8 AS ins FROM pr)",
    "ed AS (SELECT *, CASE WHEN ins THEN phat - yb END AS ye, CASE WHEN ins THEN (1.0 - phat) - nb END AS ne FROM pp)",
    """fe AS (SELECT *, CASE WHEN ye IS NOT NULL AND (ne IS NULL OR ye >= ne) THEN ye ELSE ne END AS edge, CASE WHEN NOT ins THEN 'pRN_out_of_range' WHEN ye IS NOT NULL AND (ne IS NULL OR ye >= ne) THEN 'yes contract' WHEN ne IS NOT NULL THEN 'no contract' END AS src FROM ed)""",
)


def edges(spark, d):
    x = labelled(spark, d)
    n = F.col("l_linenumber")
    x = x.withColumns(
        {
            "pHAT": MODEL.probability(), "pPM_buy": F.when(n % 3 == 0, None).otherwise(F.col("p_base")),
            "qPM_buy": F.when(n % 4 == 0, None).otherwise(F.lit(1.02) - F.col("p_base")), "pRN": F.col("p_model"),
        }
    )
    return S.with_edge(x, prn_range=S.training_range({"prn_train_range": [0.15, 0.8]}))


@register(
    "model_market_edge",
    *EDGE,
    sql=f"SELECT group_id, l_linenumber, l_partkey, price, {r6('edge')} AS edge, src AS edge_source FROM fe",
)
def model_market_edge(spark, d):
    return edges(spark, d).select("group_id", "l_linenumber", "l_partkey", "price", r(F.col("edge"), 6).alias("edge"), "edge_source")


@register(
    "top_edges",
    *EDGE,
    sql=f"""SELECT group_id, l_linenumber, l_partkey, {r6('edge')} AS edge FROM fe WHERE edge IS NOT NULL AND ticker NOT IN (3, 4)
  ORDER BY edge DESC, group_id, l_linenumber, l_partkey, price LIMIT 25""",
)
def top_edges(spark, d):
    out = S.top_edges(edges(spark, d), 25, ["3", "4"], ["group_id", "l_linenumber", "l_partkey", "price"])
    return out.select("group_id", "l_linenumber", "l_partkey", r(F.col("edge"), 6).alias("edge"))


@register(
    "probability_distribution",
    *SCORED,
    sql=f"SELECT count(*) AS count, {r6('avg(phat)')} AS mean, {r6('min(phat)')} AS min, {r6('max(phat)')} AS max FROM pr",
)
def probability_distribution(spark, d):
    s = S.probability_summary(labelled(spark, d).select(MODEL.probability().alias("pHAT")))
    return s.select("count", *[r(F.col(c), 6).alias(c) for c in ("mean", "min", "max")])


@register(
    "split_verdicts",
    LABELLED,
    """m AS (SELECT CAST(extract(year FROM asof_date) AS VARCHAR) AS split, avg(-(CASE WHEN y = 1 THEN ln(p_base) ELSE ln(1 - p_base) END)) AS lb, avg(-(CASE WHEN y = 1 THEN ln(p_model) ELSE ln(1 - p_model) END)) AS lm,
   avg((p_base - y) * (p_base - y)) AS bb, avg((p_model - y) * (p_model - y)) AS bm FROM labelled GROUP BY 1)""",
    sql=f"SELECT split, {r6('lb')} AS baseline_logloss, {r6('lm')} AS model_logloss, {r6('lm - lb')} AS delta_logloss, {r6('bm - bb')} AS delta_brier, CASE WHEN lm - lb < 0 THEN 'good' ELSE 'unusable' END AS status FROM m",
)
def split_verdicts(spark, d):
    from strikelake.operators import metrics as M

    x = labelled(spark, d).withColumn("split", F.year("asof_date").cast("string"))
    m = M.point_metrics(M.stack_models(x, ["split"], "y", "p_model", "p_base"), ["split", "model"], "y", "p").drop("mae", "rmse")
    v = S.verdicts(m)
    return v.select("split", *[r(F.col(c), 6).alias(c) for c in ("baseline_logloss", "model_logloss", "delta_logloss", "delta_brier")], "status")


TRIALS = (
    LABELLED,
    """dl AS (SELECT CAST(ticker AS INT) AS trial_id, extract(year FROM asof_date) AS fold, avg((p_model - y) * (p_model - y)) - avg((p_base - y) * (p_base - y)) AS delta FROM labelled GROUP BY 1, 2)""",
    """fs AS (SELECT trial_id, count(*) AS n, avg(delta) AS mean_delta, median(delta) AS med, coalesce(stddev_samp(delta), 0) / sqrt(count(*)) AS se, count_if(delta < 0) AS imp, max(delta) AS worst FROM dl GROUP BY 1)""",
    "ac AS (SELECT *, med > 0.06 AS g1, imp < ceil(0.1::DOUBLE * n) AS g2, worst > 0.2 AS g3 FROM fs)",
)


def trials(spark, d):
    from strikelake.catalog.validation import fold_deltas

    stats = Q.fold_statistics(fold_deltas(spark, d), delta="delta").withColumn("score", F.col("median_delta"))
    return S.acceptance(stats, delta_limit=0.06, min_improved=0.1, worst_cap=0.2)


@register(
    "acceptance_gates",
    *TRIALS,
    sql="""SELECT trial_id, concat_ws(',', CASE WHEN g1 THEN 'central_delta_above_limit' END, CASE WHEN g2 THEN 'too_few_folds_improved' END, CASE WHEN g3 THEN 'worst_delta_above_cap' END) AS rejected_because FROM ac""",
)
def acceptance_gates(spark, d):
    return trials(spark, d).select("trial_id", F.array_join("rejected_because", ",").alias("rejected_because"))


@register(
    "simplest_trial_within_margin",
    *TRIALS,
    "ok AS (SELECT * FROM ac WHERE NOT g1 AND NOT g2 AND NOT g3 AND (SELECT min(med) FROM fs) <= 0.05)",
    "b AS (SELECT min(med) AS m FROM ok)",
    sql="SELECT trial_id FROM ok, b WHERE med <= m + 0.05 ORDER BY trial_id % 7, trial_id LIMIT 1",
)
def simplest_trial_within_margin(spark, d):
    return S.choose_trial(trials(spark, d), [F.col("trial_id") % 7], epsilon=0.05).select("trial_id")


@register(
    "trial_leaderboard",
    *TRIALS,
    sql=f"SELECT trial_id, {r6('med')} AS score, {r6('mean_delta')} AS mean_delta FROM fs ORDER BY med NULLS LAST, mean_delta NULLS LAST, trial_id",
)
def trial_leaderboard(spark, d):
    out = S.leaderboard(trials(spark, d))
    return out.select("trial_id", r(F.col("score"), 6).alias("score"), r(F.col("mean_delta"), 6).alias("mean_delta"))


@register(
    "one_standard_error_rule",
    LABELLED,
    """s AS (SELECT (1 + ticker % 5) / 10.0::DOUBLE AS c, extract(year FROM asof_date) AS fold, avg((p_model - y) * (p_model - y)) AS score FROM labelled GROUP BY 1, 2)""",
    "p AS (SELECT c, avg(score) AS m, coalesce(stddev_samp(score), 0) / sqrt(count(*)) AS se FROM s GROUP BY 1)",
    "b AS (SELECT m + se + 1e-12 AS lim FROM p ORDER BY m, c LIMIT 1)",
    sql=f"""SELECT min(c) AS "C", {r6('arg_min(m, c)')} AS mean_score, count(*) AS eligible FROM p, b WHERE m <= lim""",
)
def one_standard_error_rule(spark, d):
    sq = (F.col("p_model") - F.col("y")) * (F.col("p_model") - F.col("y"))
    s = labelled(spark, d).groupBy(((F.col("ticker") % 5 + 1) / 10.0).alias("C"), F.year("asof_date").alias("fold")).agg(F.avg(sq).alias("score"))
    out = L.one_standard_error(s)
    return out.select("C", r(F.col("mean_score"), 6).alias("mean_score"), "eligible")


@register("logistic_fit_scores")
def logistic_fit_scores(spark, d):
    """Rows-only: an L2 fit with imputation, scaling and one-hot status, scored per priority."""
    o = load(spark, d, "orders").select(
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("y"), F.col("o_totalprice").alias("price"),
        F.dayofmonth("o_orderdate").alias("dom"), F.col("o_orderstatus").alias("status"), "o_custkey",
    )
    model = L.fit_logit(o, ["price", "dom"], ["status"], c=0.5)
    return o.select("status", model.probability().alias("p")).groupBy("status").agg(F.count("*").alias("n"), F.avg("p").alias("p"))


@register("embedding_logistic_scores")
def embedding_logistic_scores(spark, d):
    """Rows-only: the same fit on a 64-column design matrix."""
    e = load(spark, d, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)]
    x = e.select("vec_id", (F.col("label") == 0).cast("int").alias("y"), *cols)
    model = L.fit_logit(x, [f"e{i}" for i in range(64)], c=0.1)
    return x.select("vec_id", model.probability().alias("p"))


def solve3(a, g):
    """SQL of the three unknowns of a symmetric 3 x 3 system: a = (a11, a12, a13, a22, a23, a33), by Cramer's rule."""
    a11, a12, a13, a22, a23, a33 = a
    g1, g2, g3 = g
    det = f"({a11} * ({a22} * {a33} - {a23} * {a23}) - {a12} * ({a12} * {a33} - {a23} * {a13}) + {a13} * ({a12} * {a23} - {a22} * {a13}))"
    return (
        f"({g1} * ({a22} * {a33} - {a23} * {a23}) - {a12} * ({g2} * {a33} - {a23} * {g3}) + {a13} * ({g2} * {a23} - {a22} * {g3})) / {det}",
        f"({a11} * ({g2} * {a33} - {a23} * {g3}) - {g1} * ({a12} * {a33} - {a23} * {a13}) + {a13} * ({a12} * {g3} - {g2} * {a13})) / {det}",
        f"({a11} * ({a22} * {g3} - {g2} * {a23}) - {a12} * ({a12} * {g3} - {g2} * {a13}) + {g1} * ({a12} * {a23} - {a22} * {a13})) / {det}",
    )


MOMENTS = ("a11", "a12", "a13", "a22", "a23", "a33"), ("g1", "g2", "g3")
STEP = solve3(*MOMENTS)


@register(
    "ridge_residual_scores",
    LABELLED,
    "rx AS (SELECT y, p_base, w::DOUBLE AS x1, tax::DOUBLE AS x2, p_model AS x3, y - p_base AS t FROM labelled)",
    "rm AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(t) AS mt FROM rx)",
    """rs AS (SELECT sum((x1 - m1) * (x1 - m1)) + 10 AS a11, sum((x1 - m1) * (x2 - m2)) AS a12, sum((x1 - m1) * (x3 - m3)) AS a13, sum((x2 - m2) * (x2 - m2)) + 10 AS a22, sum((x2 - m2) * (x3 - m3)) AS a23,
   sum((x3 - m3) * (x3 - m3)) + 10 AS a33, sum((x1 - m1) * (t - mt)) AS g1, sum((x2 - m2) * (t - mt)) AS g2, sum((x3 - m3) * (t - mt)) AS g3 FROM rx, rm)""",
    f"rb AS (SELECT {STEP[0]} AS b1, {STEP[1]} AS b2, {STEP[2]} AS b3 FROM rs)",
    sql=f"""SELECT y, count(*) AS n, {r6('avg(least(greatest(p_base + mt + b1 * (x1 - m1) + b2 * (x2 - m2) + b3 * (x3 - m3), 0), 1))')} AS p FROM rx, rm, rb GROUP BY 1""",
)
def ridge_residual_scores(spark, d):
    """Ridge on the market residual over whole-table features."""
    x = labelled(spark, d).select("group_id", F.col("y").alias("label"), F.col("p_base").alias("pm_mid"), F.col("p_model").alias("pRN"), "w", "tax")
    rows = X.prepare(x, "residual")
    model = X.fit_mixed(rows, ["w", "tax", "pRN"], "residual", alpha=10.0)
    return rows.select(F.col("label").alias("y"), model.probability().alias("p")).groupBy("y").agg(F.count("*").alias("n"), r(F.avg("p"), 6).alias("p"))


@register(
    "offset_logistic_fit",
    LABELLED,
    "oc AS (SELECT w::DOUBLE / 50.0::DOUBLE AS x1, tax::DOUBLE * 10.0::DOUBLE AS x2, y, ln(p_base / (1.0::DOUBLE - p_base)) AS o, count(*)::DOUBLE AS n FROM labelled GROUP BY ALL)",
    f"""oe AS (WITH RECURSIVE e AS (SELECT 0 AS step, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b3
   UNION ALL SELECT step + 1, b1 - {STEP[0]}, b2 - {STEP[1]}, b3 - {STEP[2]} FROM (
     SELECT any_value(step) AS step, any_value(b1) AS b1, any_value(b2) AS b2, any_value(b3) AS b3, sum(h) AS a11, sum(h * x1) AS a12, sum(h * x2) AS a13, sum(h * x1 * x1) + 1 AS a22,
       sum(h * x1 * x2) AS a23, sum(h * x2 * x2) + 1 AS a33, sum(q) AS g1, sum(q * x1) + any_value(b2) AS g2, sum(q * x2) + any_value(b3) AS g3
     FROM (SELECT step, b1, b2, b3, x1, x2, n * p * (1 - p) AS h, n * (p - y) AS q
       FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(b1 + b2 * x1 + b3 * x2 + o))) AS p FROM e, oc WHERE step < 20)) GROUP BY step))
   SELECT * FROM e WHERE step = 20)""",
    sql=f"SELECT y, sum(n)::BIGINT AS n, {r6('sum(n * (o + b1 + b2 * x1 + b3 * x2)) / sum(n)')} AS eta FROM oc, oe GROUP BY 1",
)
def offset_logistic_fit(spark, d):
    """Newton fit with the baseline logit as a fixed offset."""
    from strikelake.functions.scalar import logit

    x = labelled(spark, d)
    b0, beta = L.fit_offset(x, [F.col("w") / 50.0, F.col("tax") * 10.0], "y", logit(F.col("p_base")), c=1.0)
    eta = logit(F.col("p_base")) + F.lit(b0) + F.col("w") / 50.0 * float(beta[0]) + F.col("tax") * 10.0 * float(beta[1])
    return x.select("y", eta.alias("eta")).groupBy("y").agg(F.count("*").alias("n"), r(F.avg("eta"), 6).alias("eta"))


@register("snapshot_probability_table")
def snapshot_probability_table(spark, d):
    """Rows-only: the whole snapshot path; its steps have oracles of their own."""
    from strikelake.catalog import chains as CH_
    from strikelake.plans.snapshot import snapshot_probabilities

    q = CH_.quotes(spark, d)
    targets = q.select(
        *CH_.CHAIN, (F.col("strike") + 0.5).alias("K"), F.lit(100.0).alias("spot"), F.lit(CH_.T_YEARS).alias("t_years"), F.lit(CH_.RATE).alias("rate"),
        F.when(F.col("ticker") % 2 == 0, 0.35).alias("atm_sigma"),
    ).distinct()
    out = snapshot_probabilities(targets, q, CH_.CHAIN, CH_.TIE)
    return out.select(*CH_.CHAIN, "K", "pRN_raw", "pRN", "rn_method", "rn_monotone_adjusted")
