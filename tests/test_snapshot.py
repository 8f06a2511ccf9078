"""Snapshot targets without a usable chain come back with their reason."""

from strikelake.plans.snapshot import snapshot_probabilities

CHAIN = ["ticker", "day"]


def calls(ticker, strikes, price=lambda k: max(100.0 - k, 0.0) + 3.0):
    return [(ticker, 1, k, None, None, None if k is None else price(k), i, 100.0, 0.1, 0.0, 0.0) for i, k in enumerate(strikes)]


def test_every_target_comes_back_labelled(spark):
    quotes = [
        *calls("full", [80.0, 90.0, 100.0, 110.0, 120.0]), *calls("one", [100.0]), *calls("two", [95.0, 105.0]), *calls("empty", [None]),
        *calls("clipped", [40.0, 50.0, 60.0], lambda k: 1.0), *calls("left2", [40.0, 95.0, 105.0], lambda k: 6.0),
    ]
    q = spark.createDataFrame(
        quotes, "ticker string, day int, strike double, bid double, ask double, close double, tie int, spot double, t_years double, rate double, div_yield double"
    )
    names = ["full", "one", "two", "empty", "clipped", "left2", "absent", None]
    made = [(n, 1, k, 100.0, 0.1, 0.0, 0.3) for n in names for k in (94.0, 100.0, 100.0)]  # repeated targets stay, too
    targets = spark.createDataFrame(made, "ticker string, day int, K double, spot double, t_years double, rate double, atm_sigma double")
    for monotone in (True, False):
        out = snapshot_probabilities(targets, q, CHAIN, ["tie"], monotone=monotone).collect()
        assert len(out) == len(made)
        missing = {r.ticker: (r.rn_method, r.n_calls_used) for r in out if r.ticker != "full"}
        assert missing == {
            "one": ("too_few_calls", 1), "two": ("too_few_calls", 2), "empty": ("empty_calls", 0), "clipped": ("arb_drop_all", 0),
            "left2": ("arb_drop_all", 2), "absent": ("no_chain", 0), None: ("no_chain", 0),
        }
        assert all((r.pRN is None and r.pRN_raw is None and not r.rn_monotone_adjusted) == (r.ticker != "full") for r in out)
