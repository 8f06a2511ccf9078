"""Row, contract, chain and cluster identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _txt(c: Column, missing: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(missing))


def row_id(asof_ts: Column, ticker: Column, expiry: Column, strike: Column, option_type: Column) -> Column:
    payload = F.concat_ws("|", asof_ts, ticker, expiry, F.format_string("%.7f", strike), option_type)
    return F.substring(F.sha1(payload), 1, 16)


def strike_text(strike: Column) -> Column:
    return F.when(strike.isNull(), F.lit("NA")).otherwise(F.format_string("%.7f", strike))


def cluster_week(ticker: Column, expiry: Column) -> Column:
    return F.concat_ws("|", F.upper(_txt(ticker, "UNKNOWN")), _txt(expiry, "NA"))


def cluster_snapshot(ticker: Column, expiry: Column, snapshot: Column, dow: Column) -> Column:
    return F.concat_ws("|", cluster_week(ticker, expiry), _txt(snapshot, "NA"), _txt(dow, "NA"))


def cluster_strike(ticker: Column, expiry: Column, strike: Column) -> Column:
    return F.concat_ws("|", cluster_week(ticker, expiry), strike_text(strike))


def contract_id(ticker: Column, expiry: Column, strike: Column) -> Column:
    k = F.coalesce(F.round(strike, 8).cast("string"), F.lit("NaN"))
    return F.concat_ws("|", F.upper(_txt(ticker, "UNKNOWN")), _txt(expiry, "NaT"), k)


def chain_id(columns: list[str]) -> Column | None:
    """ticker|asof|expiry, else ticker|week|T<days>, else None when neither can be built."""
    have = set(columns)
    if {"ticker", "asof_date", "expiry_date"} <= have:
        return F.concat_ws(
            "|", _txt(F.col("ticker"), "UNKNOWN"), _txt(F.col("asof_date"), "NaT"), _txt(F.col("expiry_date"), "NaT")
        )
    if {"ticker", "week_friday", "T_days"} <= have:
        days = F.concat(F.lit("T"), F.coalesce(F.col("T_days").cast("int"), F.lit(-1)).cast("string"))
        return F.concat_ws("|", _txt(F.col("ticker"), "UNKNOWN"), _txt(F.col("week_friday"), "NaT"), days)
    return None
