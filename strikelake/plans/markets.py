"""The contract dimension from landed markets, and its weekly variant from nested events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strikelake.functions import calendar, text
from strikelake.functions.scalar import string_list
from strikelake.operators.relational import apply_overrides

# Column order of the dimension.
DIM_COLUMNS = (
    "market_id", "condition_id", "question", "ticker", "threshold", "expiry_date_utc", "resolution_time_utc",
    "outcome_yes_token_id", "outcome_no_token_id", "slug", "source", "mapping_confidence",
)


def _day_end(d):
    return F.timestamp_micros(F.unix_micros(d.cast("timestamp")) + 86_399_000_000)


def dim_market_from_titles(
    markets: DataFrame, allowlist: Sequence[str] | None = None, overrides: DataFrame | None = None
) -> DataFrame:
    """markets(market_id, condition_id, question, slug, resolved_time, token_ids) to the contract dimension."""
    q, s = F.col("question"), F.col("slug")
    ticker, source = text.infer_ticker(q, s, allowlist)
    parsed = markets.withColumns(
        {
            "ticker": ticker, "ticker_source": source, "threshold": text.threshold(q),
            "expiry_date": F.coalesce(text.question_date(q), text.slug_date(s)),
            "_tokens": string_list(F.col("token_ids")), "is_weekly": text.is_weekly(q, s),
        }
    )
    out = parsed.withColumns(
        {
            "expiry_date_utc": F.col("expiry_date").cast("timestamp"),
            "resolution_time_utc": F.coalesce(text.resolved_time(F.col("resolved_time")), _day_end(F.col("expiry_date"))),
            "outcome_yes_token_id": F.nullif(F.try_element_at("_tokens", F.lit(1)), F.lit("")),
            "outcome_no_token_id": F.nullif(F.try_element_at("_tokens", F.lit(2)), F.lit("")),
            "source": F.lit("auto"),
            "mapping_confidence": text.confidence(F.col("ticker"), F.col("threshold"), F.col("expiry_date")),
        }
    ).drop("_tokens")
    return apply_overrides(out, overrides) if overrides is not None else out


def strict_dimension(dim: DataFrame, allowlist: Sequence[str] | None = None) -> DataFrame:
    """Spec columns only; a row without ticker or threshold fails the job."""
    if allowlist:
        dim = dim.where(F.col("ticker").isin([t.upper() for t in allowlist]))
    whole = F.col("ticker").isNotNull() & F.col("threshold").isNotNull()
    checked = F.when(whole, F.col("ticker")).otherwise(
        F.raise_error(F.concat(F.lit("cannot map market "), F.col("market_id").cast("string")))
    )
    return dim.withColumn("ticker", checked).select(*DIM_COLUMNS)


def weekly_markets(events: DataFrame, allowlist: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Markets of landed events (id, slug, title, endDate, markets array) that are weekly closes of known tickers."""
    m = events.select(
        F.col("id").alias("event_id"), F.col("slug").alias("event_slug"), F.col("title").alias("event_title"),
        F.to_date("endDate").alias("_event_end"), F.explode("markets").alias("m"),
    )
    q = F.coalesce(F.nullif(F.trim("m.question"), F.lit("")), F.col("event_title"))
    m = m.select("*", q.alias("market_question"), F.trim("m.slug").alias("market_slug"))
    q, s = F.col("market_question"), F.col("market_slug")
    ticker, source = text.infer_ticker(q, s, allowlist)
    end_day = F.coalesce(F.to_date("m.endDate"), F.col("_event_end"), text.question_date(q), text.slug_date(s))
    m = m.where(text.is_weekly(q, s)).withColumns(
        {"ticker": ticker, "ticker_source": source, "threshold": text.threshold(q), "event_end_date": end_day, "_t": string_list(F.col("m.clobTokenIds"))}
    )
    m = m.where(F.col("ticker").isin([a.upper() for a in allowlist]) & F.col("threshold").isNotNull() & F.col("event_end_date").isNotNull())
    if start:
        m = m.where(F.col("event_end_date") >= F.lit(start).cast("date"))
    if end:
        m = m.where(F.col("event_end_date") <= F.lit(end).cast("date"))
    friday = calendar.display_friday(F.col("event_end_date"))
    return m.select(
        "event_id", "event_slug", "event_title", "event_end_date", F.col("m.id").alias("market_id"), F.col("m.conditionId").alias("condition_id"),
        "market_slug", "market_question", "ticker", "ticker_source", "threshold", F.date_sub(friday, 4).alias("week_monday"),
        friday.alias("week_friday"), F.date_add(friday, 2).alias("week_sunday"), F.col("event_end_date").cast("timestamp").alias("expiry_date_utc"),
        _day_end(F.col("event_end_date")).alias("resolution_time_utc"), F.try_element_at("_t", F.lit(1)).alias("yes_token_id"),
        F.try_element_at("_t", F.lit(2)).alias("no_token_id"),
    )


def dimension_from_weekly(weekly: DataFrame) -> DataFrame:
    """The weekly table in dimension form: renamed, constant source and confidence, fixed order."""
    named = weekly.withColumnsRenamed(
        {"market_question": "question", "market_slug": "slug", "yes_token_id": "outcome_yes_token_id", "no_token_id": "outcome_no_token_id"}
    )
    return named.withColumns({"source": F.lit("gamma"), "mapping_confidence": F.lit(1.0)}).select(*DIM_COLUMNS, "ticker_source")
