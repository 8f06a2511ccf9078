"""Trading-calendar functions. The three Friday rules differ on weekends; keep them apart."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def week_monday(d: Column) -> Column:
    return F.date_sub(d, F.weekday(d))


def iso_week_friday(d: Column) -> Column:
    """Friday of the ISO week that holds the date (weekend looks back)."""
    return F.date_add(week_monday(d), 4)


def next_friday(d: Column) -> Column:
    """The date itself on Friday, otherwise the coming Friday (weekend looks ahead)."""
    return F.date_add(d, F.pmod(F.lit(4) - F.weekday(d), F.lit(7)))


def display_friday(d: Column) -> Column:
    """Saturday and Sunday belong to the Friday just past."""
    return F.date_add(d, F.lit(4) - F.weekday(d))


def week_sunday(friday: Column) -> Column:
    return F.date_add(friday, 2)


def close_time_utc(d: Column, zone: str = "America/New_York", close_time: str = "16:00:00") -> Column:
    local = F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(f" {close_time}")).try_cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local).cast("timestamp")


def local_time(ts: Column, zone: str = "America/New_York") -> Column:
    return F.from_utc_timestamp(ts, zone)


def asof_time(df: DataFrame, ts: str, zone: str = "America/New_York", close_time: str = "16:00:00") -> DataFrame:
    """If every value of the column is midnight the column holds dates: use the close of that day."""
    has_clock = df.agg(F.max(F.date_trunc("day", ts) != F.col(ts)).alias("_clock"))
    closed = close_time_utc(F.to_date(ts), zone, close_time)
    return (
        df.crossJoin(F.broadcast(has_clock))
        .withColumn("asof_time", F.when(F.coalesce("_clock", F.lit(False)), F.col(ts)).otherwise(closed))
        .drop("_clock")
    )


def session_class(ts: Column, zone: str = "America/New_York") -> Column:
    local = local_time(ts, zone)
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    exact_close = (seconds == 57_600) & (F.date_trunc("second", local) == local)
    return (
        F.when(ts.isNull() | (seconds < 34_200), F.lit("PRE"))
        .when((seconds < 57_600) | exact_close, F.lit("REG"))
        .otherwise(F.lit("POST"))
    )


def last_completed_close(ts: Column, zone: str = "America/New_York", close_hour: int = 16) -> Column:
    local = local_time(ts, zone)
    today = F.to_date(local)
    day = F.when(F.hour(local) < close_hour, F.date_sub(today, 1)).otherwise(today)
    trading = F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
    return close_time_utc(trading, zone, f"{close_hour:02d}:00:00")


def refresh_cutoff(ts: Column, week_friday: Column, zone: str = "America/New_York") -> Column:
    """Last full hour; on weekends the Friday 16:00 local close."""
    weekend = F.weekday(F.to_date(local_time(ts, zone))) >= 5
    return F.date_trunc("hour", F.when(weekend, close_time_utc(week_friday, zone)).otherwise(ts))


def weekday_label(raw: Column, fallback: Column) -> Column:
    """0-6 or free text to MON..SUN; anything else is taken from the date."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    number = F.trim(raw).try_cast("double")
    # The label of a number outside 0..6 is missing; try_element_at gives NULL out of range.
    from_number = F.when((number >= 0) & (number < 7), F.try_element_at(names, number.cast("int") + 1))
    from_text = F.upper(F.substring(F.trim(raw), 1, 3))
    label = F.when(number.isNotNull(), from_number).otherwise(from_text)
    derived = F.try_element_at(names, F.weekday(fallback) + 1)
    return F.when(label.isin(*WEEKDAYS), label).otherwise(derived)


# --- schedule -----------------------------------------------------------------------------------


def parse_dte(text: str) -> list[int]:
    """'1,2,4-6' to [1, 2, 4, 5, 6]: order kept, repeats dropped, negatives refused."""
    out: dict[int, None] = {}
    for token in filter(None, (t.strip() for t in text.split(","))):
        lo, dash, hi = token.partition("-")
        if dash and not lo:
            raise ValueError(f"days to expiry must not be negative: {token}")
        first, last = int(lo), int(hi) if dash else int(lo)
        if last < first:
            raise ValueError(f"descending range: {token}")
        out.update(dict.fromkeys(range(first, last + 1)))
    return list(out)


def dte_span(least: int, most: int, step: int = 1) -> list[int]:
    """Days to expiry from `least` to `most`, both included, `step` apart."""
    if least < 0 or most < least or step < 1:
        raise ValueError(f"not a span of days to expiry: {least} to {most} by {step}")
    return list(range(least, most + 1, step))


def parse_range(text: str | None) -> tuple[date | None, date | None]:
    """'2024-01-01:2024-01-31', one side left open, or one day for both ends."""
    raw = (text or "").strip()
    if not raw:
        return None, None
    first, colon, last = (t.strip() for t in raw.partition(":"))
    start = date.fromisoformat(first) if first else None
    end = (date.fromisoformat(last) if last else None) if colon else start
    if start is None and end is None:
        raise ValueError(f"no date in {text!r}")
    if start and end and start > end:
        raise ValueError(f"range {text!r} ends before it starts")
    return start, end


def schedule(
    spark: SparkSession,
    start: date,
    end: date,
    mode: str = "weekly",
    expiry_weekdays: tuple[int, ...] = (4,),
    asof_weekdays: tuple[int, ...] = (0, 1, 2, 3),
    dte: list[int] | None = None,
) -> DataFrame:
    """(week_monday, expiry, asof, status) with status kept / after_expiry / out_of_range."""
    span = spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS d")
    return schedule_from_days(span, start, end, mode, expiry_weekdays, asof_weekdays, dte)


def schedule_from_days(
    days: DataFrame,
    start: date | Column,
    end: date | Column,
    mode: str = "weekly",
    expiry_weekdays: tuple[int, ...] = (4,),
    asof_weekdays: tuple[int, ...] = (0, 1, 2, 3),
    dte: list[int] | None = None,
) -> DataFrame:
    lo = start if isinstance(start, Column) else F.lit(start)
    hi = end if isinstance(end, Column) else F.lit(end)
    if mode == "weekly":
        weeks = days.where(F.weekday("d") == 0).select(F.col("d").alias("week_monday"), F.date_add("d", 4).alias("expiry"))
    elif mode == "expiry_range":
        weeks = days.where(F.weekday("d").isin(*expiry_weekdays)).select(
            week_monday(F.col("d")).alias("week_monday"), F.col("d").alias("expiry")
        )
    else:
        raise ValueError(f"unknown schedule mode {mode!r}")
    offsets = dte if dte else list(asof_weekdays)
    step = F.explode(F.array(*[F.lit(int(o)) for o in offsets])).alias("_o")
    asof = F.date_sub("expiry", F.col("_o")) if dte else F.date_add("week_monday", F.col("_o"))
    rows = weeks.select("week_monday", "expiry", step).withColumn("asof", asof).drop("_o")
    status = F.when(F.col("asof") > F.col("expiry"), "after_expiry")
    if mode == "weekly" and not dte:
        status = status.when((F.col("asof") < lo) | (F.col("asof") > hi), "out_of_range")
    return rows.withColumn("status", status.otherwise("kept")).dropDuplicates(["week_monday", "expiry", "asof"])
