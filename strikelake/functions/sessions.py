"""Trading sessions as a dimension: one row per day, met by an equi-join on the local date.

Any table (session_date, open_utc, close_utc) serves; `us_sessions` derives one by rule. The lookups add a calendar-sized table to
the rows, so no range join and no per-row search is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelake.functions.calendar import close_time_utc, local_time

ZONE = "America/New_York"


def easter_sunday(year: Column) -> Column:
    """Gregorian computus in integers."""
    div = lambda x, n: F.floor(x / n).cast("int")
    century = div(year, 100)
    golden = year % 19
    moon = (golden * 19 + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30
    rest = year % 100
    week = (F.lit(32) + (century % 4) * 2 + div(rest, 4) * 2 - moon - rest % 4) % 7
    late = div(golden + moon * 11 + week * 22, 451)
    days = moon + week - late * 7 + 114
    return F.make_date(year, div(days, 31), days % 31 + 1)


def us_holiday(d: Column) -> Column:
    """Whether the exchange is closed all day by rule; one-off closures are not known here.

    A holiday of fixed date is kept on Friday or Monday when it falls on a weekend, but New Year on a Saturday is not.
    """
    month, dom, dow = F.month(d), F.dayofmonth(d), F.weekday(d)
    on = lambda m, day, x=d: (F.month(x) == m) & (F.dayofmonth(x) == day)
    ahead = lambda m, day: (dow == 4) & on(m, day, F.date_add(d, 1))
    behind = lambda m, day: (dow == 0) & on(m, day, F.date_sub(d, 1))
    kept = lambda m, day: on(m, day) | ahead(m, day) | behind(m, day)
    nth = lambda m, weekday, n: (month == m) & (dow == weekday) & dom.between(7 * n - 6, 7 * n)
    return (
        on(1, 1) | behind(1, 1) | (nth(1, 0, 3) & (F.year(d) >= 1998)) | nth(2, 0, 3) | (d == F.date_sub(easter_sunday(F.year(d)), 2))
        | ((month == 5) & (dow == 0) & (dom >= 25)) | (kept(6, 19) & (F.year(d) >= 2022)) | kept(7, 4) | nth(9, 0, 1) | nth(11, 3, 4) | kept(12, 25)
    )


def us_half_day(d: Column) -> Column:
    """Days that close at 13:00: after Thanksgiving, and the eves of Independence Day and Christmas from Monday to Thursday."""
    month, dom, dow = F.month(d), F.dayofmonth(d), F.weekday(d)
    eve = ((month == 7) & (dom == 3)) | ((month == 12) & (dom == 24))
    return ((month == 11) & (dow == 4) & dom.between(23, 29)) | (eve & (dow <= 3))


def us_sessions(days: DataFrame, day: str = "d", zone: str = ZONE) -> DataFrame:
    """(session_date, half_day, open_utc, close_utc) for the trading days among the distinct `days`; NULL days are left out."""
    d = F.col("session_date")
    out = days.select(F.col(day).cast("date").alias("session_date")).distinct().where((F.weekday(d) < 5) & ~us_holiday(d))
    half = us_half_day(d)
    close = F.when(half, close_time_utc(d, zone, "13:00:00")).otherwise(close_time_utc(d, zone, "16:00:00"))
    return out.select("session_date", half.alias("half_day"), close_time_utc(d, zone, "09:30:00").alias("open_utc"), close.alias("close_utc"))


def day_span(df: DataFrame, ts: str, zone: str = ZONE, margin: int = 10) -> DataFrame:
    """(d): every local day from `margin` days before the first time to the last one; no rows for an empty table."""
    local = F.to_date(local_time(F.col(ts), zone))
    ends = df.agg(F.date_sub(F.min(local), margin).alias("_lo"), F.max(local).alias("_hi")).where(F.col("_hi").isNotNull())
    return ends.select(F.explode(F.sequence("_lo", "_hi")).alias("d"))


def with_session_class(df: DataFrame, ts: str, sessions: DataFrame, name: str = "session", zone: str = ZONE) -> DataFrame:
    """PRE, REG (open to close, both included) or POST by the day's session; a day without one counts from 9:30 to 16:00. NULL is PRE."""
    hours = sessions.select(F.col("session_date").alias("_day"), F.col("open_utc").alias("_open"), F.col("close_utc").alias("_close"))
    joined = df.withColumn("_day", F.to_date(local_time(F.col(ts), zone))).join(hours, "_day", "left")
    opened = F.coalesce("_open", close_time_utc(F.col("_day"), zone, "09:30:00"))
    closed = F.coalesce("_close", close_time_utc(F.col("_day"), zone, "16:00:00"))
    label = F.when(F.col(ts).isNull() | (F.col(ts) < opened), "PRE").when(F.col(ts) <= closed, "REG").otherwise("POST")
    return joined.withColumn(name, label).select(*df.columns, name)


def with_last_close(df: DataFrame, ts: str, sessions: DataFrame, name: str = "last_close", zone: str = ZONE) -> DataFrame:
    """The latest close at or before the time; NULL where the sessions start later.

    Each day of the span learns its own close and the one before it, so the rows need one equi-join.
    """
    days = day_span(df, ts, zone, 0).unionByName(sessions.select(F.col("session_date").alias("d"))).distinct()
    known = days.join(sessions.select(F.col("session_date").alias("d"), F.col("close_utc").alias("_close")), "d", "left")
    before = F.last("_close", ignorenulls=True).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1))  # a row a day
    closes = known.select(F.col("d").alias("_day"), "_close", before.alias("_before"))
    joined = df.withColumn("_day", F.to_date(local_time(F.col(ts), zone))).join(closes, "_day", "left")
    return joined.withColumn(name, F.when(F.col("_close") <= F.col(ts), F.col("_close")).otherwise(F.col("_before"))).select(*df.columns, name)


def mark_closed_days(schedule: DataFrame, sessions: DataFrame) -> DataFrame:
    """Schedule rows kept so far get the status `no_session` where the market is closed on their as-of day."""
    open_days = sessions.select(F.col("session_date").alias("asof"), F.lit(True).alias("_open"))
    closed = (F.col("status") == "kept") & F.col("_open").isNull()
    return schedule.join(open_days, "asof", "left").withColumn("status", F.when(closed, "no_session").otherwise(F.col("status"))).select(*schedule.columns)
