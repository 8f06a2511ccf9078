"""Session calendar against published closures."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from strikelake.functions import calendar as C, sessions as Se

# Closed days and 13:00 closes of three years.
CLOSED = "2021-01-01 2021-01-18 2021-02-15 2021-04-02 2021-05-31 2021-07-05 2021-09-06 2021-11-25 2021-12-24 " \
    "2022-01-17 2022-02-21 2022-04-15 2022-05-30 2022-06-20 2022-07-04 2022-09-05 2022-11-24 2022-12-26 " \
    "2024-01-01 2024-01-15 2024-02-19 2024-03-29 2024-05-27 2024-06-19 2024-07-04 2024-09-02 2024-11-28 2024-12-25"
HALF = "2021-11-26 2022-11-25 2024-07-03 2024-11-29 2024-12-24"


def test_rules_equal_published_days(spark):
    days = spark.sql("SELECT explode(sequence(DATE '2021-01-01', DATE '2024-12-31')) AS d").where(F.year("d") != 2023)
    got = {r["session_date"]: r["half_day"] for r in Se.us_sessions(days.unionByName(days)).collect()}
    weekdays = {r["d"] for r in days.collect() if r["d"].weekday() < 5}
    assert sorted(weekdays - set(got)) == [date.fromisoformat(t) for t in CLOSED.split()]
    assert sorted(d for d, half in got.items() if half) == [date.fromisoformat(t) for t in HALF.split()]


def test_classes_and_last_close_around_a_half_day(spark):
    # 2024-11-28 is closed, 2024-11-29 closes at 18:00 UTC; 2024-07-05 opens at 13:30 UTC in summer time.
    cases = [
        ("2024-11-28 15:00:00", "REG", "2024-11-27 21:00:00"), ("2024-11-29 14:29:59", "PRE", "2024-11-27 21:00:00"),
        ("2024-11-29 14:30:00", "REG", "2024-11-27 21:00:00"), ("2024-11-29 18:00:00", "REG", "2024-11-29 18:00:00"),
        ("2024-11-29 18:00:01", "POST", "2024-11-29 18:00:00"), ("2024-12-01 15:00:00", "REG", "2024-11-29 18:00:00"),
        ("2024-07-05 13:30:00", "REG", "2024-07-03 17:00:00"), (None, "PRE", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string").select("i", F.to_timestamp("t").alias("ts"), F.lit("own").alias("note"))
    sessions = Se.us_sessions(Se.day_span(df, "ts"))
    out = Se.with_last_close(Se.with_session_class(df, "ts", sessions), "ts", sessions)
    assert out.columns == ["i", "ts", "note", "session", "last_close"]
    rows = out.select("i", "session", F.date_format("last_close", "yyyy-MM-dd HH:mm:ss").alias("c")).orderBy("i").collect()
    assert [(r["session"], r["c"]) for r in rows] == [(s, c) for _, s, c in cases]
    early = df.where(F.col("i") == 6)
    assert Se.with_last_close(early, "ts", Se.us_sessions(Se.day_span(early, "ts", margin=0))).first()["last_close"] is None
    empty = df.limit(0)
    assert Se.with_last_close(empty, "ts", Se.us_sessions(Se.day_span(empty, "ts"))).count() == 0


def test_days_to_expiry_by_span():
    assert C.dte_span(1, 7, 2) == [1, 3, 5, 7] and C.dte_span(2, 2) == [2] and C.dte_span(0, 4, 3) == [0, 3]
    for bad in ((-1, 3, 1), (4, 3, 1), (1, 3, 0)):
        with pytest.raises(ValueError):
            C.dte_span(*bad)
