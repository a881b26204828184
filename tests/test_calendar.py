import calendar
import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronofold.functions import calendar as cal
from chronofold.operators.ratios import full_range_weeks


def all_days():
    day = dt.date(2015, 1, 1)
    while day <= dt.date(2027, 12, 31):
        yield day
        day += dt.timedelta(days=1)


def range_week(day, begin):
    count = 0
    while begin <= day:
        count += begin.weekday() == 0
        begin += dt.timedelta(days=1)
    return count


def test_closed_forms_over_thirteen_years(spark):
    day = F.col("d")
    frame = spark.createDataFrame([(d,) for d in all_days()], "d date").select(
        "d",
        cal.year_week_from_zero(day).alias("zero"),
        cal.year_week_from_one(day).alias("one"),
        cal.weekday_from_sunday(day).alias("weekday"),
        cal.range_week(day, F.trunc(day, "month")).alias("in_month"),
        cal.monday(day).alias("monday"),
        cal.sunday(day).alias("sunday"),
        cal.next_or_same_weekday(day, 1).alias("next_monday"),
        cal.next_or_same_weekday(day, 0).alias("next_sunday"),
        cal.days_in_year(day).alias("year_days"),
        cal.iso_week_label(day).alias("iso"),
    )
    for row in frame.collect():
        d = row.d
        jan1 = dt.date(d.year, 1, 1)
        assert row.zero == int(d.strftime("%W"))
        assert row.one == row.zero + (jan1.strftime("%W") == "00")
        assert row.weekday == int(d.strftime("%w"))
        assert row.in_month == range_week(d, d.replace(day=1))
        assert row.monday == d - dt.timedelta(days=d.weekday())
        assert row.sunday == row.monday + dt.timedelta(days=6)
        assert row.next_monday == d + dt.timedelta(days=(7 - d.weekday()) % 7)
        assert row.next_sunday == d + dt.timedelta(days=(6 - d.weekday()) % 7)
        assert row.year_days == 365 + calendar.isleap(d.year)
        assert row.iso == f"{d.isocalendar()[1]:02d}"


def test_week_start_of_inverts_the_week_number(spark):
    frame = spark.createDataFrame([(d,) for d in all_days()], "d date")
    day = F.col("d")
    start = cal.week_start_of(F.year(day), cal.year_week_from_zero(day))
    full = frame.filter(cal.year_week_from_zero(day) > 0).select("d", start.alias("monday"))
    assert full.filter(F.col("monday") != cal.monday(day)).count() == 0


@pytest.mark.parametrize(
    ("period", "first", "last", "expected"),
    [
        ("day", "2024-12-30", "2025-01-02", ["2024-12-30", "2024-12-31", "2025-01-01", "2025-01-02"]),
        ("week", "2020-12-25", "2021-01-12", ["52", "53", "01", "02"]),
        ("month", "2023-11-30", "2025-02-01", None),
        ("year", "2023-05-05", "2025-01-01", ["2023", "2024", "2025"]),
        ("day", "2025-03-01", None, ["2025-03-01"]),
    ],
)
def test_range_labels(spark, period, first, last, expected):
    row = spark.createDataFrame([(first, last)], "a string, b string").select(
        cal.range_labels(period, F.col("a").cast("date"), F.col("b").cast("date")).alias("labels")
    ).first()
    if expected is None:  # three calendar years, which the reference cannot label
        assert len(row.labels) == 16 and row.labels[0] == "2023-11" and row.labels[-1] == "2025-02"
    else:
        assert row.labels == expected
    if last:
        a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
        assert cal.label_count(period, a, b) == len(row.labels)


def test_range_labels_rejects_other_periods(spark):
    with pytest.raises(ValueError):
        cal.range_labels("decade", F.col("a"), F.col("b"))


@pytest.mark.parametrize(
    ("day", "labels"),
    [
        ("2025-01-15", ["01", "02", "03", "04", "05"]),
        ("2024-12-05", ["48", "49", "50", "51", "52", "01"]),
        ("2021-01-20", ["53", "01", "02", "03", "04"]),
    ],
)
def test_month_labels_follow_the_calendar_over_new_year(spark, day, labels):
    row = spark.range(1).select(cal.month_labels(F.lit(day).cast("date")).alias("x")).first()
    assert row.x == labels


@pytest.mark.parametrize(
    ("begin", "end"),
    [("2024-01-01", "2024-02-01"), ("2024-05-01", "2024-06-01"), ("2024-12-30", "2025-01-06"), ("2024-03-05", "2024-03-09")],
)
def test_full_weeks_have_seven_days(begin, end):
    begin, end = dt.date.fromisoformat(begin), dt.date.fromisoformat(end)
    days = {}
    day = begin
    while day < end:
        days.setdefault(range_week(day, begin), []).append(day)
        day += dt.timedelta(days=1)
    assert full_range_weeks(begin, end) == [w for w, d in days.items() if len(d) == 7]
