"""The worked cases the reference tests, every record 300 seconds long unless said otherwise."""

import datetime as dt

import pytest

from chronofold.operators import charts, ratios, reports, weeks
from chronofold.plans import period as periods
from chronofold.plans.period import Period

# Dates and results of the published cases, here and below.
JANUARY = ("2025-01-01", "2025-01-08", "2025-01-15", "2025-01-22", "2025-01-29", "2025-01-31")


@pytest.fixture
def base(make_records):
    return make_records(("2025-01-01", "Test"), ("2025-01-02", "Test2"), ("2025-01-08", "Test"))


def shares(records, period):
    rows = ratios.task_ratio_formatted(records, period, keys=()).collect()
    return [(r.task, r.time, list(r.formatted), r.ratio) for r in rows]


WEEK = [("Test", 300, ["00", "05", "00"], 50.0), ("Test2", 300, ["00", "05", "00"], 50.0)]
DAY = [("Test", 300, ["00", "05", "00"], 100.0)]
LONG = [("Test", 600, ["00", "10", "00"], 66.7), ("Test2", 300, ["00", "05", "00"], 33.3)]


@pytest.mark.parametrize(
    ("request_", "expected"),
    [
        ({"period": "week", "date": "2025-01-01"}, WEEK),
        ({"period": "day", "date": "2025-01-01"}, DAY),
        ({"period": "month", "date": "2025-01"}, LONG),
        ({"period": "year", "date": "2025"}, LONG),
        ({"period": "day"}, DAY),
        ({"period": "week"}, WEEK),
        ({"period": "month"}, LONG),
        ({"period": "year"}, LONG),
    ],
)
def test_task_ratio(base, request_, expected):
    _, period = periods.resolve(request_, as_of=dt.date(2025, 1, 1))
    assert shares(base, period) == expected


def month_page(records, month, as_of=dt.date(2026, 1, 1)):
    (row,) = reports.page_month(records, month, as_of).collect()
    return row


def test_month_page_rejects_a_bad_date(base):
    with pytest.raises(ValueError):
        reports.page_month(base, "invalid-date", dt.date(2025, 1, 1))


def test_month_has_five_week_labels(make_records):
    row = month_page(make_records(("2025-01-10", "Test")), "2025-01")
    assert row.labels == ["01", "02", "03", "04", "05"]


def test_month_line_has_zeros_in_gaps(make_records):
    row = month_page(make_records(("2025-02-01", "Test"), ("2025-02-15", "Test")), "2025-02")
    assert row.line == [300, 0, 300, 0, 0]


def test_month_page_full(make_records):
    row = month_page(make_records(*[(day, "Test") for day in JANUARY]), "2025-01")
    assert row.labels == ["01", "02", "03", "04", "05"]
    assert [(s.name, s.data) for s in row.stacked] == [("Test", [100.0] * 5)]
    assert row.line == [300, 300, 300, 300, 600]


def test_month_page_two_tasks(make_records):
    days = [(day, "Test") for day in JANUARY[:-1]] + [(JANUARY[-1], "Test2")]
    row = month_page(make_records(*days), "2025-01")
    assert len(row.stacked) == 2
    assert row.stacked[0].data[-1] == 50


def test_month_page_last_week_only(make_records):
    row = month_page(make_records(("2025-01-31", "Test")), "2025-01")
    assert [(s.name, s.data) for s in row.stacked] == [("Test", [0.0, 0.0, 0.0, 0.0, 100.0])]
    assert row.line == [0, 0, 0, 0, 300]


def test_month_page_without_date_leaves_the_future_open(make_records):
    records = make_records(("2025-02-01", "Test"), ("2025-02-08", "Test"), ("2025-02-15", "Test"))
    row = month_page(records, None, as_of=dt.date(2025, 2, 21))
    assert row.line == [300, 300, 300, 0, None]
    assert "resume" not in row.asDict()


@pytest.fixture
def two_years(make_records):
    return make_records(
        ("2024-01-01", "Test"), ("2024-01-08", "Test"), ("2025-01-01", "Test"), ("2025-01-08", "Test")
    )


def test_year_page_parts(two_years):
    (row,) = reports.page_year(two_years, 2024, dt.date(2025, 6, 1)).collect()
    assert len(row.labels) == 12
    assert [s.name for s in row.stacked] == ["Test"]
    assert row.line == [600] + [0] * 11
    assert [(p.x, p.y) for p in row.weeks][:3] == [(1, 300), (2, 300), (3, 0)]


@pytest.mark.parametrize("year", [2024, 2025])
def test_first_week_of_a_year_is_one(two_years, year):
    (row,) = weeks.week_points_of_year(two_years, year).collect()
    assert row.year == str(year)
    assert row.points[0].x == 1 and row.points[0].y == 300
    assert len(row.points) == 53


def test_week_page(make_records):
    records = make_records(("2025-01-06", "A"), ("2025-01-08", "A"), ("2025-01-08", "B", 100))
    as_of = dt.date(2025, 1, 9)
    (row,) = reports.page_week(records, dt.date(2025, 1, 8), as_of).collect()
    assert row.labels[0] == "2025-01-06" and row.labels[-1] == "2025-01-12"
    assert row.line == [300, 0, 400, 0, None, None, None]
    assert {s.name: s.data[2] for s in row.stacked} == {"A": 75.0, "B": 25.0}


def test_line_chart_of_people_without_records(spark, make_records):
    records = make_records(("2025-01-06", "A", 300, 1))
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    rows = charts.line_chart(records, "day", Period.week_around("2025-01-06"), users=users).collect()
    assert {r.user_id: r.data[:2] for r in rows} == {1: [300, 0], 2: [0, 0]}
