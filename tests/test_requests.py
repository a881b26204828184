"""Requests as rows."""

import datetime as dt

from chronofold.operators import totals
from chronofold.plans.requests import with_span

COLUMNS = "id long, user_id long, day string, month string, year string, week_start string, week_end string, range_beginning string, range_ending string"  # noqa: E501


def _request(number, user=1, **given):
    names = [part.split()[0] for part in COLUMNS.split(", ")][2:]
    return (number, user, *[given.get(name) for name in names])


def test_spans_and_their_problems(spark):
    rows = [
        _request(0, day="2024-2-9"),
        _request(1, month="2024-02"),
        _request(2, year="2023"),
        _request(3, week_start="2024-02-28", week_end="2024-03-05"),
        _request(4, range_beginning="2024-03-01", range_ending="2024-02-01"),
        _request(5, day="2024-02-30"),
        _request(6, day="2024-02-01", year="2024"),
        _request(7),
        _request(8, range_ending="2024-02-01"),
        _request(9, month=""),
        _request(10, year="24"),
    ]
    found = {r.id: r for r in with_span(spark.createDataFrame(rows, COLUMNS)).collect()}
    day = dt.date
    assert [(found[i].first, found[i].last) for i in range(5)] == [
        (day(2024, 2, 9), day(2024, 2, 9)),
        (day(2024, 2, 1), day(2024, 2, 29)),
        (day(2023, 1, 1), day(2023, 12, 31)),
        (day(2024, 2, 28), day(2024, 3, 5)),
        (day(2024, 3, 1), day(2024, 2, 1)),
    ]
    assert [found[i].problem for i in range(5, 11)] == [
        "bad date", "several spans", "no span", "half a span", "bad date", "bad date",
    ]
    assert all(found[i].first is None and found[i].last is None for i in range(5, 11))


def test_requests_are_answered_from_running_sums(spark):
    records = spark.createDataFrame(
        [(1, dt.date(2024, 2, d), d) for d in (1, 1, 5, 9)]
        + [(1, dt.date(2024, 2, 5), None), (1, None, 50), (2, dt.date(2024, 2, 5), 7), (None, dt.date(2024, 2, 5), 9)],
        "user_id long, date date, elapsed_s long",
    )
    rows = [
        _request(0, month="2024-02"),
        _request(1, day="2024-02-05"),
        _request(2, range_beginning="2024-02-02", range_ending="2024-02-08"),
        _request(2, range_beginning="2024-02-02", range_ending="2024-02-08"),
        _request(3, range_beginning="2024-02-09", range_ending="2024-02-01"),
        _request(4, user=2, year="2024"),
        _request(5, user=3, year="2024"),
        _request(6, user=None, year="2024"),
        _request(7, day="x"),
    ]
    requests = spark.createDataFrame(rows, COLUMNS)
    answered = totals.totals_of_requests(records, requests)
    got = sorted((r.id, r["count"], r.total_time) for r in answered.collect() if r.problem is None)
    assert got == [(0, 5, 16), (1, 2, 5), (2, 2, 5), (2, 2, 5), (3, 0, 0), (4, 1, 7), (5, 0, 0), (6, 0, 0)]
    assert [(r["count"], r.total_time) for r in answered.filter("id = 7").collect()] == [(None, None)]
    empty = totals.totals_of_requests(records.limit(0), requests).collect()
    assert {r["count"] for r in empty} == {0, None} and len(empty) == len(rows)
    assert totals.totals_of_requests(records, requests.limit(0)).count() == 0


def test_columns_that_are_not_given(spark):
    frame = spark.createDataFrame([("2024", 5)], "year string, extra int")
    row = with_span(frame).collect()[0]
    assert (row.first, row.last, row.extra) == (dt.date(2024, 1, 1), dt.date(2024, 12, 31), 5)


def test_empty_tables_are_counted(spark):
    tables = {"a": spark.range(3), "b": spark.range(0)}
    assert sorted(tuple(r) for r in totals.row_counts(tables).collect()) == [("a", 3, False), ("b", 0, True)]
