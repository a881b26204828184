import datetime as dt

import pytest

from chronofold.plans import period as periods
from chronofold.plans.period import SEARCH_ORDER, Period
from chronofold.plans.selection import RecordFilter

D = dt.date


def test_exactly_one_span_wins_in_order():
    request = {
        "day": "2025-01-05",
        "week": "2025-02-05",
        "weekStart": "2025-03-03",
        "weekEnd": "2025-03-09",
        "month": "2025-04",
        "year": "2025",
        "rangeBeginning": "2025-06-01",
        "rangeEnding": "2025-06-30",
    }
    expected = [
        ("day", Period(D(2025, 1, 5), D(2025, 1, 5))),
        ("week", Period(D(2025, 2, 5), D(2025, 2, 11))),
        ("weekStart", Period(D(2025, 3, 3), D(2025, 3, 9))),
        ("month", Period(D(2025, 4, 1), D(2025, 4, 30))),
        ("year", Period(D(2025, 1, 1), D(2025, 12, 31))),
        ("rangeBeginning", Period(D(2025, 6, 1), D(2025, 6, 30))),
    ]
    for key, period in expected:
        assert periods.from_request(request) == period
        del request[key]
    assert periods.from_request(request) is None


def test_search_prefers_year_over_month_and_knows_no_single_week():
    request = {"week": "2025-02-05", "month": "2025-04", "year": "2024"}
    assert periods.from_request(request, SEARCH_ORDER) == Period.year(2024)
    assert periods.from_request({"week": "2025-02-05"}, SEARCH_ORDER) is None


def test_week_resolver_keeps_the_month():
    """The reference reads the month of a week's date as minutes."""
    assert periods.named_period("week", D(2030, 1, 1), "2025-06-11") == Period(D(2025, 6, 9), D(2025, 6, 15))


@pytest.mark.parametrize(
    ("request_", "name", "period"),
    [
        ({"period": "month", "date": "2024-02"}, "month", Period(D(2024, 2, 1), D(2024, 2, 29))),
        ({"period": "year"}, "year", Period.year(2025)),
        ({"period": "day", "date": ""}, "day", Period.day("2025-03-05")),
        ({"weekStart": "2025-03-03", "weekEnd": "2025-03-09"}, "week", Period.week_from("2025-03-03")),
        ({"rangeBeginning": "2025-01-02", "rangeEnding": "2025-02-03"}, "custom", Period.between("2025-01-02", "2025-02-03")),
        ({"tag": "x"}, "custom", Period(D(2020, 1, 1), D(2021, 1, 1))),
    ],
)
def test_resolve(request_, name, period):
    bounds = (D(2020, 1, 1), D(2021, 1, 1))
    assert periods.resolve(request_, D(2025, 3, 5), bounds) == (name, period)


def test_resolve_without_period():
    with pytest.raises(KeyError):
        periods.resolve({"task": "x"}, D(2025, 1, 1))
    with pytest.raises(ValueError):
        periods.named_period("decade", D(2025, 1, 1))


def test_one_span_per_request():
    periods.check_single_span(["day", "task"])
    with pytest.raises(KeyError):
        periods.check_single_span(["day", "month"])


def test_current_spans():
    sunday, monday = D(2025, 3, 9), D(2025, 3, 10)
    assert periods.this_week(sunday) == Period(D(2025, 3, 3), None)
    assert periods.this_week(monday) == Period(monday, None)
    assert periods.this_month(D(2024, 12, 31)) == Period(D(2024, 12, 1), D(2024, 12, 31))
    assert periods.last_year_to_date(D(2024, 2, 29)) == Period(D(2023, 1, 1), D(2023, 2, 28))
    assert periods.week_between_offsets(D(2025, 3, 5), -7, 0) == Period(D(2025, 3, 3), D(2025, 3, 9))


def test_filters_from_request():
    wanted = RecordFilter.from_request({"task": "A", "subtask": "None", "tag": "t"})
    assert wanted.without_subtask and wanted.subtask is None and wanted.tag == "t"
    assert RecordFilter.from_request({"subtask": "lonely"}) == RecordFilter()
    assert RecordFilter.from_request({"logSearch": "x"}).log_contains == "x"


def test_clean_request_reads_values_not_names():
    request = periods.clean_request({"range[]": ["2025-01-02", "2025-02-03"], "task": "A"})
    assert periods.from_request(request) == Period.between("2025-01-02", "2025-02-03")
    assert request["task"] == "A" and "range[]" not in request
    week = periods.clean_request({"week[]": ["2025-03-03", "2025-03-09"]})
    assert periods.from_request(week, SEARCH_ORDER) == Period.week_from("2025-03-03")
    with pytest.raises(KeyError):
        periods.clean_request({"day": "2025-01-01", "year": "2025"})
    with pytest.raises(ValueError):
        periods.clean_request({"month": "January"})
