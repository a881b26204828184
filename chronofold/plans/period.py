"""Calendar periods as closed date ranges, and the rules that turn a request into one.

Every period is a pair of literal dates. Filters therefore reach the scan as plain range
predicates on ``date`` instead of functions of it.
"""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the request format and which time span wins when a request carries several, first match first.
STATS_ORDER = ("day", "week", "week_pair", "month", "year", "range_pair")
SEARCH_ORDER = ("day", "week_pair", "range_pair", "year", "month")
# A client request may name only one of these.
EXCLUSIVE_SPANS = ("day", "month", "week[]", "year", "range[]")

# Names of the request format.
_PAIRS = {"week_pair": ("weekStart", "weekEnd"), "range_pair": ("rangeBeginning", "rangeEnding")}


def as_date(value: dt.date | str) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.datetime.strptime(value, "%Y-%m-%d").date()


@dataclass(frozen=True)
class Period:
    """``first .. last``, both included; ``None`` leaves that side open."""

    first: dt.date | None
    last: dt.date | None

    def contains(self, day: Column) -> Column:
        if self.first is not None and self.last is not None:
            return day.between(F.lit(self.first), F.lit(self.last))
        if self.first is not None:
            return day >= F.lit(self.first)
        if self.last is not None:
            return day <= F.lit(self.last)
        return F.lit(True)

    @property
    def days(self) -> int:
        return (self.last - self.first).days + 1

    @classmethod
    def day(cls, value) -> Period:
        return cls(as_date(value), as_date(value))

    @classmethod
    def week_from(cls, value) -> Period:
        """Seven days from the given date, which need not be a Monday."""
        first = as_date(value)
        return cls(first, first + dt.timedelta(days=6))

    @classmethod
    def week_around(cls, value) -> Period:
        day = as_date(value)
        return cls.week_from(day - dt.timedelta(days=day.weekday()))

    @classmethod
    def month(cls, value) -> Period:
        first = (
            as_date(value).replace(day=1)
            if isinstance(value, dt.date)
            else dt.datetime.strptime(value, "%Y-%m").date()
        )
        return cls(first, first.replace(day=calendar.monthrange(first.year, first.month)[1]))

    @classmethod
    def year(cls, value) -> Period:
        year = value.year if isinstance(value, dt.date) else int(value)
        return cls(dt.date(year, 1, 1), dt.date(year, 12, 31))

    @classmethod
    def between(cls, first, last) -> Period:
        return cls(as_date(first), as_date(last))

    @classmethod
    def until(cls, first, end) -> Period:
        """Half-open: the end date itself is left out."""
        return cls(as_date(first), as_date(end) - dt.timedelta(days=1))


def today(as_of: dt.date) -> Period:
    return Period.day(as_of)


def this_week(as_of: dt.date) -> Period:
    """From Monday on, with no upper bound."""
    return Period(Period.week_around(as_of).first, None)


def this_month(as_of: dt.date) -> Period:
    return Period.month(as_of)


def this_year(as_of: dt.date) -> Period:
    return Period.year(as_of)


def last_year(as_of: dt.date) -> Period:
    return Period.year(as_of.year - 1)


def year_to_third_quarter(year: int) -> Period:
    return Period(dt.date(year, 1, 1), dt.date(year, 9, 30))


def same_day_last_year(as_of: dt.date) -> dt.date:
    last_day = calendar.monthrange(as_of.year - 1, as_of.month)[1]
    return as_of.replace(year=as_of.year - 1, day=min(as_of.day, last_day))


def last_year_to_date(as_of: dt.date) -> Period:
    return Period(dt.date(as_of.year - 1, 1, 1), same_day_last_year(as_of))


def week_between_offsets(as_of: dt.date, monday_days: int, sunday_days: int) -> Period:
    """Next Monday and next Sunday of ``as_of`` (either may be today), moved by days each."""
    monday = as_of + dt.timedelta(days=(7 - as_of.weekday()) % 7)
    sunday = as_of + dt.timedelta(days=(6 - as_of.weekday()) % 7)
    return Period(
        monday + dt.timedelta(days=monday_days), sunday + dt.timedelta(days=sunday_days)
    )


def check_single_span(names) -> None:
    if sum(name in EXCLUSIVE_SPANS for name in names) > 1:
        raise KeyError("a request may name only one time span")


def clean_request(params: Mapping) -> dict:
    """A client's parameters as a request: one time span at most, well-formed dates, and the
    two dates of ``week[]`` and ``range[]`` under their own names."""
    check_single_span(params)
    request = dict(params)
    for name, (first, last) in (
        ("week[]", ("weekStart", "weekEnd")),
        ("range[]", ("rangeBeginning", "rangeEnding")),
    ):
        if name in request:
            request[first], request[last] = request.pop(name)
    for order in (STATS_ORDER, SEARCH_ORDER):
        from_request(request, order)
    return request


def from_request(request: Mapping, order: tuple[str, ...] = STATS_ORDER) -> Period | None:
    """The period a request asks for, or None when it names none."""
    for span in order:
        if span in _PAIRS:
            first, last = _PAIRS[span]
            if first in request and last in request:
                return Period.between(request[first], request[last])
        elif span in request:
            value = request[span]
            if span == "day":
                return Period.day(value)
            if span == "week":
                return Period.week_from(value)
            if span == "month":
                return Period.month(value)
            return Period.year(value)
    return None


def named_period(name: str, as_of: dt.date, date: str | None = None) -> Period:
    """A period by name, around ``date`` when given and around ``as_of`` otherwise."""
    if name == "day":
        return Period.day(date or as_of)
    if name == "week":
        return Period.week_around(date or as_of)
    if name == "month":
        return Period.month(date or as_of)
    if name == "year":
        return Period.year(date or as_of)
    raise ValueError(f"period must be day, week, month or year, not {name!r}")


def resolve(
    request: Mapping, as_of: dt.date, bounds: tuple[dt.date, dt.date] | None = None
) -> tuple[str, Period]:
    """Name and dates of the period a statistics request is about.

    ``period`` (with an optional ``date``) wins over explicit spans; a request with nothing
    but a tag covers ``bounds``, the first and last date on record.
    """
    if "period" in request:
        name = request["period"]
        return name, named_period(name, as_of, request.get("date"))
    period = from_request(request)
    if period is not None:
        spans = {"day": "day", "week": "week", "weekStart": "week", "month": "month", "year": "year"}
        name = next((spans[key] for key in spans if key in request), "custom")
        return name, period
    if "tag" in request and bounds is not None:
        return "custom", Period(*bounds)
    raise KeyError("the request names no period")
