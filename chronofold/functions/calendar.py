"""Calendar arithmetic on date columns, all as closed forms.

Weeks run Monday to Sunday. Four week numberings are in use and are not
interchangeable:

* ``year_week_from_zero``  Monday weeks, days before the first Monday are week 0;
* ``year_week_from_one``   Monday weeks, the week of January 1st is always week 1;
* ``range_week``           Monday weeks counted from the start of a range: the first
  week is 1 when the range starts on a Monday and 0 when it does not;
* ISO weeks                ``weekofyear``, used for labels only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofold.functions.durations import whole_div

DAY_FORMAT = "yyyy-MM-dd"
MONTH_FORMAT = "yyyy-MM"
YEAR_FORMAT = "yyyy"


def date_lit(day: dt.date | Column) -> Column:
    return day if isinstance(day, Column) else F.lit(day).cast("date")


def moment_lit(moment: dt.datetime) -> Column:
    """A wall-clock literal. It goes through text: a datetime literal would be an instant and
    shift with the time zone of the session."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def monday(day: Column) -> Column:
    return F.trunc(day, "week")


def sunday(day: Column) -> Column:
    return F.date_add(monday(day), 6)


def next_or_same_weekday(day: Column, weekday: int) -> Column:
    """The first date not before ``day`` that falls on ``weekday`` (0 is Sunday)."""
    return F.date_add(day, F.pmod(F.lit(weekday) - weekday_from_sunday(day), F.lit(7)).cast("int"))


def weekday_from_sunday(day: Column) -> Column:
    return F.dayofweek(day) - 1


def year_week_from_zero(day: Column) -> Column:
    return whole_div(F.dayofyear(day) + 6 - F.weekday(day), 7).cast("long")


def year_week_from_one(day: Column) -> Column:
    return whole_div(F.datediff(day, monday(F.trunc(day, "year"))), 7).cast("long") + 1


def range_week(day: Column, begin: Column) -> Column:
    weeks = whole_div(F.datediff(monday(day), monday(begin)), 7).cast("long")
    return weeks + F.when(F.weekday(begin) == 0, F.lit(1)).otherwise(F.lit(0))


def weeks_since(day: Column, begin: dt.date | Column) -> Column:
    """Whole Monday weeks between the week of ``begin`` and the week of ``day``."""
    return whole_div(F.datediff(monday(day), monday(date_lit(begin))), 7).cast("int")


def months_since(day: Column, begin: dt.date | Column) -> Column:
    begin = date_lit(begin)
    return (F.year(day) - F.year(begin)) * 12 + F.month(day) - F.month(begin)


def days_in_year(day: Column) -> Column:
    return F.datediff(F.add_months(F.trunc(day, "year"), 12), F.trunc(day, "year"))


def quarter_length(day: Column) -> Column:
    return days_in_year(day) / 4


def period_text(period: str, day: Column) -> Column:
    """The date as text at the grain of the period; weeks are named by a day."""
    formats = {"day": DAY_FORMAT, "week": DAY_FORMAT, "month": MONTH_FORMAT, "year": YEAR_FORMAT}
    return F.date_format(day, formats[period])


def week_start_of(year: Column, week: Column) -> Column:
    """Monday of a week numbered as in ``year_week_from_zero``."""
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    first_monday = next_or_same_weekday(new_year, 1)
    return F.date_add(first_monday, ((week - 1) * 7).cast("int"))


def day_spine(first: Column, last: Column) -> Column:
    return F.sequence(first, last)


def _each(dates: Column, pattern: str) -> Column:
    return F.transform(dates, lambda day: F.date_format(day, pattern))


def two_digits(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def iso_week_label(day: Column) -> Column:
    return two_digits(F.weekofyear(day))


def _mondays(first: Column, last: Column) -> Column:
    return F.sequence(monday(first), last, F.expr("interval 7 days"))


def week_labels(day: Column) -> Column:
    """The seven dates of the week around ``day``."""
    return _each(day_spine(monday(day), sunday(day)), DAY_FORMAT)


def month_labels(day: Column) -> Column:
    """ISO week numbers of the month around ``day``, in calendar order."""
    return F.transform(_mondays(F.trunc(day, "month"), F.last_day(day)), iso_week_label)


def year_labels(day: Column) -> Column:
    """The twelve months of the year around ``day``."""
    first = F.trunc(day, "year")
    return _each(
        F.sequence(first, F.add_months(first, 11), F.expr("interval 1 month")), MONTH_FORMAT
    )


def range_labels(period: str, first: Column, last: Column) -> Column:
    """Labels of every day, ISO week, month or year touched by ``first .. last``.

    A missing ``last`` stands for a single date and gives a single label.
    """
    if period == "day":
        labels = _each(day_spine(first, last), DAY_FORMAT)
    elif period == "week":
        labels = F.transform(_mondays(first, last), iso_week_label)
    elif period == "month":
        months = F.sequence(F.trunc(first, "month"), last, F.expr("interval 1 month"))
        labels = _each(months, MONTH_FORMAT)
    elif period == "year":
        labels = F.transform(F.sequence(F.year(first), F.year(last)), lambda y: y.cast("string"))
    else:
        raise ValueError(f"period must be day, week, month or year, not {period!r}")
    return F.when(last.isNull(), F.array(F.date_format(first, DAY_FORMAT))).otherwise(labels)


def label_position(period: str, day: Column, first: dt.date | Column) -> Column:
    """Zero-based place of ``day`` in ``range_labels(period, first, ...)``."""
    first = date_lit(first)
    places = {
        "day": lambda: F.datediff(day, first),
        "week": lambda: weeks_since(day, first),
        "month": lambda: months_since(day, first),
        "year": lambda: F.year(day) - F.year(first),
    }
    if period not in places:
        raise ValueError(f"period must be day, week, month or year, not {period!r}")
    return places[period]().cast("int")


def label_count(period: str, first: dt.date, last: dt.date) -> int:
    """Length of ``range_labels`` for literal dates."""
    if period == "day":
        return (last - first).days + 1
    if period == "week":
        first_monday = first - dt.timedelta(days=first.weekday())
        return (last - first_monday).days // 7 + 1
    if period == "month":
        return (last.year - first.year) * 12 + last.month - first.month + 1
    if period == "year":
        return last.year - first.year + 1
    raise ValueError(f"period must be day, week, month or year, not {period!r}")
