"""Requests as rows: the span each of them names, so that a table of requests is one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a request table, all text. The first three hold one date each, the others two.
SINGLE = ("day", "month", "year")
PAIRS = (("week_start", "week_end"), ("range_beginning", "range_ending"))


def _day(text: Column) -> Column:
    """NULL where the text is no day of the calendar."""
    formed = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text)
    return F.try_to_timestamp(formed, F.lit("yyyy-M-d")).cast("date")


def with_span(requests: DataFrame) -> DataFrame:
    """``requests`` with ``first``, ``last`` (both included) and ``problem``.

    A request names one span at most; one that names several, none, half of a pair or no day of the
    calendar has a ``problem`` and no dates. Columns of ``SINGLE`` and ``PAIRS`` that the table lacks
    count as not given. Repeated requests stay repeated.
    """
    given = {
        name: F.col(name) if name in requests.columns else F.lit(None).cast("string")
        for name in (*SINGLE, *[name for pair in PAIRS for name in pair])
    }
    month = _day(F.concat(given["month"], F.lit("-1")))
    january = _day(F.concat(given["year"], F.lit("-1-1")))
    spans = [
        (given["day"].isNotNull(), _day(given["day"]), _day(given["day"])),
        (given["month"].isNotNull(), month, F.last_day(month)),
        (given["year"].isNotNull(), january, F.date_sub(F.add_months(january, 12), 1)),
    ]
    half = F.lit(False)
    for begin, end in PAIRS:
        either = given[begin].isNotNull() | given[end].isNotNull()
        half = half | (either & (given[begin].isNull() | given[end].isNull()))
        spans.append((either, _day(given[begin]), _day(given[end])))
    named = sum((asked.cast("int") for asked, _, _ in spans), F.lit(0))
    first = F.coalesce(*[F.when(asked, begin) for asked, begin, _ in spans])
    last = F.coalesce(*[F.when(asked, end) for asked, _, end in spans])
    problem = (
        F.when(named > 1, "several spans")
        .when(named == 0, "no span")
        .when(half, "half a span")
        .when(first.isNull() | last.isNull(), "bad date")
    )
    return requests.withColumns(
        {
            "problem": problem,
            "first": F.when(problem.isNull(), first),
            "last": F.when(problem.isNull(), last),
        }
    )
