"""Weekly totals on a gap-free calendar."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions import calendar as cal
from chronofold.functions.durations import duration_text
from chronofold.operators.ratios import full_range_weeks
from chronofold.plans.period import Period
from chronofold.plans.series import USER, dense_rows, dense_series
from chronofold.sources.tables import in_period


def _placed(records: DataFrame, period: Period) -> tuple[DataFrame, int]:
    """The records of a period with ``place``, the weeks since its first one, and the number
    of weeks it touches."""
    place = cal.weeks_since(F.col("date"), period.first)
    kept = in_period(records, period).withColumn("place", place)
    return kept, cal.label_count("week", period.first, period.last)


def _dense_weeks(
    records: DataFrame, period: Period, keys: Sequence[str], users: DataFrame | None
) -> DataFrame:
    kept, size = _placed(records, period)
    return dense_rows(kept, keys, size, users)


def week_points_of_year(
    records: DataFrame, year: int, keys: Sequence[str] = USER, users: DataFrame | None = None
) -> DataFrame:
    """The weeks of a year as an array of ``{x: week, y: total}`` for a bar chart."""
    kept, size = _placed(records, Period.year(year))
    series = dense_series(kept, keys, size, users)
    points = F.transform(
        "data", lambda total, place: F.struct((place + 1).cast("long").alias("x"), total.alias("y"))
    )
    return series.select(*keys, F.lit(str(year)).alias("year"), points.alias("points"))


def week_totals_of_year(
    records: DataFrame,
    year: int,
    include_partial: bool = True,
    keys: Sequence[str] = USER,
    users: DataFrame | None = None,
) -> DataFrame:
    """Every week of a year, numbered from 1; partial weeks at either end may be left out."""
    period = Period.year(year)
    rows = _dense_weeks(records, period, keys, users)
    if not include_partial:
        offset = 1 if period.first.weekday() == 0 else 0
        end = dt.date(year + 1, 1, 1)
        full = [week - offset for week in full_range_weeks(period.first, end)]
        rows = rows.filter(F.col("place").isin(full))
    return rows.select(
        *keys,
        F.lit(str(year)).alias("year"),
        (F.col("place") + 1).cast("long").alias("week"),
        "total",
    )


def week_totals_in_range(
    records: DataFrame,
    begin: dt.date,
    end: dt.date,
    include_partial: bool = True,
    keys: Sequence[str] = USER,
    users: DataFrame | None = None,
) -> DataFrame:
    """Every week group of a half-open range, see ``range_week`` for its numbers."""
    rows = _dense_weeks(records, Period.until(begin, end), keys, users)
    offset = 1 if begin.weekday() == 0 else 0
    rows = rows.withColumn("week_group", (F.col("place") + offset).cast("long"))
    if not include_partial:
        rows = rows.filter(F.col("week_group").isin(full_range_weeks(begin, end)))
    return rows.select(*keys, "week_group", F.col("total").alias("week_total"))


def past_week_bounds(as_of: dt.date, count: int, include_current: bool = True) -> list[Period]:
    """The last ``count`` Monday weeks, newest first."""
    newest = Period.week_around(as_of).first
    if not include_current:
        newest -= dt.timedelta(days=7)
    return [Period.week_from(newest - dt.timedelta(days=7 * back)) for back in range(count)]


def past_weeks(
    records: DataFrame,
    as_of: dt.date,
    count: int,
    include_current: bool = True,
    keys: Sequence[str] = USER,
    users: DataFrame | None = None,
) -> DataFrame:
    """Total of each of the last weeks, newest first, 0 for the empty ones."""
    weeks = past_week_bounds(as_of, count, include_current)
    rows = _dense_weeks(records, Period(weeks[-1].first, weeks[0].last), keys, users)
    oldest = cal.date_lit(weeks[-1].first)
    monday = F.date_add(oldest, F.col("place") * 7)
    return rows.select(
        *keys,
        monday.alias("monday"),
        F.date_add(monday, 6).alias("sunday"),
        F.col("total").alias("total_time"),
        duration_text(F.col("total")).alias("time"),
    ).sortWithinPartitions(*keys, F.desc("monday"))
