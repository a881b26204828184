"""Counts, totals and means over records and calendar periods.

Records are grouped by dates and numbers; period names are formatted afterwards, once per
result row, because formatting a date costs several times as much as truncating it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions import calendar as cal
from chronofold.functions.durations import duration_text
from chronofold.plans.daily import open_count, record_count
from chronofold.plans.period import Period
from chronofold.plans.requests import with_span
from chronofold.plans.series import USER, by_user, ordered, sums
from chronofold.sources.tables import in_period

# Grain of a mean -> expression of the date that tells its periods apart within one year.
_GRAINS = {
    "day": lambda day: day,
    "week": cal.year_week_from_zero,
    "month": lambda day: F.trunc(day, "month"),
    "year": F.year,
}


def timer_count(records: DataFrame, keys: Sequence[str] = USER) -> DataFrame:
    count = F.coalesce(record_count(records), F.lit(0).cast("long"))
    return records.groupBy(*keys).agg(count.alias("count"))


def total_time(records: DataFrame, keys: Sequence[str] = USER) -> DataFrame:
    total = F.coalesce(F.sum("elapsed_s"), F.lit(0).cast("long"))
    return records.groupBy(*keys).agg(total.alias("total_time"))


def total_per_day(records: DataFrame, period: Period, keys: Sequence[str] = USER) -> DataFrame:
    return sums(in_period(records, period), [*keys, "date"], "total")


def total_per_week_in_range(
    records: DataFrame, begin: dt.date, end: dt.date, keys: Sequence[str] = USER
) -> DataFrame:
    """Monday weeks touched by ``begin .. end``; ``end`` and the days before ``begin`` add nothing."""
    kept = in_period(records, Period.until(begin, end))
    return sums(kept, [*keys, cal.monday(F.col("date")).alias("week_start")], "total")


def total_per_month(records: DataFrame, period: Period, keys: Sequence[str] = USER) -> DataFrame:
    month = F.trunc("date", "month").alias("month")
    totals = sums(in_period(records, period), [*keys, month], "total")
    return totals.withColumn("month", F.date_format("month", cal.MONTH_FORMAT))


def total_per_year(records: DataFrame, period: Period, keys: Sequence[str] = USER) -> DataFrame:
    year = F.year("date").alias("year")
    totals = sums(in_period(records, period), [*keys, year], "total")
    return totals.withColumn("year", F.col("year").cast("string"))


def time_per_task(records: DataFrame, as_of: dt.date, keys: Sequence[str] = USER) -> DataFrame:
    """Time per task on one day, longest first."""
    totals = sums(in_period(records, Period.day(as_of)), [*keys, "task_name"])
    totals = totals.withColumn("time", duration_text(F.col("total_time")))
    return ordered(by_user(totals, keys), keys, F.desc("total_time"), "task_name")


def longest_first(total: Column, date: Column) -> Column:
    """One long that ranks days by total, earlier dates first among equals: the total in the
    high bits, the day number (below 2^20 for any usable date) taken off it. Unlike a struct
    it fits the fixed-width buffer of a hash aggregation."""
    return total * (1 << 20) - F.unix_date(date)


def longest_day(records: DataFrame, keys: Sequence[str] = USER) -> DataFrame:
    """The day with the highest total, the earliest one when several tie."""
    days = sums(records, [*keys, "date"]).filter(F.col("total_time").isNotNull())
    best = days.groupBy(*keys).agg(
        F.max_by("date", longest_first(F.col("total_time"), F.col("date"))).alias("date"),
        F.max("total_time").alias("total_time"),
    )
    return best.withColumn("time", duration_text(F.col("total_time")))


def _mean_of(totals: DataFrame, keys: Sequence[str], alias: str) -> DataFrame:
    """Mean of group totals; groups without a total do not count, no group at all gives 0."""
    mean = F.try_divide(F.sum("total_time").cast("double"), F.count("total_time").cast("double"))
    return totals.groupBy(*keys).agg(F.coalesce(mean, F.lit(0.0)).alias(alias))


def average_day(
    records: DataFrame, period: Period | None = None, keys: Sequence[str] = USER
) -> DataFrame:
    """Mean total of the days worked, over all time or one period."""
    if period is not None:
        records = in_period(records, period)
    means = _mean_of(sums(records, [*keys, "date"]), keys, "mean_s")
    return means.withColumn("time", duration_text(F.col("mean_s")))


def mean_per_period(
    records: DataFrame, grain: str, as_of: dt.date, keys: Sequence[str] = USER
) -> DataFrame:
    """Mean total per day, week or month worked in the year of ``as_of``; per year over all time."""
    if grain not in _GRAINS:
        raise ValueError(f"grain must be day, week, month or year, not {grain!r}")
    if grain != "year":
        records = in_period(records, Period.year(as_of))
    period = _GRAINS[grain](F.col("date")).alias("period")
    return _mean_of(sums(records, [*keys, period]), keys, f"mean_{grain}")


def average_per_weekday(
    records: DataFrame, period: Period, keys: Sequence[str] = USER
) -> DataFrame:
    """Mean total per weekday (0 is Sunday) over the days actually worked."""
    days = sums(in_period(records, period), [*keys, "date"])
    weekday = cal.weekday_from_sunday(F.col("date")).cast("long").alias("day_of_week")
    means = days.groupBy(*keys, weekday).agg(
        F.try_divide(
            F.sum("total_time").cast("double"), F.count("total_time").cast("double")
        ).alias("mean_s")
    )
    return means


def date_bounds(records: DataFrame, keys: Sequence[str] = USER) -> DataFrame:
    return records.groupBy(*keys).agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def task_list(
    records: DataFrame, skip_names: Sequence[str] = (), keys: Sequence[str] = USER
) -> DataFrame:
    tasks = records.select(*keys, "task_name").distinct()
    if skip_names:
        tasks = tasks.filter(~F.col("task_name").isin(*skip_names))
    return tasks


def open_records(records: DataFrame, keys: Sequence[str] = USER) -> DataFrame:
    """Count, running records and total side by side, with the status line a person reads."""
    totals = records.groupBy(*keys).agg(
        record_count(records).alias("count"),
        open_count(records).alias("open_count"),
        F.sum("elapsed_s").alias("total_time"),
    )
    return totals.withColumn("status", status_line(F.col("count"), F.col("total_time")))


def status_line(count: Column, total: Column, max_unit: str = "hour") -> Column:
    """``2 timers (00:10:00).``; a single record that still runs reads ``(ongoing)``."""
    timers = F.concat(count.cast("string"), F.when(count > 1, F.lit(" timers")).otherwise(F.lit(" timer")))
    elapsed = duration_text(F.coalesce(total, F.lit(0).cast("long")), max_unit)
    detail = (
        F.when(count == 0, F.lit("."))
        .when(total.isNull() & (count == 1), F.lit(" (ongoing)."))
        .otherwise(F.concat(F.lit(" ("), elapsed, F.lit(").")))
    )
    return F.concat(timers, detail)


def period_rows(
    records: DataFrame, period: Period, task: str | None = None
) -> DataFrame:
    """The plain records of a period, optionally of one task."""
    kept = in_period(records, period)
    return kept if task is None else kept.filter(F.col("task_name") == task)


def year_report(
    records: DataFrame, period: Period, min_days: int | None = None, keys: Sequence[str] = USER
) -> DataFrame:
    """Days done and total per task; ``min_days`` keeps the tasks done on more days than that."""
    report = records.transform(lambda frame: in_period(frame, period))
    days = report.groupBy(*keys, "task_name", "date").agg(F.sum("elapsed_s").alias("_day_s"))
    report = days.groupBy(*keys, "task_name").agg(
        F.count(F.lit(1)).alias("days_done"), F.sum("_day_s").alias("total_time")
    )
    if min_days is not None:
        report = report.filter(F.col("days_done") > min_days)
    return report.withColumn("total", duration_text(F.col("total_time"), "day"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table, and whether it is empty; an empty table has its row too."""
    counts = [
        frame.groupBy().agg(F.count(F.lit(1)).alias("count")).select(
            F.lit(name).alias("table_name"), "count", (F.col("count") == 0).alias("is_empty")
        )
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def totals_of_requests(
    records: DataFrame, requests: DataFrame, keys: Sequence[str] = USER
) -> DataFrame:
    """``with_span(requests)`` and the ``count`` and ``total_time`` of each request's own records.

    Every request is two look-ups in the running sums of its keys, at its last day and at the day
    before its first, so long spans cost what short ones do. The running sums have one row for each
    day worked or asked for, however many records or requests there are. A request with a problem
    has NULL sums, one without records 0, and so has one that ends before it begins. Records without
    a date are in no span.
    """
    if not keys:
        raise ValueError("requests are matched to records by at least one key")
    asked = with_span(requests).withColumn("before", F.date_sub("first", 1))
    daily = records.filter(F.col("date").isNotNull()).select(
        *keys, "date", F.lit(1).cast("long").alias("count"), F.coalesce("elapsed_s", F.lit(0)).alias("total")
    )
    nothing = [F.lit(0).cast("long").alias(name) for name in ("count", "total")]
    dates = asked.filter(F.col("problem").isNull()).select(
        *keys, F.explode(F.array("before", "last")).alias("date"), *nothing
    )
    days = daily.unionByName(dates).groupBy(*keys, "date").agg(
        F.sum("count").alias("count"), F.sum("total").alias("total")
    )
    so_far = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    running = days.select(
        *keys, "date", F.struct(F.sum("count").over(so_far).alias("count"), F.sum("total").over(so_far).alias("total")).alias("sums")
    )
    for day, name in (("last", "_until"), ("before", "_before")):
        side = running.select(*keys, F.col("date").alias(day), F.col("sums").alias(name))
        asked = asked.join(side, [*keys, day], "left")

    def within(value: str) -> Column:
        found = F.coalesce(F.col(f"_until.{value}") - F.col(f"_before.{value}"), F.lit(0))
        return F.when(F.col("problem").isNull(), F.greatest(found, F.lit(0)).cast("long"))

    shown = [*requests.columns, "first", "last", "problem"]
    return asked.select(*shown, within("count").alias("count"), within("total").alias("total_time"))
