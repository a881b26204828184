"""Shares: how a total splits over tasks or subtasks, per period."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions import calendar as cal
from chronofold.functions.durations import scaled_duration_text, split_text, whole_div
from chronofold.plans.period import Period
from chronofold.plans.series import USER, ordered, sums, with_share
from chronofold.sources.tables import in_period


def task_ratio(
    records: DataFrame, period: Period | None = None, keys: Sequence[str] = USER
) -> DataFrame:
    """``task_name, total_time, ratio``, largest share first."""
    if period is not None:
        records = in_period(records, period)
    totals = sums(records, [*keys, "task_name"])
    shares = with_share(totals, keys, "total_time", "whole").drop("whole")
    return ordered(shares, keys, F.desc("ratio"), "task_name")


def task_ratio_formatted(
    records: DataFrame, period: Period | None = None, keys: Sequence[str] = USER
) -> DataFrame:
    """``task_ratio`` without the tasks that have no finished record, with split durations."""
    shares = task_ratio(records, period, keys).filter(F.col("total_time").isNotNull())
    return shares.select(
        *keys,
        F.col("task_name").alias("task"),
        F.col("total_time").alias("time"),
        split_text(scaled_duration_text(F.col("total_time"))).alias("formatted"),
        "ratio",
    )


def _share_by(
    records: DataFrame, group: Sequence, names: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Task totals and shares inside every period."""
    totals = sums(records, [*keys, *group, "task_name"], "task_total")
    return with_share(totals, [*keys, *names], "task_total", "period_total", apart=bool(keys))


def task_ratio_per_day(
    records: DataFrame, period: Period, keys: Sequence[str] = USER
) -> DataFrame:
    shares = _share_by(in_period(records, period), ["date"], ["date"], keys)
    return shares.select(
        *keys,
        "date",
        "task_name",
        F.col("period_total").alias("time_per_day"),
        F.col("task_total").alias("time_per_task"),
        "ratio",
    )


def full_range_weeks(begin: dt.date, end: dt.date) -> list[int]:
    """Week groups of ``begin .. end`` (end excluded) that have all seven days."""
    last = end - dt.timedelta(days=1)
    offset = 1 if begin.weekday() == 0 else 0
    first_monday = begin - dt.timedelta(days=begin.weekday())
    weeks = (last - first_monday).days // 7 + 1
    full = []
    for place in range(weeks):
        monday = first_monday + dt.timedelta(days=7 * place)
        if monday >= begin and monday + dt.timedelta(days=6) <= last:
            full.append(place + offset)
    return full


def task_ratio_weeks(
    records: DataFrame,
    begin: dt.date,
    end: dt.date,
    include_partial: bool = True,
    keys: Sequence[str] = USER,
) -> DataFrame:
    """Task shares per week group of a half-open range; running records count 0 seconds."""
    week = cal.range_week(F.col("date"), cal.date_lit(begin))
    kept = in_period(records, Period.until(begin, end)).withColumn(
        "elapsed_s", F.coalesce("elapsed_s", F.lit(0).cast("long"))
    )
    if not include_partial:
        kept = kept.filter(week.isin(full_range_weeks(begin, end)))
    shares = _share_by(kept, [week.alias("week_group")], ["week_group"], keys)
    return shares.select(
        *keys,
        "week_group",
        "task_name",
        "task_total",
        F.col("period_total").alias("week_total"),
        "ratio",
    )


def task_month_in_year(records: DataFrame, year: int, keys: Sequence[str] = USER) -> DataFrame:
    month = F.trunc("date", "month").alias("month")
    shares = _share_by(in_period(records, Period.year(year)), [month], ["month"], keys)
    return shares.select(
        *keys,
        F.date_format("month", cal.MONTH_FORMAT).alias("month"),
        "task_name",
        "task_total",
        F.col("period_total").alias("month_total"),
        "ratio",
    )


def subtask_ratio(
    records: DataFrame, task: str, period: Period | None = None, keys: Sequence[str] = USER
) -> DataFrame:
    """Split of one task over its subtasks; records without a subtask form their own group."""
    if not task:
        raise KeyError("a subtask ratio needs a task")
    records = records.filter(F.col("task_name") == task)
    if period is not None:
        records = in_period(records, period)
    totals = sums(records, [*keys, "task_name", "subtask"], "subtask_total")
    shares = with_share(totals, [*keys, "task_name"], "subtask_total", "whole").drop("whole")
    return ordered(shares, keys, F.desc("ratio"), F.asc_nulls_first("subtask"))


def task_ratio_by(
    records: DataFrame, grain: str, period: Period, keys: Sequence[str] = USER
) -> DataFrame:
    """Task shares per day, week, month or year of a closed range.

    Weeks are numbered within their year; the year is part of the name only when the range
    spans two years, so a week that is cut by New Year gives two groups.
    """
    day, place = F.col("date"), F.col("period")
    if grain == "week":
        # Year and week in one number; the name is spelled out once per result row.
        number = F.year(day) * 100 + cal.year_week_from_zero(day)
        name = cal.two_digits(place % 100)
        if period.first.year != period.last.year:
            name = F.concat_ws("-", whole_div(place, 100).cast("string"), name)
    elif grain in ("day", "month", "year"):
        number = day if grain == "day" else F.trunc(day, grain)
        name = cal.period_text(grain, place)
    else:
        raise ValueError(f"grain must be day, week, month or year, not {grain!r}")
    shares = _share_by(in_period(records, period), [number.alias("period")], ["period"], keys)
    shares = shares.withColumn("period", name)
    return shares.select(
        *keys, "period", "task_name", "period_total", "task_total", "ratio"
    )
