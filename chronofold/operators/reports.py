"""Composed reports: summaries, period pages, custom reports and the text summary.

Each report answers for every user at once, one row per user. Their parts are joined on
``keys``, so unlike the single operators they need at least one key column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import calendar as cal
from chronofold.functions.durations import (
    duration_text,
    scaled_duration_text,
    split_text,
)
from chronofold.operators import charts, search, totals
from chronofold.operators.ratios import subtask_ratio, task_ratio, task_ratio_formatted
from chronofold.operators.search import record_columns
from chronofold.operators.streaks import streaks
from chronofold.operators.weeks import week_points_of_year
from chronofold.plans import period as periods
from chronofold.plans.daily import record_count
from chronofold.plans.period import Period
from chronofold.plans.selection import RecordFilter, join_tasks, select_records
from chronofold.plans.series import USER
from chronofold.sources.session import kept
from chronofold.sources.tables import WorkLog, within_any

# The largest unit a span's total is written in, and the chart titles.
_MAX_UNIT = {"day": "hour", "week": "hour", "month": "day", "year": "day"}
_LINE_TITLE = "Total time for {grain}"
_STACKED_TITLE = "Task ratio per {grain}"


def _distinct_small(number: Column) -> Column:
    """Aggregate: how many different numbers below 64 occur, as a bit set in one long."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("int"))
    return F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0))


def summaries(
    records: DataFrame, spans: Mapping[str, Period], as_of: dt.date, keys: Sequence[str] = USER
) -> DataFrame:
    """Count and total of several spans and the means of the year of ``as_of``, in one pass.

    Records collapse to one row per user and day first. All spans and means are then
    conditional aggregates over those days, so no record is read or shuffled twice.
    """
    wanted = within_any(records, [*spans.values(), Period.year(as_of)])
    return _days(wanted, keys).groupBy(*keys).agg(*_summary_columns(spans, as_of))


def _shared(
    records: DataFrame, keys: Sequence[str], spans: Sequence[Period]
) -> DataFrame:
    """Sums by user, day and task, from one scan of the records of these spans, for all parts of
    a page. They are narrow and at most a row for each task of a day, so that the parts, which
    each read them again, cost little next to the scan."""
    records = within_any(records, list(spans))
    sums = records.groupBy(*keys, "date", "task_name").agg(
        F.sum("elapsed_s").alias("elapsed_s"), record_count(records).alias("record_count")
    )
    return kept(sums, "report")


def _days(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    return records.groupBy(*keys, "date").agg(
        record_count(records).alias("_count"), F.sum("elapsed_s").alias("_total")
    )


def _summary_columns(spans: Mapping[str, Period], as_of: dt.date) -> list[Column]:
    """Aggregates over ``_days``."""
    year = Period.year(as_of)
    day = F.col("date")
    aggregates = []
    for name, span in spans.items():
        for value, column in (("count", "_count"), ("time", "_total")):
            amount = F.sum(F.when(span.contains(day), F.col(column)))
            aggregates.append(F.coalesce(amount, F.lit(0).cast("long")).alias(f"{name}_{value}"))
    worked = year.contains(day) & F.col("_total").isNotNull()
    of_year = F.sum(F.when(worked, F.col("_total"))).cast("double")
    groups = {
        "day": F.count_if(worked),
        "week": _distinct_small(F.when(worked, cal.year_week_from_zero(day))),
        "month": _distinct_small(F.when(worked, F.month(day))),
    }
    for name, count in groups.items():
        mean = F.try_divide(of_year, count.cast("double"))
        aggregates.append(F.coalesce(mean, F.lit(0.0)).alias(f"mean_{name}"))
    return aggregates


def _resume(name: str) -> Column:
    """Count, time and mean of one span; a year has no mean."""
    fields = [
        F.col(f"{name}_count").alias("count"),
        split_text(duration_text(F.col(f"{name}_time"), _MAX_UNIT[name])).alias("time"),
    ]
    if name == "day":
        fields.append(split_text(duration_text(F.col("mean_day"))).alias("mean"))
    elif name != "year":
        fields.append(split_text(scaled_duration_text(F.col(f"mean_{name}"))).alias("mean"))
    return F.struct(*fields)


def home_summary(records: DataFrame, as_of: dt.date, keys: Sequence[str] = USER) -> DataFrame:
    """Today, this week, this month and this year side by side."""
    spans = {
        "day": periods.today(as_of),
        "week": periods.this_week(as_of),
        "month": periods.this_month(as_of),
        "year": periods.this_year(as_of),
    }
    rows = summaries(records, spans, as_of, keys)
    return rows.select(
        *keys,
        _resume("day").alias("daily"),
        _resume("week").alias("weekly"),
        _resume("month").alias("monthly"),
        _resume("year").alias("yearly"),
    )


def _with_resume(
    page: DataFrame, records: DataFrame, name: str, span: Period, as_of: dt.date, keys: Sequence[str]
) -> DataFrame:
    """Put the summary before the page; users active in the year but not in the period stay."""
    rows = summaries(records, {name: span}, as_of, keys).select(*keys, _resume(name).alias("resume"))
    return rows.join(page, list(keys), "left")


def page_day(
    records: DataFrame, day: dt.date | None, as_of: dt.date, keys: Sequence[str] = USER
) -> DataFrame:
    """Summary of the day and its task shares, largest first."""
    span = Period.day(day or as_of)
    records = _shared(records, keys, [span, Period.year(as_of)])
    shares = task_ratio_formatted(records, span, keys)
    entry = F.struct("task", "time", "formatted", "ratio")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("ratio")).alias("_rank"), F.col("task"), entry.alias("_entry"))))
    detail = shares.groupBy(*keys).agg(F.transform(ranked, lambda row: row["_entry"]).alias("detail"))
    page = _with_resume(detail, records, "day", span, as_of, keys)
    empty = F.array().cast(detail.schema["detail"].dataType)
    return page.select(*keys, "resume", F.coalesce("detail", empty).alias("detail"))


def _chart_page(
    records: DataFrame,
    name: str,
    grain: str,
    span: Period,
    labels: Column,
    as_of: dt.date,
    keys: Sequence[str],
    resume_span: Period | None,
    line_period: Period | None,
    known_until: int | None,
) -> DataFrame:
    pair = charts.chart_pair(records, grain, span, line_period, known_until, keys)
    columns = [*keys]
    page = pair
    if resume_span is not None:
        page = _with_resume(pair, records, name, resume_span, as_of, keys)
        columns.append("resume")
    size = cal.label_count(grain, span.first, span.last)
    no_task = F.array().cast(pair.schema["stacked"].dataType)
    no_line = F.sequence(F.lit(0), F.lit(size - 1))
    no_line = F.transform(
        no_line, lambda at: F.lit(0).cast("long") if known_until is None else F.when(at < known_until, F.lit(0).cast("long"))
    )
    return page.select(
        *columns,
        labels.alias("labels"),
        F.coalesce("stacked", no_task).alias("stacked"),
        F.coalesce("line", no_line).alias("line"),
    )


def page_week(
    records: DataFrame, week: dt.date | None, as_of: dt.date, keys: Sequence[str] = USER
) -> DataFrame:
    """Seven days: shares per task and day, total per day. No summary without a date."""
    span = Period.week_around(week or as_of)
    resume = Period.week_from(week) if week else None
    if resume is not None:  # two parts
        records = _shared(records, keys, [span, resume, Period.year(as_of)])
    return _chart_page(
        records,
        "week",
        "day",
        span,
        cal.week_labels(cal.date_lit(span.first)),
        as_of,
        keys,
        resume,
        None,
        charts.known_places("day", span, as_of),
    )


def page_month(
    records: DataFrame, month: str | None, as_of: dt.date, keys: Sequence[str] = USER
) -> DataFrame:
    """ISO weeks of a month: shares per task and week, total per week.

    Without a month the line stops before ``as_of``, weeks not begun by then stay NULL.
    """
    span = Period.month(month or as_of)
    line_period, known = None, None
    if month is None:
        line_period = Period.until(span.first, as_of)
        known = charts.known_places("week", span, line_period.last)
    else:  # two parts
        records = _shared(records, keys, [span, Period.year(as_of)])
    return _chart_page(
        records,
        "month",
        "week",
        span,
        cal.month_labels(cal.date_lit(span.first)),
        as_of,
        keys,
        span if month else None,
        line_period,
        known,
    )


def page_year(
    records: DataFrame, year: int | None, as_of: dt.date, keys: Sequence[str] = USER
) -> DataFrame:
    """Twelve months: shares per task and month, total per month, and the weekly bars."""
    span = Period.year(year or as_of)
    records = _shared(records, keys, [span, Period.year(as_of)])
    page = _chart_page(
        records,
        "year",
        "month",
        span,
        cal.year_labels(cal.date_lit(span.first)),
        as_of,
        keys,
        span if year else None,
        None,
        charts.known_places("month", span, as_of),
    )
    weeks = week_points_of_year(records, span.first.year, keys).drop("year")
    size = cal.label_count("week", span.first, span.last)
    no_weeks = F.transform(
        F.sequence(F.lit(1), F.lit(size)),
        lambda week: F.struct(week.cast("long").alias("x"), F.lit(0).cast("long").alias("y")),
    )
    return page.join(weeks, list(keys), "left").withColumn("weeks", F.coalesce("points", no_weeks)).drop("points")


def page(
    records: DataFrame, request: Mapping, as_of: dt.date, keys: Sequence[str] = USER
) -> DataFrame:
    """The page of the one period a request names, or of ``period`` with an optional ``date``."""
    if "period" in request:
        named = periods.named_period(request["period"], as_of, request.get("date"))
        date = request.get("date")
        name, first = request["period"], named.first
        if name == "day":
            return page_day(records, first, as_of, keys)
        if name == "week":
            return page_week(records, first if date else None, as_of, keys)
        if name == "month":
            return page_month(records, first.strftime("%Y-%m") if date else None, as_of, keys)
        return page_year(records, first.year if date else None, as_of, keys)
    if "day" in request:
        return page_day(records, periods.as_date(request["day"]), as_of, keys)
    if "week" in request or "weekStart" in request:
        return page_week(records, periods.as_date(request.get("week", request.get("weekStart"))), as_of, keys)
    if "month" in request:
        return page_month(records, request["month"], as_of, keys)
    if "year" in request:
        return page_year(records, int(request["year"]), as_of, keys)
    raise KeyError("the request names no page")


def custom_report(
    log: WorkLog, request: Mapping, as_of: dt.date, keys: Sequence[str] = USER
) -> dict[str, DataFrame]:
    """The elements a request lists in ``stats``, each as a frame, plus matching ``logs``.

    A request that is only a period gives that period's page.
    """
    names = set(request) - _NOT_SPANS
    pages = ({"day"}, {"week"}, {"weekStart"}, {"month"}, {"year"}, {"period"}, {"period", "date"})
    if names in pages and "stats" not in request:
        records = join_tasks(log.records, log.tasks)
        report = {"page": page(records, request, as_of, keys)}
        if request.get("logs"):
            _, period = periods.resolve(request, as_of)
            report |= _logs(log, RecordFilter(period=period), request)
        return report
    if "rangeBeginning" in request and "stats" not in request:
        raise KeyError("a range needs a list of the elements to return")
    period = _report_period(log, request, as_of)
    wanted = replace(RecordFilter.from_request(request), period=period)
    chosen = select_records(log, wanted)
    if "task_name" not in chosen.columns:
        chosen = join_tasks(chosen, log.tasks)
    # Everything but the logs is sums of this one aggregate.
    records = chosen.groupBy(*keys, "date", "task_name", "subtask").agg(
        F.sum("elapsed_s").alias("elapsed_s"), record_count(chosen).alias("record_count")
    )
    elements = request.get("stats", ())
    if len(elements) > 1:
        records = kept(records, "report")
    report = {}
    for element in elements:
        kind = element["element"]
        if kind == "timer-info":
            report[kind] = records.groupBy(*keys).agg(
                record_count(records).alias("count"),
                split_text(duration_text(F.coalesce(F.sum("elapsed_s"), F.lit(0).cast("long")), "day")).alias("time"),
            )
        elif kind == "task-ratio":
            report[kind] = task_ratio_formatted(records, None, keys)
        elif kind == "subtask-ratio":
            report[kind] = subtask_ratio(records, request.get("task"), None, keys)
        elif kind in ("line-chart", "stacked-column-chart"):
            grain = element.get("column-period")
            if grain is None:
                raise KeyError(f"{kind} needs a column-period")
            labels = cal.range_labels(grain, cal.date_lit(period.first), cal.date_lit(period.last))
            if kind == "line-chart":
                series = charts.line_chart(records, grain, period, None, keys)
                title = _LINE_TITLE.format(grain=grain)
            else:
                series = charts.stacked_chart(records, grain, period, keys)
                title = _STACKED_TITLE.format(grain=grain)
            report[f"{kind}:{grain}"] = series.withColumns(
                {"labels": labels, "title": F.lit(title)}
            )
        else:
            raise KeyError(f"unknown element {kind!r}")
    if request.get("logs"):
        report |= _logs(log, wanted, request)
    return report


#: Entries of a request that are no time span and no filter.
_NOT_SPANS = {"logs", "page", "page_size", "stats"}


def _report_period(log: WorkLog, request: Mapping, as_of: dt.date) -> Period | None:
    """The period of every part of a report. A tag alone covers the first to the last date on
    record; other requests without a span cover everything."""
    try:
        return periods.resolve(request, as_of)[1]
    except KeyError:
        charts_asked = any("column-period" in e for e in request.get("stats", ()))
        if "tag" not in request or not charts_asked:
            return None
    bounds = log.records.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    return None if bounds["first"] is None else Period(bounds["first"], bounds["last"])


def _logs(log: WorkLog, wanted: RecordFilter, request: Mapping) -> dict[str, DataFrame]:
    """The records of a report: all of them, or one page and the number of pages."""
    found = record_columns(select_records(log, wanted, with_names=True))
    if "page_size" not in request:
        return {"logs": found}
    size = int(request["page_size"])
    return {
        "logs": search.page(found, int(request.get("page", 1)), size),
        "log_pages": search.page_count(found, size),
    }


def text_summary(
    records: DataFrame,
    as_of: dt.date,
    keys: Sequence[str] = USER,
    all_streaks: bool = False,
    weeks: int | None = None,
) -> DataFrame:
    """The summary a person reads: today with its tasks and streaks, average and longest day,
    this week and this year. ``all_streaks`` adds the streaks of every task, ``weeks`` the totals
    of so many weeks before this one, both as lines of text."""
    spans = {
        "day": periods.today(as_of),
        "week": periods.this_week(as_of),
        "year": periods.this_year(as_of),
    }
    day, total = F.col("date"), F.col("_total")
    lines = _days(records, keys).groupBy(*keys).agg(
        *_summary_columns(spans, as_of),
        F.max(total).alias("_longest_s"),
        F.max_by(day, totals.longest_first(total, day)).alias("_longest_day"),
    )

    def line(title: str, name: str) -> Column:
        status = totals.status_line(
            F.col(f"{name}_count"), F.col(f"{name}_time"), "day" if name == "year" else "hour"
        )
        return F.concat(F.lit(f"{title} : "), status)

    shares = task_ratio(records, periods.today(as_of), keys).filter(F.col("total_time").isNotNull())
    # Streaks only of what was worked on today; the list is one row per user and task of a day.
    names = [*keys, "task_name"]
    worked = records.join(shares.select(*names), names, "left_semi")
    with_runs = shares.join(streaks(worked, None, keys), names)
    best = F.when(F.col("current_is_longest"), F.lit("(max streak!)")).otherwise(
        F.concat(F.lit("(max : "), F.col("longest_streak").cast("string"), F.lit(")"))
    )
    text = F.concat(
        F.col("task_name"),
        F.lit(" : "),
        duration_text(F.col("total_time")),
        F.lit(" ("),
        F.col("ratio").cast("string"),
        F.lit("%) Current streak : "),
        F.col("current_streak").cast("string"),
        F.lit(" "),
        best,
    )
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("ratio")).alias("rank"), F.col("task_name"), text.alias("text")))
    )
    tasks = with_runs.groupBy(*keys).agg(F.transform(ranked, lambda row: row["text"]).alias("tasks"))
    maximum = F.concat(
        duration_text(F.col("_longest_s")),
        F.lit(" ("),
        F.date_format("_longest_day", cal.DAY_FORMAT),
        F.lit(")"),
    )
    joined = lines.join(tasks, list(keys), "left")
    extra = []
    if all_streaks:
        joined = joined.join(_streak_lines(records, keys), list(keys), "left")
        extra.append(F.coalesce("streaks", F.array().cast("array<string>")).alias("streaks"))
    if weeks is not None:
        joined = joined.join(_week_lines(records, as_of, weeks, keys), list(keys), "left")
        extra.append(F.coalesce("past_weeks", F.array().cast("array<string>")).alias("past_weeks"))
    return joined.select(
        *keys,
        line("This day", "day").alias("today"),
        F.coalesce("tasks", F.array().cast("array<string>")).alias("tasks"),
        F.coalesce(
            F.when(F.col("mean_day") > 0, duration_text(F.col("mean_day"))), F.lit("No data yet.")
        ).alias("average_day"),
        F.coalesce(maximum, F.lit("No data yet.")).alias("maximum"),
        line("This week", "week").alias("week"),
        line("This year", "year").alias("year"),
        *extra,
    )


def _lines(frame: DataFrame, keys: Sequence[str], order: Column, text: Column, name: str) -> DataFrame:
    ranked = F.array_sort(F.collect_list(F.struct(order.alias("rank"), text.alias("text"))))
    return frame.groupBy(*keys).agg(F.transform(ranked, lambda row: row["text"]).alias(name))


def _streak_lines(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    runs = streaks(records, None, keys)
    text = F.concat(
        F.col("task_name"),
        F.lit(" : "),
        F.col("current_streak").cast("string"),
        F.lit(" (max : "),
        F.col("longest_streak").cast("string"),
        F.lit(")"),
    )
    return _lines(runs, keys, F.col("task_name"), text, "streaks")


def _week_lines(records: DataFrame, as_of: dt.date, weeks: int, keys: Sequence[str]) -> DataFrame:
    """Totals of the weeks before this one, the latest first; weeks without work are left out."""
    monday = Period.week_around(as_of).first
    span = Period.until(monday - dt.timedelta(weeks=weeks), monday)
    week = F.date_sub("date", F.weekday("date")).alias("week")
    sums = within_any(records, [span]).groupBy(*keys, week).agg(F.sum("elapsed_s").alias("total"))
    sums = sums.filter(F.col("total").isNotNull())
    text = F.concat(F.date_format("week", cal.DAY_FORMAT), F.lit(" : "), duration_text(F.col("total")))
    return _lines(sums, keys, -F.unix_date("week"), text, "past_weeks")
