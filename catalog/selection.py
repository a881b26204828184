"""Scans, filters, joins and the plain record reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqltext import iso
from catalog.views import (
    ORDERS_AS_OF,
    RO,
    guid_sql,
    order_records,
)
from chronofold.functions.keys import stable_guid, stable_id
from chronofold.operators import totals
from chronofold.plans import period as periods
from chronofold.plans import selection
from chronofold.plans.selection import RecordFilter, select_records
from chronofold.sources.tables import WorkLog

_ROW = ("record_id", "user_id", "date", "elapsed_s")
_ROW_SQL = f"record_id, user_id, {iso('date')} as date, elapsed_s"


def key_sql(*parts: str) -> str:
    return f"cast('0x' || substr({guid_sql(*parts)}, 1, 15) as bigint)"


def star_schema(records: DataFrame) -> WorkLog:
    """Split named records into facts and dimensions."""
    task, subtask, tag = F.col("task_name"), F.col("subtask"), F.col("tag")
    facts = records.withColumns(
        {"task_id": stable_id(task, subtask), "tag_id": F.when(tag.isNotNull(), stable_id(tag))}
    ).drop("task_name", "subtask", "tag")
    tasks = records.select("task_name", "subtask").distinct()
    tags = records.select("tag").filter(tag.isNotNull()).distinct()
    return WorkLog(
        records=facts,
        tasks=tasks.select(
            stable_id(task, subtask).alias("task_id"), "task_name", "subtask", stable_guid(task, subtask).alias("guid")
        ),
        tags=tags.select(stable_id(tag).alias("tag_id"), "tag", stable_guid(tag).alias("guid")),
    )


def order_log(spark: SparkSession, sf_dir: str) -> WorkLog:
    return star_schema(order_records(spark, sf_dir, with_tag=True))


@query(
    "scan_records",
    f"with {RO} select record_id, user_id, {iso('date')} as date, task_name, subtask, tag, elapsed_s from ro",
)
def scan_records(spark, sf_dir):
    return order_records(spark, sf_dir, with_tag=True).select(
        "record_id", "user_id", "date", "task_name", "subtask", "tag", "elapsed_s"
    )


@query(
    "dim_tasks",
    f"""with {RO} select distinct task_name, subtask, {guid_sql('task_name', 'subtask')} as guid
        from ro""",
)
def dim_tasks(spark, sf_dir):
    tasks = star_schema(order_records(spark, sf_dir).withColumn("tag", F.lit(None).cast("string"))).tasks
    return tasks.select("task_name", "subtask", "guid").orderBy("guid")


@query(
    "dim_tags",
    f"with {RO} select distinct tag, {guid_sql('tag')} as guid from ro where tag is not null",
)
def dim_tags(spark, sf_dir):
    return order_log(spark, sf_dir).tags.select("tag", "guid")


@query(
    "join_tasks",
    f"with {RO} select record_id, task_name, subtask, elapsed_s from ro",
)
def join_tasks(spark, sf_dir):
    log = order_log(spark, sf_dir)
    joined = selection.join_tasks(log.records, log.tasks)
    return joined.select("record_id", "task_name", "subtask", "elapsed_s")


@query("join_tags_left", f"with {RO} select record_id, tag, elapsed_s from ro")
def join_tags_left(spark, sf_dir):
    log = order_log(spark, sf_dir)
    return selection.join_tags(log.records, log.tags).select("record_id", "tag", "elapsed_s")


# Name, client request, condition of the twin.
_FILTERS = (
    ("filter_period_day", {"day": "1998-03-02"}, "date = date '1998-03-02'"),
    ("filter_period_week", {"week": "1998-03-04"}, "date between date '1998-03-04' and date '1998-03-10'"),
    ("filter_period_month", {"month": "1998-03"}, "strftime(date, '%Y-%m') = '1998-03'"),
    ("filter_period_year", {"year": "1998"}, "year(date) = 1998"),
    (
        "filter_period_range",
        {"rangeBeginning": "1997-12-15", "rangeEnding": "1998-02-10"},
        "date between date '1997-12-15' and date '1998-02-10'",
    ),
    (
        "filter_period_week_pair",
        {"weekStart": "1998-03-02", "weekEnd": "1998-03-08", "year": "1997"},
        "date between date '1998-03-02' and date '1998-03-08'",
    ),
    ("filter_task", {"task": "2-HIGH"}, "task_name = '2-HIGH'"),
    ("filter_subtask", {"task": "2-HIGH", "subtask": "F"}, "task_name = '2-HIGH' and subtask = 'F'"),
    ("filter_subtask_null", {"task": "2-HIGH", "subtask": "None"}, "task_name = '2-HIGH' and subtask is null"),
    ("filter_tag", {"tag": "MACHINERY", "year": "1998"}, "tag = 'MACHINERY' and year(date) = 1998"),
)


def _register_filter(name: str, request: dict, condition: str) -> None:
    @query(name, f"with {RO} select {_ROW_SQL} from ro where {condition}")
    def run(spark, sf_dir):
        wanted = RecordFilter.from_request(request)
        if wanted.task is None and wanted.tag is None:
            return selection.where(order_records(spark, sf_dir), wanted).select(*_ROW)
        return select_records(order_log(spark, sf_dir), wanted).select(*_ROW)


for _entry in _FILTERS:
    _register_filter(*_entry)


# Name, period, condition of the twin: reports over the rows of one task.
_REPORTS = (
    ("report_last_year", periods.last_year(ORDERS_AS_OF), "year(date) = 2000"),
    ("report_this_year", periods.this_year(ORDERS_AS_OF), "year(date) = 2001"),
    (
        "report_to_q3",
        periods.year_to_third_quarter(2000),
        "date between date '2000-01-01' and date '2000-09-30'",
    ),
    (
        "report_ytd_last_year",
        periods.last_year_to_date(ORDERS_AS_OF),
        "date between date '2000-01-01' and date '2001-08-01' - interval 1 year",
    ),
)


def _register_report(name: str, period: periods.Period, condition: str) -> None:
    @query(
        name,
        f"""with {RO} select record_id, user_id, task_name, {iso('date')} as date, elapsed_s
            from ro where task_name = '1-URGENT' and {condition}""",
    )
    def run(spark, sf_dir):
        rows = totals.period_rows(order_records(spark, sf_dir), period, "1-URGENT")
        return rows.select("record_id", "user_id", "task_name", "date", "elapsed_s")


for _entry in _REPORTS:
    _register_report(*_entry)


@query(
    "week_rows_offset",
    f"""with {RO} select {_ROW_SQL} from ro
        where date between date '2001-08-06' - 7 and date '2001-08-05'""",
)
def week_rows_offset(spark, sf_dir):
    """The current week as the offset query asks for it: Monday a week back, Sunday ahead."""
    week = periods.week_between_offsets(ORDERS_AS_OF, monday_days=-7, sunday_days=0)
    return totals.period_rows(order_records(spark, sf_dir), week).select(*_ROW)


# Name, period, condition: counts and totals of the current spans per user.
_SPANS = (
    ("count_today", periods.today(ORDERS_AS_OF), "date = date '2001-08-01'"),
    ("count_this_week", periods.this_week(ORDERS_AS_OF), "date > date '2001-07-29'"),
    (
        "count_this_month",
        periods.this_month(dt.date(2001, 7, 15)),
        "strftime(date, '%Y-%m') = '2001-07'",
    ),
    ("count_this_year", periods.this_year(ORDERS_AS_OF), "year(date) = 2001"),
)


def _register_span(name: str, period: periods.Period, condition: str) -> None:
    @query(
        name,
        f"with {RO} select user_id, count(*) as count from ro where {condition} group by user_id",
    )
    def run(spark, sf_dir):
        return totals.timer_count(totals.period_rows(order_records(spark, sf_dir), period))


for _entry in _SPANS:
    _register_span(*_entry)
