"""Shares of tasks and subtasks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from catalog.registry import query
from catalog.selection import order_log
from catalog.sqltext import iso, parts, percent, scaled, total
from catalog.views import EVENTS_AS_OF, RE, RO, event_records, order_records
from chronofold.operators import ratios
from chronofold.plans import period as periods
from chronofold.plans.period import Period
from chronofold.plans.selection import RecordFilter, select_records


def _task_ratio_sql(view: str, condition: str, keys: str = "user_id, ") -> str:
    over = f"partition by {keys.rstrip(', ')}" if keys else ""
    return f"""with {view}, q as (select {keys}task_name, {total()} as total_time
        from {view[:2]} where {condition} group by {keys}task_name),
        w as (select *, sum(total_time) over ({over}) as whole from q)
        select {keys}task_name, total_time, {percent('total_time', 'whole')} as ratio from w"""


def task_ratio_of_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratios.task_ratio(order_records(spark, sf_dir), Period.year(1998))


query("task_ratio_year", _task_ratio_sql(RO, "year(date) = 1998"))(task_ratio_of_year)


@query("task_ratio_day", _task_ratio_sql(RE, "date = date '2024-01-30'"))
def task_ratio_day(spark, sf_dir):
    return ratios.task_ratio(event_records(spark, sf_dir), periods.today(EVENTS_AS_OF))


@query("task_ratio_week", _task_ratio_sql(RO, "date between date '1998-03-02' and date '1998-03-08'"))
def task_ratio_week(spark, sf_dir):
    return ratios.task_ratio(order_records(spark, sf_dir), Period.week_around("1998-03-05"))


@query("task_ratio_month", _task_ratio_sql(RO, "strftime(date, '%Y-%m') = '1998-03'"))
def task_ratio_month(spark, sf_dir):
    return ratios.task_ratio(order_records(spark, sf_dir), Period.month("1998-03"))


@query("task_ratio_everyone", _task_ratio_sql(RO, "year(date) between 1996 and 1999", keys=""))
def task_ratio_everyone(spark, sf_dir):
    span = Period.between("1996-01-01", "1999-12-31")
    return ratios.task_ratio(order_records(spark, sf_dir), span, keys=())


@query("task_ratio_tag", _task_ratio_sql(RO, "year(date) = 1998 and tag = 'BUILDING'"))
def task_ratio_tag(spark, sf_dir):
    wanted = RecordFilter.from_request({"year": "1998", "tag": "BUILDING"})
    return ratios.task_ratio(select_records(order_log(spark, sf_dir), wanted, with_names=True))


@query(
    "task_ratio_formatted",
    f"""with {RE}, q as (select user_id, task_name, {total()} as t from re group by 1, 2),
        w as (select *, sum(t) over (partition by user_id) as whole from q)
        select user_id, task_name as task, t as time, {parts(scaled('t'))} as formatted,
               {percent('t', 'whole')} as ratio from w where t is not null""",
)
def task_ratio_formatted(spark, sf_dir):
    return ratios.task_ratio_formatted(event_records(spark, sf_dir))


@query(
    "task_ratio_per_day",
    f"""with {RE}, q as (select user_id, date, task_name, {total()} as t from re
          where date between date '2024-01-05' and date '2024-01-20' group by 1, 2, 3),
        w as (select *, {total('t')[5:-11]} over (partition by user_id, date) as whole from q)
        select user_id, {iso('date')} as date, task_name, cast(whole as bigint) as time_per_day,
               t as time_per_task, {percent('t', 'whole')} as ratio from w""",
)
def task_ratio_per_day(spark, sf_dir):
    span = Period.between("2024-01-05", "2024-01-20")
    return ratios.task_ratio_per_day(event_records(spark, sf_dir), span)


@query(
    "task_ratio_per_day_everyone",
    f"""with {RE}, q as (select date, task_name, {total()} as t from re
          where date between date '2024-01-05' and date '2024-01-20' group by 1, 2),
        w as (select *, {total('t')[5:-11]} over (partition by date) as whole from q)
        select {iso('date')} as date, task_name, cast(whole as bigint) as time_per_day,
               t as time_per_task, {percent('t', 'whole')} as ratio from w""",
)
def task_ratio_per_day_everyone(spark, sf_dir):
    """All users together: the days' totals are joined, no task list meets in one window."""
    span = Period.between("2024-01-05", "2024-01-20")
    return ratios.task_ratio_per_day(event_records(spark, sf_dir), span, keys=())


def _week_ratio_sql(condition: str) -> str:
    return f"""with {RO}, s as (select cast(d as date) as d, case when isodow(d) = 1 then 1 else 0 end as m
          from generate_series(timestamp '1998-12-10', timestamp '1999-02-14', interval 1 day) g(d)),
        c as (select d, cast(sum(m) over (order by d) as bigint) as week_group from s),
        k as (select *, count(*) over (partition by week_group) as days from c),
        q as (select user_id, week_group, task_name, {total('coalesce(elapsed_s, 0)')} as task_total
              from ro join k on k.d = ro.date where {condition} group by 1, 2, 3),
        w as (select *, cast(sum(task_total) over (partition by user_id, week_group) as bigint)
              as week_total from q)
        select *, {percent('task_total', 'week_total')} as ratio from w"""


@query("task_ratio_weeks", _week_ratio_sql("true"))
def task_ratio_weeks(spark, sf_dir):
    return ratios.task_ratio_weeks(
        order_records(spark, sf_dir), dt.date(1998, 12, 10), dt.date(1999, 2, 15)
    )


@query("task_ratio_weeks_full", _week_ratio_sql("days = 7"))
def task_ratio_weeks_full(spark, sf_dir):
    return ratios.task_ratio_weeks(
        order_records(spark, sf_dir),
        dt.date(1998, 12, 10),
        dt.date(1999, 2, 15),
        include_partial=False,
    )


@query(
    "task_month_in_year",
    f"""with {RO}, q as (select user_id, strftime(date, '%Y-%m') as month, task_name,
          {total()} as task_total from ro where date >= date '1999-01-01' and date < date '2000-01-01'
          group by 1, 2, 3),
        w as (select *, cast(sum(task_total) over (partition by user_id, month) as bigint)
              as month_total from q)
        select *, {percent('task_total', 'month_total')} as ratio from w""",
)
def task_month_in_year(spark, sf_dir):
    return ratios.task_month_in_year(order_records(spark, sf_dir), 1999)


@query(
    "subtask_ratio",
    f"""with {RE}, q as (select user_id, task_name, subtask, {total()} as subtask_total from re
          where task_name = 'click' and date between date '2024-01-03' and date '2024-01-25'
            and tag = 'tag2' group by 1, 2, 3),
        w as (select *, sum(subtask_total) over (partition by user_id, task_name) as whole from q)
        select user_id, task_name, subtask, subtask_total,
               {percent('subtask_total', 'whole')} as ratio from w""",
)
def subtask_ratio(spark, sf_dir):
    tagged = event_records(spark, sf_dir).filter("tag = 'tag2'")
    return ratios.subtask_ratio(tagged, "click", Period.between("2024-01-03", "2024-01-25"))


_GRAINS = {
    "day": iso("date"),
    "week": "strftime(date, '%Y-%W')",
    "month": "strftime(date, '%Y-%m')",
    "year": "strftime(date, '%Y')",
}


def _register_grain(name: str, grain: str, text: str, first: str, last: str) -> None:
    @query(
        name,
        f"""with {RO}, q as (select user_id, {text} as period, task_name, {total()} as task_total
              from ro where date between date '{first}' and date '{last}' group by 1, 2, 3),
            w as (select *, cast(sum(task_total) over (partition by user_id, period) as bigint)
                  as period_total from q)
            select user_id, period, task_name, period_total, task_total,
                   {percent('task_total', 'period_total')} as ratio from w""",
    )
    def run(spark, sf_dir):
        return ratios.task_ratio_by(order_records(spark, sf_dir), grain, Period.between(first, last))


for _grain, _text in _GRAINS.items():
    _register_grain(f"task_ratio_by_{_grain}", _grain, _text, "1997-10-15", "1999-03-20")
_register_grain("task_ratio_by_week_one_year", "week", "strftime(date, '%W')", "1998-02-01", "1998-11-30")
