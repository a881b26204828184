"""Counts, totals, means and streaks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.selection import order_log, star_schema
from catalog.sqltext import dhms, hms, iso, total
from catalog.views import (
    EVENTS_AS_OF,
    ORDERS_AS_OF,
    RE,
    RO,
    event_records,
    order_records,
    table,
)
from chronofold.functions.durations import elapsed_seconds
from chronofold.operators import streaks, totals
from chronofold.plans import runs
from chronofold.plans.period import Period
from chronofold.plans.selection import RecordFilter, select_records
from chronofold.sources import schema
from chronofold.sources.session import kept, scratch_dir
from chronofold.sources.tables import write_dimension, write_records
from chronofold.streaming import late

_SPAN = Period.between("1996-02-10", "2000-11-20")
_SPAN_SQL = "date between date '1996-02-10' and date '2000-11-20'"


@query(
    "timer_count",
    f"""with {RO} select user_id, count(*) as count from ro
        where year(date) = 1998 and task_name = '2-HIGH' and tag = 'BUILDING' group by user_id""",
)
def timer_count(spark, sf_dir):
    wanted = RecordFilter.from_request({"year": "1998", "task": "2-HIGH", "tag": "BUILDING"})
    return totals.timer_count(select_records(order_log(spark, sf_dir), wanted))


@query(
    "total_time",
    f"""with {RO} select user_id, coalesce({total()}, 0) as total_time from ro
        where year(date) = 1998 and task_name = '2-HIGH' group by user_id""",
)
def total_time(spark, sf_dir):
    wanted = RecordFilter.from_request({"year": "1998", "task": "2-HIGH"})
    return totals.total_time(select_records(order_log(spark, sf_dir), wanted))


@query(
    "total_time_everyone",
    f"with {RO} select coalesce({total()}, 0) as total_time from ro where {_SPAN_SQL}",
)
def total_time_everyone(spark, sf_dir):
    span = totals.period_rows(order_records(spark, sf_dir), _SPAN)
    return totals.total_time(span, keys=())


@query(
    "total_per_day",
    f"""with {RO} select user_id, {iso('date')} as date, {total()} as total from ro
        where {_SPAN_SQL} group by user_id, ro.date""",
)
def total_per_day(spark, sf_dir):
    return totals.total_per_day(order_records(spark, sf_dir), _SPAN)


@query(
    "total_per_day_everyone",
    f"""with {RO} select {iso('date')} as date, {total()} as total from ro
        where {_SPAN_SQL} and task_name = '3-MEDIUM' group by ro.date""",
)
def total_per_day_everyone(spark, sf_dir):
    """A filter on the task alone is honoured."""
    one_task = order_records(spark, sf_dir).filter(F.col("task_name") == "3-MEDIUM")
    return totals.total_per_day(one_task, _SPAN, keys=())


@query(
    "total_week_range",
    f"""with {RO} select user_id, {iso("date_trunc('week', date)")} as week_start, {total()} as total
        from ro where date >= date '1998-01-07' and date < date '1999-03-03' group by 1, 2""",
)
def total_week_range(spark, sf_dir):
    return totals.total_per_week_in_range(
        order_records(spark, sf_dir), dt.date(1998, 1, 7), dt.date(1999, 3, 3)
    )


@query(
    "total_per_month",
    f"""with {RO} select user_id, strftime(date, '%Y-%m') as month, {total()} as total
        from ro where {_SPAN_SQL} group by 1, 2""",
)
def total_per_month(spark, sf_dir):
    return totals.total_per_month(order_records(spark, sf_dir), _SPAN)


@query(
    "total_per_year",
    f"""with {RO} select user_id, strftime(date, '%Y') as year, {total()} as total
        from ro where {_SPAN_SQL} group by 1, 2""",
)
def total_per_year(spark, sf_dir):
    return totals.total_per_year(order_records(spark, sf_dir), _SPAN)


@query(
    "time_per_task_today",
    f"""with {RE}, t as (select user_id, task_name, {total()} as total_time from re
        where date = date '2024-01-30' group by 1, 2)
        select *, {hms('total_time')} as time from t""",
)
def time_per_task_today(spark, sf_dir):
    return totals.time_per_task(event_records(spark, sf_dir), EVENTS_AS_OF)


@query(
    "max_day",
    f"""with {RO}, d as (select user_id, date, {total()} as total_time from ro group by 1, 2),
        r as (select *, row_number() over (partition by user_id order by total_time desc, date) as n
              from d)
        select user_id, {iso('date')} as date, total_time, {hms('total_time')} as time
        from r where n = 1""",
)
def max_day(spark, sf_dir):
    return totals.longest_day(order_records(spark, sf_dir))


def _mean_day_sql(condition: str) -> str:
    return f"""with {RO}, d as (select user_id, date, {total()} as t from ro
        where {condition} group by 1, 2),
        m as (select user_id, coalesce(cast({total('t')} as double) / nullif(count(t), 0), 0) as mean_s
              from d group by user_id)
        select user_id, mean_s, {hms('cast(floor(mean_s) as bigint)')} as time from m"""


@query("avg_day_all", _mean_day_sql("true"))
def avg_day_all(spark, sf_dir):
    return totals.average_day(order_records(spark, sf_dir))


@query("avg_day_for_year", _mean_day_sql("year(date) = 1999"))
def avg_day_for_year(spark, sf_dir):
    return totals.average_day(order_records(spark, sf_dir), Period.year(1999))


_GRAIN_SQL = {
    "day": ("date", "year(date) = 2001"),
    "week": ("strftime(date, '%W')", "year(date) = 2001"),
    "month": ("strftime(date, '%Y-%m')", "year(date) = 2001"),
    "year": ("year(date)", "true"),
}


def _register_mean(grain: str) -> None:
    group, condition = _GRAIN_SQL[grain]

    @query(
        f"mean_per_{grain}",
        f"""with {RO}, p as (select user_id, {group} as g, {total()} as t from ro
            where {condition} group by 1, 2)
            select user_id,
                   coalesce(cast({total('t')} as double) / nullif(count(t), 0), 0) as mean_{grain}
            from p group by user_id""",
    )
    def run(spark, sf_dir):
        return totals.mean_per_period(order_records(spark, sf_dir), grain, ORDERS_AS_OF)


for _grain in _GRAIN_SQL:
    _register_mean(_grain)


@query(
    "year_report_task",
    f"""with {RO}, r as (select user_id, task_name, count(distinct date) as days_done,
        {total()} as total_time from ro where date between date '2000-01-01' and date '2000-09-30'
        group by 1, 2) select *, {dhms('total_time')} as total from r""",
)
def year_report_task(spark, sf_dir):
    return totals.year_report(
        order_records(spark, sf_dir), Period.between("2000-01-01", "2000-09-30")
    )


@query(
    "year_report_frequent",
    f"""with {RE}, r as (select user_id, task_name, count(distinct date) as days_done,
        {total()} as total_time from re where year(date) = 2024
        group by 1, 2 having count(distinct date) > 10)
        select *, {dhms('total_time')} as total from r""",
)
def year_report_frequent(spark, sf_dir):
    return totals.year_report(event_records(spark, sf_dir), Period.year(2024), min_days=10)


@query(
    "avg_per_weekday",
    f"""with {RO}, d as (select user_id, date, {total()} as t from ro where year(date) = 1997
        group by 1, 2)
        select user_id, cast(dayofweek(date) as bigint) as day_of_week,
               cast({total('t')} as double) / nullif(count(t), 0) as mean_s from d group by 1, 2""",
)
def avg_per_weekday(spark, sf_dir):
    return totals.average_per_weekday(order_records(spark, sf_dir), Period.year(1997))


@query(
    "date_bounds",
    f"""with {RO} select user_id, {iso('min(date)')} as first_date, {iso('max(date)')} as last_date
        from ro group by user_id""",
)
def date_bounds(spark, sf_dir):
    return totals.date_bounds(order_records(spark, sf_dir))


@query("task_list", f"with {RO} select distinct user_id, task_name from ro where task_name <> '5-LOW'")
def task_list(spark, sf_dir):
    return totals.task_list(order_records(spark, sf_dir), skip_names=["5-LOW"])


@query(
    "open_records",
    f"""with {RE}, o as (select user_id, date, count(*) as count,
          count(*) filter (where elapsed_s is null) as open_count, {total()} as total_time
          from re group by 1, 2)
        select user_id, {iso('date')} as date, count, open_count, total_time,
          count || case when count > 1 then ' timers' else ' timer' end ||
          case when total_time is null and count = 1 then ' (ongoing).'
               else ' (' || {hms('coalesce(total_time, 0)')} || ').' end as status
        from o""",
)
def open_records(spark, sf_dir):
    return totals.open_records(event_records(spark, sf_dir), keys=("user_id", "date"))


@query(
    "elapsed_seconds",
    f"""with {RE}, e as (select record_id, begin_ts, begin_ts + to_seconds(elapsed_s) as end_ts
        from re),
        s as (select *, epoch(cast(end_ts as time)) - epoch(cast(begin_ts as time)) as diff from e)
        select record_id,
               cast(case when diff > 0 then diff else diff + 86400 end as bigint) as elapsed_s
        from s""",
)
def elapsed(spark, sf_dir):
    end = F.col("begin_ts") + F.make_dt_interval(secs=F.col("elapsed_s").cast("decimal(18,6)"))
    records = event_records(spark, sf_dir)
    return records.select("record_id", elapsed_seconds(F.col("begin_ts"), end).alias("elapsed_s"))


_STREAK_SQL = """, d as (select distinct user_id, task_name, date from re {where}),
    i as (select *, date - cast(row_number() over (partition by user_id, task_name order by date)
          as int) as island from d),
    g as (select user_id, task_name, island, count(*) as n from i group by 1, 2, 3)
    select user_id, task_name, max(n) as longest_streak, max_by(n, island) as current_streak,
           max_by(n, island) = max(n) as current_is_longest
    from g group by 1, 2"""


@query("streaks_all", f"with {RE}" + _STREAK_SQL.format(where=""))
def streaks_all(spark, sf_dir):
    return streaks.streaks(event_records(spark, sf_dir))


@query("streaks_months", f"with {RO}" + _STREAK_SQL.format(where="").replace("from re", "from ro"))
def streaks_months(spark, sf_dir):
    """Streaks from one row for each month of a user and task."""
    by = ("user_id", "task_name")
    return runs.streaks_of_runs(kept(runs.month_runs(order_records(spark, sf_dir), by), "runs"), by)


@query("streaks_stored", f"with {RE}" + _STREAK_SQL.format(where=""))
def streaks_stored(spark, sf_dir):
    """Tagged events are stored with their runs; a merge of the untagged ones makes the runs of
    the months that it changes anew."""
    log = star_schema(event_records(spark, sf_dir))
    root = scratch_dir(spark, "streaks")
    write_dimension(log.tasks, root, "tasks")
    write_dimension(log.tags, root, "tags")
    nothing = {"end_ts": "timestamp_ntz", "log": "string"}
    records = log.records.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()})
    records = records.withColumn("record_id", F.col("record_id").cast("string"))
    records = records.select(*[f.name for f in schema.RECORDS.fields])
    first = write_records(records.filter("tag_id is not null"), root)
    rest = records.filter("tag_id is null").withColumns({"operation": F.lit("old"), "seq": F.lit(1)})
    last = late.merge_batch(spark, root, rest, runs.keep(spark, root, first, "runs"), "rest")
    return runs.stored_streaks(spark, root, last)


@query("streak_by_pattern", f"with {RE}" + _STREAK_SQL.format(where="where task_name ilike 'S%_P'"))
def streak_by_pattern(spark, sf_dir):
    return streaks.streaks(event_records(spark, sf_dir), pattern="S%_P")


_FMT_SQL = f"""with {RO}, t as (select user_id, {total()} as s from ro group by 1)
    select user_id, {hms('s')} as hours, {dhms('s')} as days,
           cast(to_json(string_split({dhms('s')}, ':')) as varchar) as parts from t"""


@query("fmt_duration", _FMT_SQL)
def fmt_duration(spark, sf_dir):
    from chronofold.functions.durations import duration_text, split_text

    seconds = F.col("total_time")
    return totals.total_time(order_records(spark, sf_dir)).select(
        "user_id",
        duration_text(seconds).alias("hours"),
        duration_text(seconds, "day").alias("days"),
        split_text(duration_text(seconds, "day")).alias("parts"),
    )


@query(
    "row_counts",
    f"""with {RE}, c as (select 'records' as table_name, count(*) as count from re
          union all select 'tasks', (select count(*) from (select distinct task_name, subtask from re))
          union all select 'tags', count(distinct tag) from re
          union all select 'settings', count(*) from re where task_name = 'settings')
        select *, count = 0 as is_empty from c""",
)
def row_counts(spark, sf_dir):
    """Tables are counted to find the empty ones; no record is of the task ``settings``."""
    records = event_records(spark, sf_dir)
    return totals.row_counts(
        {
            "records": records,
            "tasks": records.select("task_name", "subtask").distinct(),
            "tags": records.select("tag").distinct().filter(F.col("tag").isNotNull()),
            "settings": records.filter(F.col("task_name") == "settings"),
        }
    )


_REQUESTS = """q as (select o_orderkey as request_id, o_custkey as user_id, cast(o_orderdate as date) as d,
    left(o_orderpriority, 1) as kind, o_orderstatus as status from orders),
  s as (select request_id, user_id,
      case when kind <> '3' and status = 'P' then 'several spans'
           when kind = '5' and status = 'F' then 'half a span'
           when kind = '1' and status = 'F' then 'bad date' end as problem,
      case kind when '2' then date_trunc('month', d) when '3' then date_trunc('year', d) else d end as a,
      case kind when '1' then d when '2' then last_day(d)
           when '3' then date_trunc('year', d) + interval 1 year - interval 1 day
           when '4' then d + interval 6 day else d + interval 100 day end as b from q),
  r as (select request_id, user_id, problem,
      case when problem is null then cast(a as date) end as first,
      case when problem is null then cast(b as date) end as last from s)"""


@query(
    "requests_answered",
    f"""with {RO}, {_REQUESTS}
        , t as (select r.*, count(ro.record_id) as n, coalesce({total('ro.elapsed_s')}, 0) as seconds
          from r left join ro on ro.user_id = r.user_id and ro.date between r.first and r.last group by all)
        select request_id, user_id, strftime(first, '%Y-%m-%d') as first,
               strftime(last, '%Y-%m-%d') as last, problem,
               case when problem is null then n end as count,
               case when problem is null then seconds end as total_time
        from t""",
)
def requests_answered(spark, sf_dir):
    """One request an order: a day, month, year, week or range by its priority, some of them faulty."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.substring("o_orderpriority", 1, 1)
    status = F.col("o_orderstatus")
    slashed = F.translate(day, "-", "/")
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.col("o_custkey").alias("user_id"),
        F.when(kind == "1", F.when(status == "F", slashed).otherwise(day)).alias("day"),
        F.when(kind == "2", F.substring(day, 1, 7)).alias("month"),
        F.when((kind == "3") | (status == "P"), F.substring(day, 1, 4)).alias("year"),
        F.when(kind == "4", day).alias("week_start"),
        F.when(kind == "4", F.date_add(day.cast("date"), 6).cast("string")).alias("week_end"),
        F.when(kind == "5", day).alias("range_beginning"),
        F.when((kind == "5") & (status != "F"), F.date_add(day.cast("date"), 100).cast("string")).alias("range_ending"),
    )
    answered = totals.totals_of_requests(order_records(spark, sf_dir), requests)
    return answered.select("request_id", "user_id", "first", "last", "problem", "count", "total_time")
