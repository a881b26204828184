"""Calendar attributes, labels and gap-free weekly totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sqltext import hms, iso, total
from catalog.views import ORDERS_AS_OF, RO, order_records, order_users
from chronofold.functions import calendar as cal
from chronofold.operators import weeks

_BEGIN, _END = dt.date(1999, 3, 1), dt.date(1999, 6, 10)


def _days(spark, sf_dir):
    return order_records(spark, sf_dir).select("date").distinct()


def _json_list(items: str, item: str) -> str:
    return f"cast(to_json(list_transform({items}, lambda x: {item})) as varchar)"


@query(
    "calendar_attrs",
    f"""with {RO}, d as (select distinct date, date_trunc('month', date) as b,
          date_trunc('year', date) as y from ro)
        select {iso('date')} as date,
          cast(strftime(date, '%W') as bigint) as week_from_zero,
          cast(dayofweek(date) as bigint) as weekday,
          strftime(date, '%Y-%m') as month_text, strftime(date, '%Y') as year_text,
          {iso('date')} as week_text,
          1 + datediff('day', date_trunc('week', y), date_trunc('week', date)) // 7 as week_from_one,
          datediff('day', date_trunc('week', b), date_trunc('week', date)) // 7
            + case when isodow(b) = 1 then 1 else 0 end as week_in_month,
          cast(weekofyear(date) as bigint) as iso_week,
          datediff('day', y, y + interval 1 year) as days_in_year,
          datediff('day', y, y + interval 1 year) / 4.0::double as quarter_length
        from d""",
)
def calendar_attrs(spark, sf_dir):
    day = F.col("date")
    return _days(spark, sf_dir).select(
        "date",
        cal.year_week_from_zero(day).alias("week_from_zero"),
        cal.weekday_from_sunday(day).alias("weekday"),
        cal.period_text("month", day).alias("month_text"),
        cal.period_text("year", day).alias("year_text"),
        cal.period_text("week", day).alias("week_text"),
        cal.year_week_from_one(day).alias("week_from_one"),
        cal.range_week(day, F.trunc(day, "month")).alias("week_in_month"),
        F.weekofyear(day).alias("iso_week"),
        cal.days_in_year(day).alias("days_in_year"),
        cal.quarter_length(day).alias("quarter_length"),
    )


@query(
    "labels_week",
    f"""with {RO}, d as (select distinct date, date_trunc('week', date) as m from ro)
        select {iso('date')} as date, {iso('m')} as monday, {iso("m + interval 6 day")} as sunday,
          {_json_list("generate_series(m, m + interval 6 day, interval 1 day)", iso('x'))} as labels
        from d""",
)
def labels_week(spark, sf_dir):
    day = F.col("date")
    return _days(spark, sf_dir).select(
        "date",
        cal.monday(day).alias("monday"),
        cal.sunday(day).alias("sunday"),
        cal.week_labels(day).alias("labels"),
    )


@query(
    "labels_month",
    f"""with {RO}, d as (select distinct date_trunc('month', date) as m from ro)
        select strftime(m, '%Y-%m') as month, {_json_list(
            "generate_series(date_trunc('week', m), m + interval 1 month - interval 1 day, interval 7 day)",
            "printf('%02d', weekofyear(x))")} as labels from d""",
)
def labels_month(spark, sf_dir):
    first = F.trunc("date", "month").alias("first")
    months = order_records(spark, sf_dir).select(first).distinct()
    return months.select(
        F.date_format("first", cal.MONTH_FORMAT).alias("month"),
        cal.month_labels(F.col("first")).alias("labels"),
    )


@query(
    "labels_year",
    f"""with {RO}, d as (select distinct date_trunc('year', date) as y from ro)
        select strftime(y, '%Y') as year, {_json_list(
            "generate_series(y, y + interval 11 month, interval 1 month)",
            "strftime(x, '%Y-%m')")} as labels from d""",
)
def labels_year(spark, sf_dir):
    first = F.trunc("date", "year").alias("first")
    years = order_records(spark, sf_dir).select(first).distinct()
    return years.select(
        F.date_format("first", cal.YEAR_FORMAT).alias("year"),
        cal.year_labels(F.col("first")).alias("labels"),
    )


@query(
    "labels_range",
    f"""with {RO}, b as (select user_id, cast(min(date) as timestamp) as a,
          cast(max(date) as timestamp) as z from ro group by 1)
        select user_id,
          {_json_list("generate_series(date_trunc('week', a), z, interval 7 day)",
                      "printf('%02d', weekofyear(x))")} as weeks,
          {_json_list("generate_series(date_trunc('month', a), z, interval 1 month)",
                      "strftime(x, '%Y-%m')")} as months,
          {_json_list("generate_series(year(a), year(z))", "cast(x as varchar)")} as years,
          cast(datediff('day', a, z) + 1 as bigint) as day_count,
          cast(to_json([{iso('a')}]) as varchar) as single
        from b""",
)
def labels_range(spark, sf_dir):
    bounds = (
        order_records(spark, sf_dir)
        .groupBy("user_id")
        .agg(F.min("date").alias("first"), F.max("date").alias("last"))
    )
    first, last = F.col("first"), F.col("last")
    return bounds.select(
        "user_id",
        cal.range_labels("week", first, last).alias("weeks"),
        cal.range_labels("month", first, last).alias("months"),
        cal.range_labels("year", first, last).alias("years"),
        F.size(cal.day_spine(first, last)).alias("day_count"),
        cal.range_labels("day", first, F.lit(None).cast("date")).alias("single"),
    )


@query(
    "week_bounds",
    f"""with {RO}, d as (select distinct cast(year(date) as bigint) as year,
          cast(strftime(date, '%W') as bigint) as week from ro),
        y as (select *, make_date(cast(year as int), 1, 1) as new_year from d),
        m as (select *, new_year + cast((8 - isodow(new_year)) % 7 + (week - 1) * 7 as int) as monday from y)
        select year, week, {iso('monday')} as monday, {iso('monday + 6')} as sunday from m""",
)
def week_bounds(spark, sf_dir):
    day = F.col("date")
    found = (
        order_records(spark, sf_dir)
        .select(F.year(day).alias("year"), cal.year_week_from_zero(day).alias("week"))
        .distinct()
    )
    monday = cal.week_start_of(F.col("year"), F.col("week"))
    return found.select(
        "year", "week", monday.alias("monday"), F.date_add(monday, 6).alias("sunday")
    )


_YEAR_WEEKS = f"""with {RO}, c as (select cast(d as date) as d,
      1 + datediff('day', date_trunc('week', date '1998-01-01'), date_trunc('week', d)) // 7 as week
      from generate_series(timestamp '1998-01-01', timestamp '1998-12-31', interval 1 day) g(d)),
    k as (select week, count(*) as days from c group by 1),
    u as (select c_custkey as user_id from customer),
    t as (select user_id, week, {total()} as s from ro join c on c.d = ro.date group by 1, 2)
    select u.user_id, '1998' as year, k.week, coalesce(t.s, 0) as total
    from u cross join k left join t on t.user_id = u.user_id and t.week = k.week"""


@query("week_totals_year", _YEAR_WEEKS)
def week_totals_year(spark, sf_dir):
    return weeks.week_totals_of_year(
        order_records(spark, sf_dir), 1998, users=order_users(spark, sf_dir)
    )


@query("week_totals_full_only", _YEAR_WEEKS + " where k.days = 7")
def week_totals_full_only(spark, sf_dir):
    return weeks.week_totals_of_year(
        order_records(spark, sf_dir), 1998, include_partial=False, users=order_users(spark, sf_dir)
    )


def _range_weeks_sql(condition: str) -> str:
    return f"""with {RO}, s as (select cast(d as date) as d, case when isodow(d) = 1 then 1 else 0 end as m
          from generate_series(timestamp '1999-03-01', timestamp '1999-06-09', interval 1 day) g(d)),
        c as (select d, cast(sum(m) over (order by d) as bigint) as week_group from s),
        k as (select week_group, count(*) as days from c group by 1),
        u as (select distinct user_id from ro where date >= date '1999-03-01' and date < date '1999-06-10'),
        t as (select user_id, week_group, {total()} as s from ro join c on c.d = ro.date group by 1, 2)
        select u.user_id, k.week_group, coalesce(t.s, 0) as week_total
        from u cross join k left join t on t.user_id = u.user_id and t.week_group = k.week_group
        where {condition}"""


@query("week_totals_range", _range_weeks_sql("true"))
def week_totals_range(spark, sf_dir):
    return weeks.week_totals_in_range(order_records(spark, sf_dir), _BEGIN, _END)


@query("week_totals_range_full", _range_weeks_sql("k.days = 7"))
def week_totals_range_full(spark, sf_dir):
    return weeks.week_totals_in_range(
        order_records(spark, sf_dir), _BEGIN, _END, include_partial=False
    )


@query(
    "past_weeks",
    f"""with {RO}, w as (select cast(m as date) as monday, cast(m as date) + 6 as sunday
          from generate_series(timestamp '2001-07-30' - interval 77 day, timestamp '2001-07-30',
                               interval 7 day) g(m)),
        u as (select c_custkey as user_id from customer),
        t as (select user_id, cast(date_trunc('week', date) as date) as monday, {total()} as s
              from ro group by 1, 2),
        r as (select u.user_id, w.monday, w.sunday, coalesce(t.s, 0) as total_time
              from u cross join w left join t on t.user_id = u.user_id and t.monday = w.monday)
        select user_id, {iso('monday')} as monday, {iso('sunday')} as sunday, total_time,
               {hms('total_time')} as time from r""",
)
def past_weeks(spark, sf_dir):
    return weeks.past_weeks(
        order_records(spark, sf_dir), ORDERS_AS_OF, 12, users=order_users(spark, sf_dir)
    )
