"""Chart series and composed reports."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.selection import order_log
from catalog.sqltext import dhms, hms, iso, percent, scaled, total
from catalog.views import EVENTS_AS_OF, ORDERS_AS_OF, RE, RO, event_records, order_records
from chronofold.operators import charts, reports, weeks
from chronofold.plans.period import Period

# Every chart twin lists its labels as (place, first day, last day).
_PLACES = {
    "day": "select cast(i as int) as place, a + cast(i as int) as d1, a + cast(i as int) as d2 "
    "from b, generate_series(0, datediff('day', a, z)) g(i)",
    "week": "select cast(i as int) as place, cast(date_trunc('week', a) as date) + 7 * cast(i as int) as d1, "
    "cast(date_trunc('week', a) as date) + 7 * cast(i as int) + 6 as d2 "
    "from b, generate_series(0, datediff('day', date_trunc('week', a), z) // 7) g(i)",
    "month": "select cast(i as int) as place, "
    "cast(date_trunc('month', a) + to_months(cast(i as int)) as date) as d1, "
    "cast(date_trunc('month', a) + to_months(cast(i as int) + 1) as date) - 1 as d2 "
    "from b, generate_series(0, datediff('month', a, z)) g(i)",
}


def _chart_ctes(view: str, grain: str, first: str, last: str) -> str:
    return f"""{view}, b as (select date '{first}' as a, date '{last}' as z),
        p as ({_PLACES[grain]}),
        x as (select user_id, place, task_name, {total()} as t from {view[:2]}, b, p
              where date between a and z and date between d1 and d2 group by 1, 2, 3),
        y as (select *, sum(t) over (partition by user_id, place) as whole from x)"""


def _line_ctes(known: str | None) -> str:
    """Per user the totals of all places, NULL from the first day after ``known`` on."""
    value = "coalesce(l.s, 0)" if known is None else f"case when d1 <= date '{known}' then coalesce(l.s, 0) end"
    return f"""l as (select user_id, place, {total('t')} as s from x group by 1, 2),
        u as (select distinct user_id from x),
        line as (select u.user_id, cast(to_json(list({value} order by p.place)) as varchar) as data
                 from u cross join p left join l on l.user_id = u.user_id and l.place = p.place
                 group by u.user_id)"""


_STACK = f"""st as (select k.user_id, k.task_name as name,
          list(coalesce({percent('y.t', 'y.whole')}, 0.0::double) order by p.place) as data
        from (select distinct user_id, task_name from x) k cross join p
        left join y on y.user_id = k.user_id and y.task_name = k.task_name and y.place = p.place
        group by 1, 2),
    stacked as (select user_id, list(struct_pack(name := name, data := data) order by name) as stacked
                from st group by 1)"""

# Series, records, grain, range and the last known day.
_SERIES = (
    ("week", RE, event_records, "day", "2024-01-22", "2024-01-28", "2024-01-25"),
    ("month", RO, order_records, "week", "1998-12-01", "1998-12-31", None),
    ("year", RO, order_records, "month", "2001-01-01", "2001-12-31", "2001-08-01"),
)


def _register_series(name, view, read, grain, first, last, known) -> None:
    span = Period.between(first, last)

    @query(
        f"chart_line_{name}",
        f"""with {_chart_ctes(view, grain, first, last)}, {_line_ctes(known)}
            select user_id, 'Total time' as name, data from line""",
    )
    def line(spark, sf_dir):
        as_of = dt.date.fromisoformat(known) if known else None
        return charts.line_chart(read(spark, sf_dir), grain, span, as_of)

    stacked_name = "day" if name == "week" else "week" if name == "month" else "month"

    @query(
        f"chart_stacked_{stacked_name}",
        f"""with {_chart_ctes(view, grain, first, last)}, {_STACK}
            select user_id, name, cast(to_json(data) as varchar) as data from st""",
    )
    def stacked(spark, sf_dir):
        return charts.stacked_chart(read(spark, sf_dir), grain, span)


for _entry in _SERIES:
    _register_series(*_entry)


_YEAR_POINTS = f"""pw as (select cast(i as int) as place from generate_series(0, 52) g(i)),
    tw as (select user_id, cast(datediff('day', date_trunc('week', date '1998-01-01'),
             date_trunc('week', date)) // 7 as int) as place, {total()} as s
           from ro where year(date) = 1998 group by 1, 2),
    points as (select u.user_id, list(struct_pack(x := cast(pw.place + 1 as bigint),
             y := coalesce(tw.s, 0)) order by pw.place) as points
           from (select distinct user_id from tw) u cross join pw
           left join tw on tw.user_id = u.user_id and tw.place = pw.place group by 1)"""


@query(
    "chart_year_weeks",
    f"""with {RO}, {_YEAR_POINTS}
        select user_id, '1998' as year, cast(to_json(points) as varchar) as points from points""",
)
def chart_year_weeks(spark, sf_dir):
    return weeks.week_points_of_year(order_records(spark, sf_dir), 1998)


def _means_cte(view: str, year: int) -> str:
    """Means per day, ``%W`` week and month of one year, per user."""
    v = view[:2]

    def mean(name: str, group: str) -> str:
        return f"""mean_{name} as (select user_id,
            cast(sum(t) as double) / nullif(count(t), 0) as m from (
              select user_id, {group} as g, {total()} as t from {v} where year(date) = {year}
              group by 1, 2) group by 1)"""

    return ", ".join(
        (
            mean("day", "date"),
            mean("week", "strftime(date, '%W')"),
            mean("month", "month(date)"),
        )
    )


def _span_json(name: str, mean: bool) -> str:
    """One summary entry as a struct of count, time and mean."""
    time = hms if name in ("day", "week") else dhms
    fields = [f"count := {name}_n", f"time := string_split({time(f'{name}_s')}, ':')"]
    if mean:
        value = f"cast(floor(coalesce(mean_{name}.m, 0)) as bigint)"
        # A mean may exceed one day by a fraction of a second only.
        text = hms(value) if name == "day" else (
            f"case when coalesce(mean_{name}.m, 0) > 86400 then {dhms(value)} else {hms(value)} end"
        )
        fields.append(f"mean := string_split({text}, ':')")
    return f"struct_pack({', '.join(fields)})"


def _spans_cte(view: str, year: int, spans: dict[str, str]) -> str:
    columns = ", ".join(
        f"count(*) filter (where {condition}) as {name}_n, "
        f"coalesce({total().replace('sum(elapsed_s)', f'sum(elapsed_s) filter (where {condition})')}, 0) as {name}_s"
        for name, condition in spans.items()
    )
    reach = " or ".join([*spans.values(), f"year(date) = {year}"])
    return f"""spans as (select user_id, {columns} from {view[:2]} where {reach} group by user_id)"""


_MEAN_JOINS = """left join mean_day on mean_day.user_id = spans.user_id
    left join mean_week on mean_week.user_id = spans.user_id
    left join mean_month on mean_month.user_id = spans.user_id"""

_HOME_SPANS = {
    "day": "date = date '2001-08-01'",
    "week": "date > date '2001-07-29'",
    "month": "strftime(date, '%Y-%m') = '2001-08'",
    "year": "year(date) = 2001",
}


def _json(value: str) -> str:
    return f"cast(to_json({value}) as varchar)"


@query(
    "home_summary",
    f"""with {RO}, {_spans_cte(RO, 2001, _HOME_SPANS)}, {_means_cte(RO, 2001)}
        select spans.user_id, {_json(_span_json('day', True))} as daily,
               {_json(_span_json('week', True))} as weekly,
               {_json(_span_json('month', True))} as monthly,
               {_json(_span_json('year', False))} as yearly
        from spans {_MEAN_JOINS}""",
)
def home_summary(spark, sf_dir):
    return reports.home_summary(order_records(spark, sf_dir), ORDERS_AS_OF)


@query(
    "page_day",
    f"""with {RE}, {_spans_cte(RE, 2024, {'day': "date = date '2024-01-17'"})}, {_means_cte(RE, 2024)},
        q as (select user_id, task_name, {total()} as t from re where date = date '2024-01-17' group by 1, 2),
        w as (select *, {percent('t', 'sum(t) over (partition by user_id)')} as ratio from q),
        d as (select user_id, list(struct_pack(task := task_name, time := t,
                formatted := string_split({scaled('t')}, ':'), ratio := ratio)
                order by ratio desc, task_name) as detail from w where t is not null group by 1)
        select spans.user_id, {_json(_span_json('day', True))} as resume,
               coalesce({_json('d.detail')}, '[]') as detail
        from spans {_MEAN_JOINS} left join d on d.user_id = spans.user_id""",
)
def page_day(spark, sf_dir):
    return reports.page_day(event_records(spark, sf_dir), dt.date(2024, 1, 17), EVENTS_AS_OF)


def _page_sql(view, grain, first, last, name, span, year, labels, known, extra="", columns="") -> str:
    empty = (
        "(select cast(to_json(list("
        + ("0" if known is None else f"case when d1 <= date '{known}' then 0 end")
        + " order by place)) as varchar) from p)"
    )
    return f"""with {_chart_ctes(view, grain, first, last)}, {_line_ctes(known)}, {_STACK},
        {_spans_cte(view, year, {name: span})}, {_means_cte(view, year)}{extra}
        select spans.user_id, {_json(_span_json(name, name != 'year'))} as resume,
               '{labels}' as labels, coalesce({_json('stacked.stacked')}, '[]') as stacked,
               coalesce(line.data, {empty}) as line{columns}
        from spans {_MEAN_JOINS} left join stacked on stacked.user_id = spans.user_id
        left join line on line.user_id = spans.user_id"""


@query(
    "page_week",
    _page_sql(
        RE, "day", "2024-01-22", "2024-01-28", "week",
        "date between date '2024-01-24' and date '2024-01-30'", 2024,
        '["2024-01-22","2024-01-23","2024-01-24","2024-01-25","2024-01-26","2024-01-27","2024-01-28"]',
        "2024-01-26",
    ),
)
def page_week(spark, sf_dir):
    as_of = dt.date(2024, 1, 26)
    return reports.page_week(event_records(spark, sf_dir), dt.date(2024, 1, 24), as_of)


@query(
    "page_month",
    _page_sql(
        RO, "week", "1998-12-01", "1998-12-31", "month", "strftime(date, '%Y-%m') = '1998-12'", 1998,
        '["49","50","51","52","53"]', None,
    ),
)
def page_month(spark, sf_dir):
    return reports.page_month(order_records(spark, sf_dir), "1998-12", dt.date(1998, 12, 31))


@query(
    "page_month_past",
    _page_sql(
        RO, "week", "1995-03-01", "1995-03-31", "month", "strftime(date, '%Y-%m') = '1995-03'", 2001,
        '["09","10","11","12","13"]', None,
    ),
)
def page_month_past(spark, sf_dir):
    """A page far before the year of ``as_of``: users of the years between are not on it."""
    return reports.page_month(order_records(spark, sf_dir), "1995-03", ORDERS_AS_OF)


@query(
    "page_by_period",
    _page_sql(
        RO, "week", "1998-12-01", "1998-12-31", "month", "strftime(date, '%Y-%m') = '1998-12'", 1998,
        '["49","50","51","52","53"]', None,
    ),
)
def page_by_period(spark, sf_dir):
    """The page of ``page_month``, asked for by name and date."""
    request = {"period": "month", "date": "1998-12"}
    report = reports.custom_report(order_log(spark, sf_dir), request, dt.date(1998, 12, 31))
    return report["page"]


@query(
    "page_year",
    _page_sql(
        RO, "month", "1998-01-01", "1998-12-31", "year", "year(date) = 1998", 1998,
        '["1998-01","1998-02","1998-03","1998-04","1998-05","1998-06",'
        '"1998-07","1998-08","1998-09","1998-10","1998-11","1998-12"]',
        "1998-09-15", ", " + _YEAR_POINTS,
        ", cast(to_json((select points from points where points.user_id = spans.user_id)) as varchar) as weeks",
    ),
)
def page_year(spark, sf_dir):
    return reports.page_year(order_records(spark, sf_dir), 1998, dt.date(1998, 9, 15))


_REQUEST = {
    "rangeBeginning": "1998-05-11",
    "rangeEnding": "1999-01-20",
    "task": "2-HIGH",
    "stats": [
        {"element": "timer-info"},
        {"element": "task-ratio"},
        {"element": "subtask-ratio"},
        {"element": "line-chart", "column-period": "month"},
        {"element": "stacked-column-chart", "column-period": "week"},
    ],
}
_ONE = RO.replace("ro as (", "r0 as (") + ", ro as (select * from r0 where task_name = '2-HIGH')"


@query(
    "custom_report",
    f"""with {_ONE}, f as (select * from ro where date between date '1998-05-11' and date '1999-01-20'),
        b as (select date '1998-05-11' as a, date '1999-01-20' as z),
        pm as ({_PLACES['month']}), pw as ({_PLACES['week']}),
        info as (select user_id, count(*) as n, {total()} as t from f group by 1),
        sub as (select user_id, subtask, {total()} as t from f group by 1, 2),
        subr as (select *, {percent('t', 'sum(t) over (partition by user_id)')} as ratio from sub),
        lm as (select user_id, place, {total()} as t from f join pm on date between d1 and d2 group by 1, 2),
        sw as (select distinct user_id, place from f join pw on date between d1 and d2)
        select user_id, 'timer-info' as element, {_json(f'''struct_pack(count := n,
            time := string_split({dhms('t')}, ':'))''')} as payload from info
        union all
        select user_id, 'task-ratio', {_json(f'''struct_pack(task := '2-HIGH', time := t,
            formatted := string_split({scaled('t')}, ':'), ratio := {percent('t', 't')})''')} from info
        union all
        select user_id, 'subtask-ratio', {_json('''struct_pack(task_name := '2-HIGH', subtask := subtask,
            subtask_total := t, ratio := ratio)''')} from subr
        union all
        select u.user_id, 'line-chart:month', {_json('''struct_pack(name := 'Total time',
            data := list(coalesce(lm.t, 0) order by pm.place),
            labels := list(strftime(d1, '%Y-%m') order by pm.place),
            title := 'Total time for month')''')}
        from info u cross join pm left join lm on lm.user_id = u.user_id and lm.place = pm.place group by 1
        union all
        select u.user_id, 'stacked-column-chart:week', {_json('''struct_pack(name := '2-HIGH',
            data := list(case when sw.place is null then 0.0::double else 100.0::double end order by pw.place),
            labels := list(printf('%02d', weekofyear(d1)) order by pw.place),
            title := 'Task ratio per week')''')}
        from info u cross join pw left join sw on sw.user_id = u.user_id and sw.place = pw.place group by 1""",
)
def custom_report(spark, sf_dir):
    return _payloads(reports.custom_report(order_log(spark, sf_dir), _REQUEST, ORDERS_AS_OF))


@query(
    "custom_report_period",
    f"""with {RO}, f as (select * from ro where strftime(date, '%Y-%m') = '1998-05'),
        info as (select user_id, count(*) as n, {total()} as t from f group by 1),
        q as (select user_id, task_name, {total()} as t from f group by 1, 2),
        r as (select *, {percent('t', 'sum(t) over (partition by user_id)')} as ratio from q)
        select user_id, 'timer-info' as element, {_json(f'''struct_pack(count := n,
            time := string_split({dhms('t')}, ':'))''')} as payload from info
        union all
        select user_id, 'task-ratio', {_json(f'''struct_pack(task := task_name, time := t,
            formatted := string_split({scaled('t')}, ':'), ratio := ratio)''')} from r""",
)
def custom_report_period(spark, sf_dir):
    """Every part answers for the named period, over all tasks."""
    stats = [{"element": "timer-info"}, {"element": "task-ratio"}]
    request = {"period": "month", "date": "1998-05", "stats": stats}
    return _payloads(reports.custom_report(order_log(spark, sf_dir), request, ORDERS_AS_OF))


@query(
    "custom_report_week_logs",
    f"""with {RO} select record_id, task_name, subtask, {iso('date')} as date, tag, elapsed_s from ro
        where date between date '1998-05-11' and date '1998-05-17'
        order by date desc, record_id limit 10 offset 10""",
)
def custom_report_week_logs(spark, sf_dir):
    """The second page of a week's records."""
    request = {"week": "1998-05-11", "logs": True, "page": 2, "page_size": 10}
    logs = reports.custom_report(order_log(spark, sf_dir), request, ORDERS_AS_OF)["logs"]
    return logs.select("record_id", "task_name", "subtask", "date", "tag", "elapsed_s")


@query(
    "custom_report_tag",
    f"""with {RO}, f as (select * from ro where tag = 'BUILDING'),
        b as (select min(date) as a, max(date) as z from ro),
        y as (select cast(year(a) + i as int) as y, row_number() over (order by i) as place
              from b, generate_series(0, (select year(z) - year(a) from b)) g(i)),
        q as (select user_id, task_name, year(date) as y, {total()} as t from f group by 1, 2, 3),
        w as (select *, {percent('t', 'sum(t) over (partition by user_id, y)')} as ratio from q),
        n as (select distinct user_id, task_name from q)
        select n.user_id, n.task_name as name,
               cast(to_json(list(coalesce(w.ratio, 0.0::double) order by place)) as varchar) as data
        from n cross join y left join w on w.user_id = n.user_id and w.task_name = n.task_name and w.y = y.y
        group by 1, 2""",
)
def custom_report_tag(spark, sf_dir):
    """A tag alone covers the first to the last date on record."""
    stats = [{"element": "stacked-column-chart", "column-period": "year"}]
    report = reports.custom_report(
        order_log(spark, sf_dir), {"tag": "BUILDING", "stats": stats}, ORDERS_AS_OF
    )
    return report["stacked-column-chart:year"].select("user_id", "name", "data")


def _payloads(report):
    rows = [
        frame.select(
            "user_id",
            F.lit(element).alias("element"),
            F.to_json(
                F.struct(*[name for name in frame.columns if name != "user_id"]),
                {"ignoreNullFields": "false"},
            ).alias("payload"),
        )
        for element, frame in report.items()
    ]
    return reduce(lambda above, below: above.unionByName(below), rows)


def _status_sql(name: str, long_unit: bool) -> str:
    text = dhms(f"{name}_s") if long_unit else hms(f"{name}_s")
    return f"""{name}_n || case when {name}_n > 1 then ' timers' else ' timer' end ||
        case when {name}_n = 0 then '.' else ' (' || {text} || ').' end"""


_TEXT_SPANS = {
    "day": "date = date '2024-01-30'",
    "week": "date > date '2024-01-28'",
    "year": "year(date) = 2024",
}


@query(
    "text_summary",
    f"""with {RE}, {_spans_cte(RE, 2024, _TEXT_SPANS)}, {_means_cte(RE, 2024)},
        d as (select distinct user_id, task_name, date from re),
        i as (select *, date - cast(row_number() over (partition by user_id, task_name order by date)
              as int) as island from d),
        g as (select user_id, task_name, island, count(*) as n from i group by 1, 2, 3),
        s as (select user_id, task_name, max(n) as longest, max_by(n, island) as current from g group by 1, 2),
        q as (select user_id, task_name, {total()} as t from re where date = date '2024-01-30' group by 1, 2),
        w as (select *, {percent('t', 'sum(t) over (partition by user_id)')} as ratio from q),
        k as (select w.user_id, list(w.task_name || ' : ' || {hms('t')} || ' (' || ratio ||
                '%) Current streak : ' || current || ' ' ||
                case when current = longest then '(max streak!)' else '(max : ' || longest || ')' end
                order by ratio desc, w.task_name) as tasks
              from w join s on s.user_id = w.user_id and s.task_name = w.task_name
              where t is not null group by 1),
        dd as (select user_id, date, {total()} as t from re group by 1, 2),
        m as (select user_id, arg_max(struct_pack(date := date, t := t),
                struct_pack(t := t, e := -datediff('day', date '1970-01-01', date))) as best
              from dd where t is not null group by 1)
        select spans.user_id, 'This day : ' || {_status_sql('day', False)} as today,
               coalesce({_json('k.tasks')}, '[]') as tasks,
               {hms('cast(floor(mean_day.m) as bigint)')} as average_day,
               {hms('m.best.t')} || ' (' || {iso('m.best.date')} || ')' as maximum,
               'This week : ' || {_status_sql('week', False)} as week,
               'This year : ' || {_status_sql('year', True)} as year
        from spans {_MEAN_JOINS} join m on m.user_id = spans.user_id
        left join k on k.user_id = spans.user_id""",
)
def text_summary(spark, sf_dir):
    return reports.text_summary(event_records(spark, sf_dir), EVENTS_AS_OF)


@query(
    "text_summary_full",
    f"""with {RE}, d as (select distinct user_id, task_name, date from re),
        i as (select *, date - cast(row_number() over (partition by user_id, task_name order by date)
              as int) as island from d),
        g as (select user_id, task_name, island, count(*) as n from i group by 1, 2, 3),
        s as (select user_id, task_name, max(n) as longest, max_by(n, island) as current from g group by 1, 2),
        k as (select user_id, list(task_name || ' : ' || current || ' (max : ' || longest || ')'
              order by task_name) as streaks from s group by 1),
        q as (select user_id, date_trunc('week', date) as w, {total()} as t from re
              where date between date '2024-01-15' and date '2024-01-28' group by 1, 2),
        p as (select user_id, list({iso('w')} || ' : ' || {hms('t')} order by w desc) as weeks
              from q where t is not null group by 1)
        select k.user_id, {_json('k.streaks')} as streaks, coalesce({_json('p.weeks')}, '[]') as past_weeks
        from k left join p on p.user_id = k.user_id""",
)
def text_summary_full(spark, sf_dir):
    """The two optional parts of the text summary."""
    summary = reports.text_summary(
        event_records(spark, sf_dir), EVENTS_AS_OF, all_streaks=True, weeks=2
    )
    return summary.select("user_id", "streaks", "past_weeks")
