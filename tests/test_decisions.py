"""Where the reference is broken or ambiguous: the behaviour decided on, one test per case."""

import datetime as dt

import pytest

from chronofold.operators import charts, ratios, reports, search, streaks, totals, weeks
from chronofold.plans.period import Period
from chronofold.plans.selection import RecordFilter, where
from chronofold.sources.tables import WorkLog


def test_single_filters_apply_to_daily_totals(make_records):
    records = make_records(("2025-01-01", "A"), ("2025-01-01", "B"), ("2025-01-02", "B"))
    only = where(records, RecordFilter(task="A"))
    rows = totals.total_per_day(only, Period.month("2025-01"), keys=()).collect()
    assert [(str(r.date), r.total) for r in rows] == [("2025-01-01", 300)]


def test_average_day_is_over_days_not_over_one_grand_total(make_records):
    records = make_records(("2025-01-01", "A", 100), ("2025-01-01", "B", 200), ("2025-01-03", "A", 100))
    row = totals.average_day(records, keys=()).first()
    assert (row.mean_s, row.time) == (200.0, "00:03:20")


def test_no_task_is_dropped_unless_asked(make_records):
    records = make_records(("2025-01-01", "#"), ("2025-01-01", "A"))
    assert {r.task_name for r in totals.task_list(records).collect()} == {"#", "A"}
    assert {r.task_name for r in totals.task_list(records, ["#"]).collect()} == {"A"}


def test_days_longer_than_24_hours_do_not_wrap(make_records):
    records = make_records(("2025-01-01", "A", 90000), ("2025-01-02", "A", 50000))
    row = totals.longest_day(records, keys=()).first()
    assert (str(row.date), row.time) == ("2025-01-01", "25:00:00")
    (task,) = totals.time_per_task(records, dt.date(2025, 1, 1), keys=()).collect()
    assert task.time == "25:00:00"


def test_streaks_of_different_tasks_stay_apart(make_records):
    days = ["2025-01-01", "2025-01-02", "2025-01-03", "2025-01-05", "2025-01-06"]
    records = make_records(*[(d, "Work") for d in days], ("2025-01-04", "World"), ("2025-01-06", "Work"))
    rows = {r.task_name: r for r in streaks.streaks(records, "wor%", keys=()).collect()}
    assert (rows["Work"].longest_streak, rows["Work"].current_streak) == (3, 2)
    assert not rows["Work"].current_is_longest
    assert (rows["World"].longest_streak, rows["World"].current_is_longest) == (1, True)


def test_past_weeks_may_leave_out_the_current_one():
    for day in range(9, 17):
        as_of = dt.date(2025, 3, day)
        current = Period.week_around(as_of)
        assert weeks.past_week_bounds(as_of, 3)[0] == current
        previous = weeks.past_week_bounds(as_of, 3, include_current=False)[0]
        assert previous.last == current.first - dt.timedelta(days=1)


def test_past_weeks_prints_seconds(make_records):
    records = make_records(("2025-03-04", "A", 3725), ("2025-03-20", "A"))
    rows = weeks.past_weeks(records, dt.date(2025, 3, 12), 3).collect()
    assert [(str(r.monday), r.time) for r in rows] == [
        ("2025-03-10", "00:00:00"),
        ("2025-03-03", "01:02:05"),
        ("2025-02-24", "00:00:00"),
    ]


def test_december_and_new_year(make_records):
    records = make_records(("2024-12-01", "A"), ("2024-12-31", "A"), ("2025-01-01", "A"))
    (row,) = reports.page_month(records, "2024-12", dt.date(2025, 5, 1)).collect()
    assert row.labels == ["48", "49", "50", "51", "52", "01"]
    assert row.line == [300, 0, 0, 0, 0, 300]


@pytest.mark.parametrize("month", ["2024-01", "2024-04", "2024-07"])
def test_months_that_start_on_a_monday(make_records, month):
    first = Period.month(month).first
    records = make_records((first.isoformat(), "A"), (Period.month(month).last.isoformat(), "B"))
    (row,) = reports.page_month(records, month, dt.date(2025, 5, 1)).collect()
    assert row.line[0] == 300 and row.line[-1] == 300 and len(row.line) == len(row.labels)
    groups = {r.task_name: r.week_group for r in ratios.task_ratio_weeks(records, first, Period.month(month).last + dt.timedelta(days=1)).collect()}
    assert groups["A"] == 1 and groups["B"] == len(row.labels)


def test_gaps_in_a_week_keep_their_place(make_records):
    records = make_records(("2025-03-03", "A"), ("2025-03-06", "A"))
    row = charts.line_chart(records, "day", Period.week_around("2025-03-03"), dt.date(2025, 3, 7)).first()
    assert row.data == [300, 0, 0, 300, 0, None, None]


def test_full_weeks_filter_both_sides(make_records):
    records = make_records(("2025-01-01", "A"), ("2025-01-07", "A"), ("2025-01-07", "B"))
    rows = ratios.task_ratio_weeks(records, dt.date(2025, 1, 1), dt.date(2025, 2, 1), include_partial=False).collect()
    assert {(r.week_group, r.task_name, r.week_total, r.ratio) for r in rows} == {(1, "A", 600, 50.0), (1, "B", 600, 50.0)}


def test_zero_whole_gives_no_ratio(make_records):
    records = make_records(("2025-01-01", "A", 0), ("2025-01-01", "B", None))
    rows = {r.task_name: (r.total_time, r.ratio) for r in ratios.task_ratio(records).collect()}
    assert rows == {"A": (0, None), "B": (None, None)}


def test_subtask_ratio_needs_a_task(make_records):
    with pytest.raises(KeyError):
        ratios.subtask_ratio(make_records(("2025-01-01", "A")), None)


def test_wrong_grain_is_refused(make_records):
    records = make_records(("2025-01-01", "A"))
    with pytest.raises(ValueError):
        ratios.task_ratio_by(records, "hour", Period.year(2025))
    with pytest.raises(ValueError):
        totals.mean_per_period(records, "hour", dt.date(2025, 1, 1))


def star(spark, records):
    tasks = spark.createDataFrame([(1, "A", None, "a" * 26), (2, "B", "x", "b" * 26)], "task_id long, task_name string, subtask string, guid string")
    tags = spark.createDataFrame([(1, "t", "t" * 26)], "tag_id long, tag string, guid string")
    return WorkLog(records, tasks, tags)


@pytest.fixture
def log(spark):
    rows = [
        (n, 1, 1 + n % 2, dt.date(2025, 1, 1 + n), 300, 1 if n == 3 else None, f"note {n}")
        for n in range(8)
    ]
    schema = "record_id long, user_id long, task_id long, date date, elapsed_s long, tag_id long, log string"
    return star(spark, spark.createDataFrame(rows, schema))


def test_search_pages_are_stable_and_complete(log):
    found = search.find_records(log, {})
    assert search.page_count(found, 3).first().pages == 3
    seen = [r.record_id for n in (1, 2, 3) for r in search.page(found, n, 3).collect()]
    assert seen == [7, 6, 5, 4, 3, 2, 1, 0]
    after = search.page_after(found, dt.date(2025, 1, 6), 5, 3).collect()
    assert [r.record_id for r in after] == [4, 3, 2]
    assert search.page_with_count(found, 3, 3).first().pages == 3
    assert search.page_count(found.filter("record_id < 0"), 3).first().pages == 0


def test_search_for_records_without_subtask(log):
    ids = {r.record_id for r in search.find_records(log, {"task": "A", "subtask": "None"}).collect()}
    assert ids == {0, 2, 4, 6}
    assert search.find_records(log, {"task": "B", "subtask": "None"}).count() == 0


def test_search_by_tag_and_log(log):
    (row,) = search.find_records(log, {"tag": "t", "logIncludes": "NOTE 3"}).collect()
    assert (row.record_id, row.task_name, row.tag) == (3, "B", "t")


def test_search_refuses_page_zero(log):
    with pytest.raises(ValueError):
        search.page(search.find_records(log, {}), 0, 3)


def test_records_by_key_keep_untagged_ones(spark, log):
    wanted = spark.createDataFrame([(3,), (4,), (4,), (99,)], "record_id long")
    rows = {r.record_id: r.tag for r in search.by_keys(log, wanted).collect()}
    assert rows == {3: "t", 4: None}


def test_custom_report(log):
    request = {
        "rangeBeginning": "2025-01-01",
        "rangeEnding": "2025-01-08",
        "task": "B",
        "logs": True,
        "stats": [
            {"element": "timer-info"},
            {"element": "task-ratio"},
            {"element": "subtask-ratio"},
            {"element": "line-chart", "column-period": "day"},
            {"element": "stacked-column-chart", "column-period": "week"},
        ],
    }
    report = reports.custom_report(log, request, dt.date(2025, 2, 1))
    info = report["timer-info"].first()
    assert (info["count"], info.time) == (4, ["00", "20", "00"])
    assert report["task-ratio"].first().ratio == 100.0
    assert report["subtask-ratio"].first().subtask == "x"
    line = report["line-chart:day"].first()
    assert line.data == [0, 300] * 4 and line.labels[1] == "2025-01-02"
    assert report["stacked-column-chart:week"].first().data == [100.0, 100.0]
    assert report["logs"].count() == 4


def test_custom_report_with_one_period_is_its_page(log):
    report = reports.custom_report(log, {"month": "2025-01"}, dt.date(2025, 2, 1))
    assert report["page"].first().line == [1500, 900, 0, 0, 0]


@pytest.mark.parametrize(
    "request_",
    [
        {"rangeBeginning": "2025-01-01", "rangeEnding": "2025-01-08", "tag": "t"},
        {"year": "2025", "task": "A", "stats": [{"element": "pie"}]},
        {"year": "2025", "task": "A", "stats": [{"element": "line-chart"}]},
    ],
)
def test_custom_report_refuses_bad_requests(log, request_):
    with pytest.raises(KeyError):
        reports.custom_report(log, request_, dt.date(2025, 2, 1))


def test_page_by_request(make_records):
    records = make_records(("2025-01-01", "A"))
    as_of = dt.date(2025, 1, 2)
    assert "detail" in reports.page(records, {"day": "2025-01-01"}, as_of).columns
    assert len(reports.page(records, {"week": "2025-01-01"}, as_of).first().labels) == 7
    assert len(reports.page(records, {"year": "2025"}, as_of).first().labels) == 12
    with pytest.raises(KeyError):
        reports.page(records, {"tag": "x"}, as_of)


def test_home_summary(make_records):
    records = make_records(
        ("2025-03-05", "A", 100), ("2025-03-03", "A", 90000), ("2025-01-01", "A", 50), ("2024-12-31", "A", 7)
    )
    row = reports.home_summary(records, dt.date(2025, 3, 5)).first()
    assert (row.daily["count"], row.daily.time, row.daily.mean) == (1, ["00", "01", "40"], ["08", "20", "50"])
    assert (row.weekly["count"], row.weekly.time, row.weekly.mean) == (2, ["25", "01", "40"], ["12", "31", "15"])
    assert (row.monthly["count"], row.monthly.time) == (2, ["01", "01", "01", "40"])
    assert (row.yearly["count"], row.yearly.time) == (3, ["01", "01", "02", "30"])
    assert "mean" not in row.yearly.asDict()


def test_text_summary(make_records):
    records = make_records(("2025-03-04", "A", 60), ("2025-03-05", "A", 60), ("2025-03-05", "B", None))
    row = reports.text_summary(records, dt.date(2025, 3, 5)).first()
    assert row.today == "This day : 2 timers (00:01:00)."
    assert row.tasks == ["A : 00:01:00 (100.0%) Current streak : 2 (max streak!)"]
    assert (row.average_day, row.maximum) == ("00:01:00", "00:01:00 (2025-03-04)")
    assert row.week == "This week : 3 timers (00:02:00)."


def test_running_records_are_reported(make_records):
    row = totals.open_records(make_records(("2025-03-04", "A", None))).first()
    assert (row["count"], row.open_count, row.status) == (1, 1, "1 timer (ongoing).")


def test_nothing_recorded_counts_zero(make_records):
    nothing = make_records(("2025-03-04", "A")).filter("date > date '2026-01-01'")
    assert totals.total_time(nothing, keys=()).first().total_time == 0
    assert totals.timer_count(nothing, keys=()).first()["count"] == 0
    mean = totals.mean_per_period(nothing, "month", dt.date(2025, 1, 1), keys=()).first()
    assert mean.mean_month == 0.0
    rows = weeks.past_weeks(nothing, dt.date(2025, 3, 12), 3, keys=()).collect()
    assert [r.total_time for r in rows] == [0, 0, 0]
