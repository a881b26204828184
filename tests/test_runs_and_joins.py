"""Streaks from months, joins on missing and hot keys, reports of one scan."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import ingest, quality, reports, streaks
from chronofold.plans import runs, uses
from chronofold.plans.selection import join_tags
from chronofold.sources import schema, tables
from chronofold.streaming import late

_BY = ("user_id", "task_name")


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def _dated(spark, days):
    """(user, task, date) rows."""
    return spark.createDataFrame(days, "user_id long, task_name string, date date")


def test_streaks_of_months_are_those_of_days(spark):
    rng, days = random.Random(4), []
    for user in range(40):
        day = dt.date(2023, 11, 20) + dt.timedelta(days=rng.randrange(30))
        for _ in range(rng.randrange(1, 9)):
            for _ in range(rng.choice((1, 2, 5, 31, 45, 130))):
                days += [(user, rng.choice("AAAAAB") if user % 2 else "A", day)] * rng.choice((1, 1, 2))
                day += dt.timedelta(days=1)
            day += dt.timedelta(days=rng.choice((1, 1, 3, 40)))
    frame = _dated(spark, days).withColumn("elapsed_s", F.lit(1).cast("long"))
    want = _rows(streaks.streaks(frame).select(*_BY, "longest_streak", "current_streak", "current_is_longest"))
    got = runs.streaks_of_runs(runs.month_runs(frame, _BY), _BY)
    assert _rows(got.select(*_BY, "longest_streak", "current_streak", "current_is_longest")) == want


@pytest.mark.parametrize(
    "first,last,longest,current",
    [
        ("2024-01-31", "2024-02-01", 2, 2),
        ("2024-01-01", "2024-03-31", 91, 91),
        ("2024-01-30", "2024-04-02", 64, 64),
        ("2024-02-01", "2024-02-29", 29, 29),
        ("2023-12-31", "2024-01-01", 2, 2),
        ("2024-05-05", "2024-05-05", 1, 1),
    ],
)
def test_a_run_over_months(spark, first, last, longest, current):
    day, days = dt.date.fromisoformat(first), []
    while day <= dt.date.fromisoformat(last):
        days.append((1, "A", day))
        day += dt.timedelta(days=1)
    got = runs.streaks_of_runs(runs.month_runs(_dated(spark, days), _BY), _BY).first()
    assert (got.longest_streak, got.current_streak) == (longest, current)
    later = runs.month_runs(_dated(spark, [*days, (1, "A", dt.date(2024, 12, 9)), (1, "A", None)]), _BY)
    got = runs.streaks_of_runs(later, _BY).first()
    assert (got.longest_streak, got.current_streak) == (longest, 1)


def test_a_merge_makes_only_its_months_anew(spark, tmp_path):
    root = str(tmp_path)

    def entry(key, day):
        begin = dt.datetime.combine(day, dt.time(9))
        return (key, 1, 1, day, begin, begin + dt.timedelta(minutes=1), 60, None, None)

    days = [dt.date(2024, 1, 30), dt.date(2024, 2, 1), dt.date(2024, 2, 2), dt.date(2024, 5, 1)]
    frame = spark.createDataFrame([entry(str(n), d) for n, d in enumerate(days)], schema.RECORDS)
    tables.write_records(frame, root)
    tables.write_dimension(spark.createDataFrame([(1, "A", None, "g")], schema.TASKS), root, "tasks")
    tables.write_dimension(spark.createDataFrame([], schema.TAGS), root, "tags")
    runs.keep(spark, root, uses.keep(spark, root, "0", "u"), "r")
    assert _rows(runs.stored_streaks(spark, root, "r")) == [(1, "A", 2, 1, False)]
    bridge = spark.createDataFrame([entry("x", dt.date(2024, 1, 31))], schema.RECORDS)
    batch = bridge.withColumns({"operation": F.lit("old"), "seq": F.lit(1)})
    late.merge_batch(spark, root, batch, "r", "s")
    assert _rows(runs.stored_streaks(spark, root, "s")) == [(1, "A", 4, 1, False)]
    counts = {(r.kind, r.key, r.month): r.records for r in uses.read(spark, root, "s").collect()}
    assert counts == {("task_id", 1, "2024-01"): 2, ("task_id", 1, "2024-02"): 2, ("task_id", 1, "2024-05"): 1}
    tasks = spark.createDataFrame([(1, "A", None, "g"), (2, "B", None, "h")], schema.TASKS)
    wanted = spark.createDataFrame([("g",), ("h",), ("none",)], "guid string")
    by_counts = ingest.deletion_outcome(tasks, "task_id", wanted, uses.used(uses.read(spark, root, "s"), "task_id"))
    by_records = ingest.deletion_outcome(tasks, "task_id", wanted, tables.read_records(spark, root, "s"))
    assert _rows(by_counts) == _rows(by_records) == [("g", "blocked"), ("h", "deleted"), ("none", "unknown")]
    assert uses.used(uses.read(spark, root, "s"), "tag_id").collect() == []
    assert tables.listing(spark, root, "s")["runs"] == {"2024-01": "s", "2024-02": "r", "2024-05": "r"}
    assert runs.stored_streaks(spark, root, "s", "b%").collect() == []


@pytest.fixture
def shuffled(spark):
    """No side is small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_records_without_a_tag_are_spread(spark, shuffled):
    """Nine of ten records have no tag; in a shuffle by tag they all met in one task."""
    rows = [(n, n % 50, 1 if n % 10 == 0 else None) for n in range(5000)] + [(9999, 1, 77)]
    records = spark.createDataFrame(rows, "record_id long, user_id long, tag_id long").repartition(4)
    tags = spark.createDataFrame([(1, "one", "g"), (2, "two", "h")], schema.TAGS)
    joined = join_tags(records, tags)
    assert joined.columns == ["tag_id", "record_id", "user_id", "tag"]
    assert "_tag_key" in _plan(joined) and "BroadcastHashJoin" not in _plan(joined)
    got = sorted(joined.collect(), key=lambda r: r.record_id)
    assert [(r.record_id, r.user_id, r.tag_id) for r in got] == rows
    assert all(r.tag == ("one" if r.tag_id == 1 else None) for r in got)
    keys = records.select(F.coalesce(F.col("tag_id"), _key_of(records)).alias("k"))
    parts = keys.repartition(8, "k").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * 5001 / 8


def _key_of(records):
    from chronofold.plans.selection import _spread_null

    return _spread_null(records)


def test_orphans_look_dimensions_up_by_distinct_keys(spark, shuffled):
    rows = [(n, 1 if n % 3 else 9, None if n % 10 else 5, "a long text") for n in range(900)]
    records = spark.createDataFrame(rows, "record_id long, task_id long, tag_id long, log string")
    tasks = spark.createDataFrame([(1, "A", None, "g")], schema.TASKS)
    tags = spark.createDataFrame([(6, "t", "g")], schema.TAGS)
    found = quality.orphans(records, tasks, tags)
    want = [(n, "unknown task") for n, t, _, _ in rows if t == 9] + [(n, "unknown tag") for n, _, g, _ in rows if g == 5]
    assert sorted((r.record_id, r.problem) for r in found.collect()) == sorted(want)
    assert found.columns == [*records.columns, "problem"]
    nothing = quality.orphans(records.where("false"), tasks, tags)
    assert nothing.collect() == []


def test_pages_and_reports_scan_the_records_once(spark, tmp_path, monkeypatch):
    """What a page puts together reads the shared sums; only these were made from the records."""
    path = str(tmp_path / "records")
    rows = [(n % 5, f"T{n % 3}", None, dt.date(2024, 1, 1) + dt.timedelta(days=n % 400), 60, None, str(n)) for n in range(900)]
    columns = "user_id long, task_name string, subtask string, date date, elapsed_s long, tag string, record_id string"
    spark.createDataFrame(rows, columns).write.parquet(path)
    records = spark.read.schema(columns).parquet(path)
    scans, whole = [], reports.kept

    def kept(frame, purpose):
        scans.append(_plan(frame).count("FileScan parquet"))
        assert all(path in file for file in frame.inputFiles())
        return whole(frame, purpose)

    monkeypatch.setattr(reports, "kept", kept)
    as_of = dt.date(2024, 12, 31)
    for page in (
        reports.page_day(records, dt.date(2024, 3, 1), as_of),
        reports.page_week(records, dt.date(2024, 3, 1), as_of),
        reports.page_month(records, "2024-03", as_of),
        reports.page_year(records, 2024, as_of),
    ):
        assert not any(path in file for file in page.inputFiles()) and page.collect()
    log = tables.WorkLog(
        records.withColumns({"task_id": F.lit(1).cast("long"), "tag_id": F.lit(None).cast("long")}).drop("task_name", "subtask", "tag"),
        spark.createDataFrame([(1, "A", None, "g")], schema.TASKS),
        spark.createDataFrame([], schema.TAGS),
    )
    elements = [{"element": "timer-info"}, {"element": "task-ratio"}, {"element": "line-chart", "column-period": "month"}]
    report = reports.custom_report(log, {"rangeBeginning": "2024-01-01", "rangeEnding": "2024-12-31", "stats": elements}, as_of)
    for frame in report.values():
        assert not any(path in file for file in frame.inputFiles()) and frame.collect()
    assert scans == [1] * 5
    for page in (reports.page_month(records, None, as_of), reports.page_week(records, None, as_of)):
        assert _plan(page).count("FileScan parquet") == 1  # a chart and nothing else
