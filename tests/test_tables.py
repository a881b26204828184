import datetime as dt
import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.operators import search, totals
from chronofold.plans import daily
from chronofold.plans.period import Period
from chronofold.plans.selection import RecordFilter, select_records
from chronofold.sources import schema, tables
from chronofold.sources.session import scratch_dir
from chronofold.streaming import late


def row(key, day, seconds=60, user=1):
    begin = dt.datetime.combine(day, dt.time(9))
    return (key, user, 1, day, begin, begin + dt.timedelta(seconds=seconds), seconds, None, None)


@pytest.fixture
def root(spark, tmp_path):
    days = [dt.date(2024, 12, 31), dt.date(2025, 1, 1), dt.date(2025, 1, 31), dt.date(2025, 2, 1)]
    records = spark.createDataFrame([row(str(n), d) for n, d in enumerate(days)], schema.RECORDS)
    tables.write_records(records, str(tmp_path))
    tables.write_dimension(spark.createDataFrame([(1, "A", None, "g")], schema.TASKS), str(tmp_path), "tasks")
    tables.write_dimension(spark.createDataFrame([], schema.TAGS), str(tmp_path), "tags")
    return str(tmp_path)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_months_are_folders_and_a_period_reads_only_its_own(spark, root):
    folder = f"{root}/records/version=0"
    assert sorted(n for n in os.listdir(folder) if n.startswith("month=")) == ["month=2024-12", "month=2025-01", "month=2025-02"]
    log = tables.read_worklog(spark, root)
    january = select_records(log, RecordFilter(period=Period.month("2025-01"), task="A"))
    assert sorted(r.record_id for r in january.collect()) == ["1", "2"]
    plan = plan_of(select_records(log, RecordFilter(period=Period.month("2025-01"))))
    assert "PartitionFilters: [isnotnull(month" in plan and "GreaterThanOrEqual(date" in plan
    assert totals.total_time(january).first().total_time == 120


def test_unused_columns_are_not_read(spark, root):
    log = tables.read_worklog(spark, root)
    plan = plan_of(totals.total_per_day(log.records, Period.month("2025-01")))
    read = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "log" not in read and "begin_ts" not in read and "elapsed_s" in read


def stored_rows(spark, root, version):
    return {r.record_id: (str(r.date), r.elapsed_s, r.month) for r in tables.read_records(spark, root, version).collect()}


_MERGED = {
    "0": ("2024-12-31", 60, "2024-12"),
    "1": ("2025-01-01", 99, "2025-01"),
    "2": ("2025-01-31", 60, "2025-01"),
    "3": ("2025-01-05", 70, "2025-01"),
    "9": ("2025-03-01", 80, "2025-03"),
}


@pytest.fixture
def changed(spark):
    rows = [row("1", dt.date(2025, 1, 1), 99), row("3", dt.date(2025, 1, 5), 70), row("9", dt.date(2025, 3, 1), 80)]
    return spark.createDataFrame(rows, schema.RECORDS)


def test_a_merge_replaces_moves_and_adds_in_a_version_of_its_own(spark, root, changed):
    first = stored_rows(spark, root, "0")
    assert tables.merge_records(spark, root, changed, "0", "1") == ["2025-01", "2025-02", "2025-03"]
    assert stored_rows(spark, root, "1") == _MERGED
    assert stored_rows(spark, root, "0") == first  # whoever reads the old version goes on reading it
    written = sorted(n for n in os.listdir(f"{root}/records/version=1") if n.startswith("month="))
    assert written == ["month=2025-01", "month=2025-03"]  # nothing of months that did not change
    # the emptied month is gone, an untouched one is read from where it was
    assert tables.listing(spark, root, "1")["records"] == {"2024-12": "0", "2025-01": "1", "2025-03": "1"}
    assert sorted(r.version for r in tables.versions(spark, root).collect()) == ["0", "1"]


def test_places_have_one_row_a_record_whatever_was_merged(spark, root, changed):
    for number in range(1, 4):
        tables.merge_records(spark, root, changed, str(number - 1), str(number))
    ids = spark.createDataFrame([(str(n),) for n in range(12)], "record_id string")
    places = sorted((r.record_id, r.at) for r in tables.places_of(spark, root, "3", ids).collect())
    assert places == [("0", "2024-12"), ("1", "2025-01"), ("2", "2025-01"), ("3", "2025-01"), ("9", "2025-03")]


class FakeSession:
    """Just the settings ``scratch_dir`` reads; the real one cannot be changed while it runs."""

    def __init__(self, master, **settings):
        self.conf = self
        self.sparkContext = self
        self.master = master
        self._settings = settings

    def get(self, name, default):
        return self._settings.get(name.replace(".", "_"), default)


def test_scratch_follows_the_cluster_setting():
    shared = FakeSession("spark://host:7077", spark_checkpoint_dir="hdfs:///shared/")
    assert scratch_dir(shared, "x").startswith("hdfs:///shared/x-")
    with pytest.raises(RuntimeError):
        scratch_dir(FakeSession("spark://host:7077"), "x")
    assert os.path.isdir(scratch_dir(FakeSession("local[2]"), "x"))


def test_daily_totals_follow_a_merge(spark, root):
    daily.keep(spark, root, "0", "d")
    before = {(r.user_id, str(r.date), r.task_name): r.elapsed_s for r in daily.read(spark, root, "d").collect()}
    assert before[1, "2025-02-01", "A"] == 60 and len(before) == 4
    columns = [f.name for f in schema.RECORDS.fields]
    changed = [row("3", dt.date(2025, 1, 31), 70), row("8", dt.date(2025, 1, 31), 5)]
    batch = spark.createDataFrame(changed, schema.RECORDS).selectExpr(*columns, "'old' operation", "1 seq")
    assert not daily.stored(spark, root, "0")
    late.merge_batch(spark, root, batch, "d", "e")
    rows = {str(r.date): (r.elapsed_s, r.record_count) for r in daily.read(spark, root, "e").collect()}
    assert rows == {"2024-12-31": (60, 1), "2025-01-01": (60, 1), "2025-01-31": (135, 3)}
    january = totals.timer_count(in_month(daily.read(spark, root, "e"))).first()
    assert january["count"] == 4
    assert len(daily.read(spark, root, "d").collect()) == 4


def ids_of(frame):
    return sorted(r.record_id for r in frame.collect())


def in_month(frame):
    return tables.in_period(frame, Period.month("2025-01"))


@pytest.mark.parametrize("step", range(7))
def test_a_merge_that_dies_at_any_write_leaves_the_old_version_and_is_run_again(
    spark, root, changed, monkeypatch, step
):
    """Steps: incoming rows, rejected ones, unique rows, months, places, daily totals, listing."""
    daily.keep(spark, root, "0", "d")
    first = stored_rows(spark, root, "d")
    columns = [f.name for f in schema.RECORDS.fields]
    lost = spark.createDataFrame([row("x", dt.date(2025, 1, 1))], schema.RECORDS).withColumn("date", F.lit(None).cast("date"))
    batch = changed.unionByName(lost).selectExpr(*columns, "'old' operation", "1 seq")
    whole, count = DataFrameWriter.parquet, [0]

    def dies(self, path, *args, **named):
        if "pending" not in path:
            count[0] += 1
            if count[0] - 1 == step:
                whole(self, path, *args, **named)  # the job ends after its files and before its next step
                raise RuntimeError("driver lost")
        return whole(self, path, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(RuntimeError):
        late.merge_batch(spark, root, batch, "d", "e", "run")
    monkeypatch.setattr(DataFrameWriter, "parquet", whole)
    assert count[0] == step + 1
    assert stored_rows(spark, root, "d") == first
    assert len(daily.read(spark, root, "d").collect()) == 4
    if step < 6:
        assert [r.version for r in tables.versions(spark, root).filter("version = 'e'").collect()] == []
    late.merge_batch(spark, root, batch, "d", "e", "run")
    assert stored_rows(spark, root, "e") == _MERGED
    assert {str(r.date) for r in daily.read(spark, root, "e").collect()} == {v[0] for v in _MERGED.values()}
    assert [(r.record_id, r.run) for r in tables.rejected_records(spark, root).collect()] == [("x", "run")]


def test_incomplete_rows_are_rejected_and_repeated_keys_stored_once(spark, root):
    rows = [row("1", dt.date(2025, 1, 1), 5), row("1", dt.date(2025, 1, 1), 7)]
    nothing = (None,) * 4
    rows += [("7", 1, 1, None, *nothing, None), (None, 1, 1, dt.date(2025, 1, 1), *nothing, None)]
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema.RECORDS.fields])
    changed = spark.createDataFrame(rows, nullable)
    assert tables.merge_records(spark, root, changed, "0", "b1") == ["2025-01"]
    tables.merge_records(spark, root, changed, "0", "b1")
    rejected = tables.rejected_records(spark, root).collect()
    assert sorted((r.record_id or "", r.problem, r.run) for r in rejected) == [("", "no key", "b1"), ("7", "no date", "b1")]
    stored = [r.elapsed_s for r in tables.read_records(spark, root, "b1").collect() if r.record_id == "1"]
    assert stored == [7]
    nothing_new = changed.filter("record_id is null")
    assert tables.merge_records(spark, root, nothing_new, "b1", "b2") == []
    assert stored_rows(spark, root, "b2") == stored_rows(spark, root, "b1")


def test_a_merge_reads_only_touched_months(spark, root):
    with open(f"{root}/records/version=0/month=2025-02/broken.parquet", "w") as file:
        file.write("no Parquet: reading this month fails")
    changed = spark.createDataFrame([row("0", dt.date(2025, 1, 2), 70)], schema.RECORDS)
    assert tables.merge_records(spark, root, changed, "0", "1") == ["2024-12", "2025-01"]


def test_a_lookup_opens_only_the_files_that_may_hold_its_ids(spark, tmp_path):
    """Of 400 records in 12 months, three ids open three buckets and two months."""
    days = [dt.date(2025, 1 + n % 12, 1 + n % 28) for n in range(400)]
    records = spark.createDataFrame([row(str(n), d) for n, d in enumerate(days)], schema.RECORDS)
    root = str(tmp_path)
    tables.write_records(records, root)
    wanted = spark.createDataFrame([("12",), ("24",), ("25",), ("none",)], "record_id string")
    places = tables.places_of(spark, root, "0", wanted, ["12", "24", "25", "none"])
    plan = plan_of(places)
    files = len(places.inputFiles())
    assert 1 <= files <= 4 and "PushedFilters: [In(record_id" in plan
    found = tables.records_of(spark, root, "0", wanted)
    assert {f.split("month=")[1][:7] for f in found.inputFiles() if "month=" in f} == {"2025-01", "2025-02"}
    assert "PushedFilters: [In(record_id" in plan_of(found)
    assert ids_of(found) == ["12", "24", "25"]


def test_find_by_keys_gives_named_records(spark, root):
    wanted = spark.createDataFrame([("2",), ("2",), ("none",), (None,)], "record_id string")
    assert [(r.record_id, r.task_name) for r in search.find_by_keys(spark, root, wanted).collect()] == [("2", "A")]
    assert search.find_by_keys(spark, root, wanted.filter("record_id = 'none'")).collect() == []


def test_edits_wait_for_their_record(spark, root):
    daily.keep(spark, root, "0", "d")
    fields = [f.name for f in schema.RECORDS.fields]

    def batch(operation, *rows):
        return spark.createDataFrame(rows, schema.RECORDS).selectExpr(*fields, f"'{operation}' operation", "1 seq")

    day = dt.date(2025, 1, 9)
    edit = batch("edit", row("late", day, 600), row("0", dt.date(2024, 12, 30), 90))
    for _ in range(2):  # a retried batch writes the same version again
        late.merge_batch(spark, root, edit, "d", "e0")
        assert ids_of(late.pending_edits(spark, root, "e0")) == ["late"]
    late.merge_batch(spark, root, batch("old", row("late", dt.date(2025, 1, 3), 60)), "e0", "e1")
    assert late.pending_edits(spark, root, "e1").count() == 0
    assert ids_of(late.pending_edits(spark, root, "e0")) == ["late"]  # a reader of the old version is not disturbed
    rows = stored_rows(spark, root, "e1")
    assert rows["late"][:2] == ("2025-01-09", 600) and rows["0"][:2] == ("2024-12-30", 90)
    totals_by_day = {str(r.date): r.elapsed_s for r in daily.read(spark, root, "e1").collect()}
    assert totals_by_day["2025-01-09"] == 600 and totals_by_day["2024-12-30"] == 90
    assert "2024-12-31" not in totals_by_day
