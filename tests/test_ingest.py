import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronofold.functions import keys
from chronofold.operators import ingest, quality

TASKS = "task_id long, task_name string, subtask string, guid string"
TAGS = "tag_id long, tag string, guid string"


@pytest.fixture
def tasks(spark):
    rows = [(1, "Work", None, "g1"), (2, "Work", "Mail", "g2"), (3, "Read", None, "g3")]
    return spark.createDataFrame(rows, TASKS)


@pytest.fixture
def tags(spark):
    return spark.createDataFrame([(1, "home", "t1"), (2, "office", "t2")], TAGS)


def stamp(text):
    return dt.datetime.fromisoformat(text)


def test_new_tasks_are_normalised_and_unique(spark, tasks):
    incoming = spark.createDataFrame(
        [("work", None), ("WORK", "mail"), ("work", "phone"), ("Work", "Phone"), ("read", ""), ("sing", None)],
        "task_name string, subtask string",
    )
    added = ingest.new_tasks(incoming, tasks).collect()
    assert {(r.task_name, r.subtask) for r in added} == {("Work", "Phone"), ("Sing", None)}
    assert all(len(r.guid) == 26 for r in added)
    everything = ingest.add_tasks(incoming, tasks)
    assert everything.count() == 5
    assert ingest.new_tasks(incoming, everything).count() == 0
    assert quality.duplicates(everything, ["task_name", "subtask"]).count() == 0


def test_missing_subtasks_are_equal(spark, tasks):
    named = spark.createDataFrame([(1, "Work", None), (2, "Work", "Mail"), (3, "Work", "x")], "n long, task_name string, subtask string")
    assert {r.n: r.task_id for r in ingest.resolve_task_names(named, tasks).collect()} == {1: 1, 2: 2, 3: None}


def test_task_ids_from_text(spark, tasks):
    incoming = spark.createDataFrame([(1, "work"), (2, "work/mail"), (3, " sing loud "), (4, "sing loud")], "n long, task_text string")
    complete, resolved = ingest.task_ids_from_text(incoming, tasks)
    ids = {r.n: r.task_id for r in resolved.collect()}
    assert ids[1] == 1 and ids[2] == 2 and ids[3] == ids[4] is not None
    assert complete.count() == 4


def test_resolve_keys(spark, tasks, tags):
    incoming = spark.createDataFrame(
        [(1, "g1", "t1"), (2, "g1", None), (3, "zz", "t1"), (4, "g2", "zz"), (5, None, None)],
        "n long, task_guid string, tag_guid string",
    )
    got = {r.n: (r.task_id, r.tag_id, r.problem) for r in ingest.resolve_keys(incoming, tasks, tags).collect()}
    assert got == {
        1: (1, 1, None),
        2: (1, None, None),
        3: (None, 1, "unknown task"),
        4: (2, None, "unknown tag"),
        5: (None, None, "unknown task"),
    }


def test_update_replaces_both_names_and_the_last_change_counts(spark, tasks):
    changes = spark.createDataFrame(
        [("g2", "old", "x", 1), ("g2", "letters", None, 2), ("zz", "nobody", None, 1)],
        "guid string, task_name string, subtask string, seq int",
    )
    rows = {r.guid: (r.task_name, r.subtask) for r in ingest.update_tasks(tasks, changes).collect()}
    assert rows == {"g1": ("Work", None), "g2": ("Letters", None), "g3": ("Read", None)}


def test_referenced_rows_are_not_deleted(spark, tasks):
    records = spark.createDataFrame([(1,), (1,), (3,)], "task_id long")
    wanted = spark.createDataFrame([("g1",), ("g2",), ("zz",)], "guid string")
    outcome = ingest.deletion_outcome(tasks, "task_id", wanted, records).collect()
    assert {r.guid: r.outcome for r in outcome} == {"g1": "blocked", "g2": "deleted", "zz": "unknown"}
    left = ingest.delete_unreferenced(tasks, "task_id", wanted, records)
    assert {r.guid for r in left.collect()} == {"g1", "g3"}


def test_merge_tags(spark, tags):
    records = spark.createDataFrame([(1,), (None,)], "tag_id long")
    changes = spark.createDataFrame(
        [
            ("rename", "t1", "house", 1),
            ("delete", "t1", None, 2),
            ("delete", "t2", None, 3),
            ("add", None, "house", 4),
            ("add", None, "travel", 5),
            ("add", None, "travel", 6),
        ],
        "operation string, guid string, tag string, seq int",
    )
    assert sorted(r.tag for r in ingest.merge_tags(tags, changes, records).collect()) == ["house", "travel"]


def test_typed_records(spark):
    incoming = spark.createDataFrame(
        [
            ("a", "2025-01-01", "12:00:00", "12:05:00"),
            ("b", "2025-01-01", "23:50:00", "00:10:00"),
            ("c", "2025-01-01", "08:00:00", "08:00:00"),
            ("d", "2025-01-01", "08:00:00", None),
            ("e", "2025-02-30", "08:00:00", "09:00:00"),
        ],
        "guid string, date string, time_beginning string, time_ending string",
    )
    rows = {r.guid: r for r in ingest.typed_records(incoming).collect()}
    assert [rows[k].elapsed_s for k in "abcd"] == [300, 1200, 86400, None]
    assert rows["b"].end_ts == stamp("2025-01-02 00:10:00")
    assert rows["c"].end_ts == stamp("2025-01-02 08:00:00")
    assert rows["d"].end_ts is None and rows["d"].begin_ts == stamp("2025-01-01 08:00:00")
    assert rows["e"].date is None and rows["e"].begin_ts is None
    beginnings = ingest.typed_records(incoming.drop("time_ending"))
    assert beginnings.filter("end_ts is not null or elapsed_s is not null").count() == 0


RECORDS = "record_id string, task_id long, date date, begin_ts timestamp_ntz, end_ts timestamp_ntz, elapsed_s long, tag_id long, log string"


@pytest.fixture
def records(spark):
    day = dt.date(2025, 1, 1)
    begin = stamp("2025-01-01 09:00:00")
    end = stamp("2025-01-01 09:10:00")
    rows = [("a", 1, day, begin, None, None, 7, "kept"), ("b", 1, day, begin, end, 600, None, None)]
    return spark.createDataFrame(rows, RECORDS)


def test_endings_close_records(spark, records):
    endings = spark.createDataFrame(
        [("a", stamp("2025-01-01 09:30:00"), "first", 1), ("a", stamp("2025-01-01 10:00:00"), None, 2)],
        "record_id string, time_ending timestamp_ntz, log string, seq int",
    )
    rows = {r.record_id: r for r in ingest.add_endings(records, endings).collect()}
    assert (rows["a"].elapsed_s, rows["a"].log, rows["a"].end_ts) == (3600, None, stamp("2025-01-01 10:00:00"))
    assert (rows["b"].elapsed_s, rows["b"].end_ts) == (600, stamp("2025-01-01 09:10:00"))


def test_edits_keep_tag_and_log_unless_new(spark, records):
    edits = spark.createDataFrame(
        [("a", 2, dt.date(2025, 3, 1), stamp("2025-03-01 23:00:00"), stamp("2025-03-01 01:00:00"), None, None, 1)],
        RECORDS.replace("elapsed_s long, ", "") + ", seq int",
    )
    rows = {r.record_id: r for r in ingest.apply_edits(records, edits).collect()}
    edited = rows["a"]
    assert (edited.task_id, str(edited.date), edited.elapsed_s) == (2, "2025-03-01", 7200)
    assert (edited.tag_id, edited.log) == (7, "kept")
    assert rows["b"].elapsed_s == 600


def test_extend_last(spark):
    rows = [(1, 1, stamp("2025-01-01 09:00:00"), None, 5), (2, 1, stamp("2025-01-01 10:00:00"), None, None), (3, 2, stamp("2025-01-01 12:00:00"), None, None)]
    records = spark.createDataFrame(rows, "record_id long, user_id long, begin_ts timestamp_ntz, end_ts timestamp_ntz, elapsed_s long")
    got = {r.user_id: r for r in ingest.extend_last(records, stamp("2025-01-01 11:00:00")).collect()}
    assert (got[1].record_id, got[1].elapsed_s) == (2, 3600)
    assert (got[2].elapsed_s, got[2].end_ts) == (82800, stamp("2025-01-02 11:00:00"))


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_now_is_a_wall_clock_time_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(1, 1, "2025-01-01 09:00:00")]
        records = spark.createDataFrame(rows, "record_id long, user_id long, b string")
        records = records.selectExpr("record_id", "user_id", "cast(b as timestamp_ntz) as begin_ts")
        row = ingest.extend_last(records, stamp("2025-01-01 11:00:00")).first()
        assert (row.elapsed_s, row.end_ts) == (7200, stamp("2025-01-01 11:00:00"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_record_problems(spark):
    good = "x" * 26
    incoming = spark.createDataFrame(
        [
            (0, "old", None, "2025-01-01", "12:00:00", "12:05:00"),
            (1, "begin", good, "2025-01-01", "12:00:00", None),
            (2, "ending", good, None, None, "12:00:00"),
            (3, "ending", None, None, None, None),
            (4, "edit", "short", "01.01.2025", "noon", "12:00:00"),
            (5, "old", None, None, None, None),
            (6, "delete", None, "2025-01-01", "12:00:00", None),
            (7, "begin", None, "2025-06-01", "12:00:00", None),
            (8, "old", None, "2025-02-29", "24:00:00", "12:60:00"),
            (9, None, good, "2025-01-01", "12:00:00", None),
        ],
        "n long, operation string, guid string, date string, time_beginning string, time_ending string",
    )
    rows = quality.record_problems(incoming, stamp("2025-05-31 12:00:00")).collect()
    assert {r.n: r.problems for r in rows} == {
        0: [],
        1: [],
        2: [],
        3: ["guid", "time_ending"],
        4: ["guid", "date", "time_beginning"],
        5: ["date", "time_beginning", "time_ending"],
        6: ["operation"],
        7: ["future"],
        8: ["date", "time_beginning", "time_ending"],
        9: ["operation"],
    }


def test_name_problems(spark):
    from pyspark.sql import functions as F

    names = ["ok", "two words", "12", "-3", "+1_000", "0", "3a", "", None]
    frame = spark.createDataFrame([(n,) for n in names], "name string").select(
        quality.name_problem(F.col("name"), required=True).alias("task"),
        quality.name_problem(F.col("name")).alias("tag"),
    )
    rows = frame.collect()
    assert [r.task for r in rows] == [None, "whitespace", "number", "number", "number", "number", None, "empty", "empty"]
    assert [r.tag for r in rows][-2:] == [None, None]


def test_orphans(spark, tasks, tags):
    records = spark.createDataFrame([("a", 1, 1), ("b", 9, None), ("c", 2, 9), ("d", 9, 9)], "record_id string, task_id long, tag_id long")
    rows = quality.orphans(records, tasks, tags).collect()
    assert sorted((r.record_id, r.problem) for r in rows) == [
        ("b", "unknown task"), ("c", "unknown tag"), ("d", "unknown tag"), ("d", "unknown task"),
    ]


@pytest.mark.parametrize("generations", [1, 3])
def test_names_renamed_often_still_get_a_key(spark, monkeypatch, generations):
    monkeypatch.setattr(keys, "GENERATIONS", generations)
    name, other = F.lit("New Task"), F.lit(None).cast("string")
    held = spark.range(6).select(
        keys.stable_id(name, other, generation=F.col("id")).alias("task_id"),
        F.concat(F.lit("Old "), F.col("id").cast("string")).alias("task_name"),
        other.alias("subtask"),
        F.lit("g").alias("guid"),
    )
    asked = spark.createDataFrame([("new task", None), ("fresh", None)], "task_name string, subtask string")
    added = {r.task_name: r.task_id for r in ingest.new_tasks(asked, held).collect()}
    want = spark.range(1).select(keys.stable_id(name, other, generation=F.lit(6)), keys.stable_id(F.lit("Fresh"), other))
    assert (added["New Task"], added["Fresh"]) == tuple(want.first()) and len(added) == 2
