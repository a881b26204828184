"""Streams over several micro-batches: one file per batch, in order of their names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronofold.sources import schema, tables
from chronofold.streaming import late, pairing, running
from chronofold.streaming.clock import event_time, wall_date


def moment(text):
    return dt.datetime.fromisoformat(f"2025-01-{text}")


@pytest.fixture
def stream_of(spark, tmp_path):
    """A stream from batches of rows, each delivered as its own micro-batch."""

    def make(columns, *batches):
        folder = tmp_path / f"in{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        for number, rows in enumerate(batches):
            frame = spark.createDataFrame(rows, columns).coalesce(1)
            frame.write.parquet(str(folder / str(number)))
        reader = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(f"{folder}/*")

    return make


RECORD = "guid string, user_id long, task_name string, begin_ts timestamp_ntz, elapsed_s long"


def timed(stream):
    return stream.withColumn("event_time", event_time(F.col("begin_ts")))


def test_event_time_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            instant = event_time(F.lit("2025-01-05 23:30:00").cast("timestamp_ntz"))
            row = spark.range(1).select(wall_date(instant).alias("d"), F.unix_seconds(instant).alias("s")).first()
            assert (str(row.d), row.s) == ("2025-01-05", 1736119800)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_daily_totals_grow_with_every_batch(spark, stream_of):
    stream = stream_of(
        RECORD,
        [("a", 1, "A", moment("01 09:00:00"), 60), ("b", 1, "A", moment("01 23:59:59"), 30)],
        [("c", 1, "A", moment("01 10:00:00"), 10), ("d", 2, "A", moment("02 00:00:00"), None)],
    )
    daily = running.drain_updates(spark, running.daily_totals(timed(stream)), [*running.KEYS, "date"], "t")
    assert sorted((r.user_id, str(r.date), r.total, r["count"]) for r in daily.collect()) == [
        (1, "2025-01-01", 100, 3),
        (2, "2025-01-02", None, 1),
    ]


def test_weeks_start_on_monday(spark, stream_of):
    stream = stream_of(RECORD, [("a", 1, "A", moment("05 23:00:00"), 1), ("b", 1, "A", moment("06 00:00:00"), 2)])
    weekly = running.drain_updates(spark, running.weekly_totals(timed(stream)), [*running.KEYS, "week_start"], "t")
    assert {str(r.week_start): r.total for r in weekly.collect()} == {"2024-12-30": 1, "2025-01-06": 2}


def test_duplicates_are_dropped_across_batches(spark, stream_of):
    row = ("a", 1, "A", moment("01 09:00:00"), 60)
    stream = stream_of(RECORD, [row, row], [row, ("b", *row[1:])])
    rows = running.drain_appends(spark, running.unique_records(timed(stream)), "t").collect()
    assert sorted(r.guid for r in rows) == ["a", "b"]


def test_an_empty_stream_gives_an_empty_table(spark, stream_of):
    stream = timed(stream_of(RECORD, [("a", 1, "A", moment("01 09:00:00"), 60)])).filter("guid = 'none'")
    assert running.drain_appends(spark, stream, "t").count() == 0


def sides(stream_of, begins, ends):
    begin = stream_of("guid string, begin_ts timestamp_ntz", *begins)
    end = stream_of("guid string, end_ts timestamp_ntz", *ends)
    return (
        begin.select("guid", event_time(F.col("begin_ts")).alias("begin_time")),
        end.select("guid", event_time(F.col("end_ts")).alias("end_time")),
    )


def test_ends_find_begins_of_earlier_batches(spark, stream_of):
    begins, ends = sides(
        stream_of,
        [[("a", moment("01 09:00:00")), ("b", moment("01 09:00:00"))], [("c", moment("01 10:00:00"))]],
        [[("x", moment("01 09:30:00"))], [("a", moment("01 10:00:00")), ("c", moment("01 10:00:00"))]],
    )
    rows = running.drain_appends(spark, pairing.paired_records(begins, ends), "t").collect()
    assert {r.guid: r.elapsed_s for r in rows} == {"a": 3600, "c": 86400}


def test_records_past_their_plan_are_closed(spark, stream_of):
    begins, ends = sides(
        stream_of,
        [
            [("a", moment("01 09:00:00")), ("b", moment("01 09:00:00"))],
            [("late", moment("05 09:00:00"))],
            [("last", moment("05 09:30:00"))],
        ],
        [[("a", moment("01 09:20:00"))], [("z", moment("05 09:00:00"))], [("z", moment("05 09:30:00"))]],
    )
    closed = pairing.closed_records(begins, ends, planned="30 minutes", delay="10 minutes")
    rows = running.drain_appends(spark, closed, "t").select("guid", "state", (F.unix_seconds("end_time") - F.unix_seconds("begin_time")).alias("s")).collect()
    assert {r.guid: (r.state, r.s) for r in rows} == {"a": ("finished", 1200), "b": ("expired", 1800)}


def test_corrections_reach_stored_months_and_may_be_repeated(spark, tmp_path):
    root = str(tmp_path / "table")
    version = tables.write_records(spark.createDataFrame([], schema.RECORDS), root)
    columns = "operation string, seq int, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in schema.RECORDS.fields
    )

    def entry(operation, seq, key, day, end, log):
        date = dt.date(2025, *day)
        begin = dt.datetime.combine(date, dt.time(9))
        return (operation, seq, key, 1, 1, date, begin, dt.datetime.combine(date, dt.time(*end)), 60, None, log)

    first = spark.createDataFrame(
        [entry("old", 1, "a", (1, 5), (9, 1), "x"), entry("old", 2, "b", (2, 5), (9, 1), "y")], columns
    )
    second = spark.createDataFrame(
        [entry("edit", 3, "a", (3, 5), (10, 0), None), entry("old", 4, "c", (1, 6), (9, 1), None), entry("edit", 5, "zz", (1, 1), (9, 1), "nobody")],
        columns,
    )
    for number, batch in enumerate((first, second, second)):
        version = late.merge_batch(spark, root, batch, version, f"m{number}")
    rows = {r.record_id: (r.month, r.elapsed_s, r.log) for r in tables.read_records(spark, root, version).collect()}
    assert rows == {"a": ("2025-03", 3600, "x"), "b": ("2025-02", 60, "y"), "c": ("2025-01", 60, None)}


def test_a_second_stream_keeps_what_the_first_one_rejected(spark, stream_of, tmp_path):
    """Both streams number their micro-batches from 0; a restarted stream goes on from its own."""
    root = str(tmp_path / "table")
    version = tables.write_records(spark.createDataFrame([], schema.RECORDS), root)
    columns = "operation string, seq int, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in schema.RECORDS.fields
    )

    def entry(operation, key, day, log=None):
        date = day and dt.date(2025, *day)
        begin = dt.datetime.combine(date or dt.date(2025, 1, 1), dt.time(9))
        return (operation, 1, key, 1, 1, date, begin, begin + dt.timedelta(minutes=1), 60, None, log)

    one = stream_of(columns, [entry("old", "a", None), entry("old", "b", (1, 5))], [entry("edit", "late", (1, 7), "e")])
    two = stream_of(columns, [entry("old", "c", None)], [entry("old", "late", (1, 6), "l"), entry("edit", "never", (1, 1))])
    version = late.drain_corrections(spark, one, root, version, str(tmp_path / "one"))
    again = late.drain_corrections(spark, one, root, "0", str(tmp_path / "one"))
    assert again == version  # nothing new has come
    middle = [r.record_id for r in late.pending_edits(spark, root, version).collect()]
    version = late.drain_corrections(spark, two, root, version, str(tmp_path / "two"))
    rejected = tables.rejected_records(spark, root).collect()
    assert sorted((r.record_id, r.problem) for r in rejected) == [("a", "no date"), ("c", "no date")]
    assert len({r.run for r in rejected}) == 2
    assert middle == ["late"]
    assert [r.record_id for r in late.pending_edits(spark, root, version).collect()] == ["never"]
    rows = {r.record_id: (str(r.date), r.log) for r in tables.read_records(spark, root, version).collect()}
    assert rows == {"b": ("2025-01-05", None), "late": ("2025-01-07", "e")}


def test_rows_behind_the_watermark_are_found_again(spark, stream_of):
    batches = [
        [("a", 1, "A", moment("20 09:00:00"), 60)],
        [("b", 1, "A", moment("21 09:00:00"), 5)],
        [("late", 1, "A", moment("02 09:00:00"), 7), ("late2", 1, "A", moment("20 10:00:00"), 1)],
        [("c", 1, "A", moment("21 10:00:00"), 2)],
    ]
    stream = timed(stream_of(RECORD, *batches))
    current = running.drain_updates(spark, running.daily_totals(stream), [*running.KEYS, "date"], "t")
    stored = spark.createDataFrame([row for batch in batches for row in batch], RECORD)
    stored = stored.withColumn("date", F.col("begin_ts").cast("date"))
    missed = {str(r.date): (r.total, r["count"]) for r in running.missed_totals(current, stored, "date").collect()}
    assert missed["2025-01-02"] == (7, 1) and "2025-01-21" not in missed


def test_what_finds_no_partner_is_handed_out(spark, stream_of):
    begin = [("a", moment("01 09:00:00")), ("far", moment("01 09:00:00")), ("none", moment("01 10:00:00"))]
    later = [("z", moment("20 00:00:00"))]
    begins = stream_of("guid string, b timestamp_ntz", begin, later, [("y", moment("21 00:00:00"))])
    end = [("a", moment("01 10:00:00")), ("lost", moment("01 11:00:00")), ("far", moment("02 10:00:00"))]
    ends = stream_of("guid string, e timestamp_ntz", end, [("q", moment("20 00:00:00"))], [("w", moment("21 00:00:00"))])
    begins = begins.select("guid", event_time(F.col("b")).alias("begin_time"))
    ends = ends.select("guid", event_time(F.col("e")).alias("end_time"))
    paired = running.drain_appends(spark, pairing.paired_records(begins, ends), "t")
    assert [r.guid for r in paired.collect()] == ["a"]
    alone = running.drain_appends(spark, pairing.unpaired_beginnings(begins, ends), "t")
    assert {"far", "none"} <= {r.guid for r in alone.collect()} and "a" not in {r.guid for r in alone.collect()}
    lost = running.drain_appends(spark, pairing.unpaired_endings(begins, ends), "t")
    assert {"far", "lost"} <= {r.guid for r in lost.collect()} and "a" not in {r.guid for r in lost.collect()}


def test_corrections_are_merged_into_stored_totals_between_runs(spark, tmp_path):
    """A late row is counted at the day's close; the stream goes on from its checkpoint, and a
    second close finds nothing more to do."""
    folder, root = tmp_path / "in", str(tmp_path / "totals")
    stored = []

    def arrive(*rows):
        number = len(list(folder.iterdir())) if folder.exists() else 0
        frame = spark.createDataFrame(list(rows), RECORD)
        frame.coalesce(1).write.parquet(str(folder / str(number)))
        stored.extend(rows)

    def drain():
        reader = spark.readStream.schema(RECORD.replace(" ntz", "")).option("maxFilesPerTrigger", 1)
        totals = running.daily_totals(timed(reader.parquet(f"{folder}/*")))
        return running.drain_updates(spark, totals, [*running.KEYS, "date"], "t", root)

    def close():
        records = spark.createDataFrame(stored, RECORD).withColumn("date", F.col("begin_ts").cast("date"))
        frame = running.correct_totals(spark, root, records, "date")
        return {str(r.date)[8:]: (r.total, r["count"]) for r in frame.collect()}

    arrive(("a", 1, "A", moment("02 09:00:00"), 60))
    arrive(("b", 1, "A", moment("21 09:00:00"), 5))
    arrive(("b2", 1, "A", moment("21 09:30:00"), 0))
    arrive(("late", 1, "A", moment("02 10:00:00"), 7), ("later", 1, "A", moment("03 10:00:00"), 9))
    assert {str(r.date)[8:]: r.total for r in drain().collect()} == {"02": 60, "21": 5}
    assert close() == {"02": (67, 2), "03": (9, 1), "21": (5, 2)}
    assert close() == {"02": (67, 2), "03": (9, 1), "21": (5, 2)}
    arrive(("c", 1, "A", moment("21 11:00:00"), 2), ("last", 1, "A", moment("03 11:00:00"), 1))
    drain()
    assert close() == {"02": (67, 2), "03": (10, 2), "21": (7, 3)}
