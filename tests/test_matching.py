"""Matching with timers, row numbers, ranked pages: over micro-batches, ranges and hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import search
from chronofold.plans import numbering
from chronofold.streaming import matching, running
from chronofold.streaming.clock import event_time


def moment(text):
    return dt.datetime.fromisoformat(f"2025-01-{text}")


@pytest.fixture
def sides(spark, tmp_path):
    """Beginnings (guid, time, planned seconds) and endings, a micro-batch for each list of rows."""

    def stream(name, columns, batches):
        for number, rows in enumerate(batches):
            frame = spark.createDataFrame(rows, columns).coalesce(1)
            frame.write.parquet(str(tmp_path / name / str(number)))
        reader = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1)
        return reader.parquet(str(tmp_path / name / "*"))

    def make(begins, ends):
        begin = stream("b", "guid string, t timestamp_ntz, plan long", begins)
        end = stream("e", "guid string, t timestamp_ntz", ends)
        return (
            begin.select("guid", F.lit(7).cast("long").alias("user_id"), event_time(F.col("t")).alias("begin_time"), "plan"),
            end.select("guid", event_time(F.col("t")).alias("end_time")),
        )

    return make


def matched(spark, begins, ends, delay="10 minutes"):
    found = matching.matched_records(begins, ends, planned=F.col("plan"), delay=delay)
    with matching.timer_state(spark):
        rows = running.drain_appends(spark, found, "t")
    columns = ["guid", "state", F.unix_seconds("begin_time"), F.unix_seconds("end_time"), "elapsed_s"]
    return sorted((tuple(r) for r in rows.select(*columns).collect()), key=repr)


def test_pairs_and_both_rests_over_micro_batches(spark, sides):
    """Plans of 30 minutes and 25 hours; "c" ends before its beginning is read, "d" after its plan,
    "f" ends in a later micro-batch, "g" has no beginning, "h" and "i" have no end."""
    last = moment("20 00:00:00")
    begins, ends = sides(
        [
            [("a", moment("01 09:00:00"), 1800), ("d", moment("01 09:00:00"), 1800), ("h", moment("01 09:00:00"), 90000)],
            [("c", moment("01 09:05:00"), 90000), ("f", moment("01 09:06:00"), 90000), ("i", moment("01 09:00:00"), None)],
            [("z", last, 60)],
            [("y", last, 60)],
        ],
        [
            [("a", moment("01 09:20:00")), ("c", moment("01 09:10:00")), ("g", moment("01 09:00:00"))],
            [("d", moment("01 10:00:00")), ("a", moment("01 09:25:00")), (None, last)],
            [("f", moment("02 10:05:00"))],
            [("x", last)],
        ],
    )
    got = matched(spark, begins, ends)
    start = int(moment("01 09:00:00").replace(tzinfo=dt.UTC).timestamp())
    day, plan = 86_400, 90_000
    assert [r for r in got if r[0] in "acdfghi"] == [
        ("a", "finished", start, start + 1200, 1200),
        ("a", "no beginning", None, start + 1500, None),
        ("c", "finished", start + 300, start + 600, 300),
        ("d", "expired", start, start + 1800, 1800),
        ("d", "no beginning", None, start + 3600, None),
        ("f", "finished", start + 360, start + 360 + 89_940, 89_940),
        ("g", "no beginning", None, start, None),
        ("h", "expired", start, start + plan, plan),
        ("i", "expired", start, start + day, day),
    ]


def test_an_end_at_its_beginning_lasts_a_day_and_one_key_may_begin_twice(spark, sides):
    begins, ends = sides(
        [[("a", moment("01 09:00:00"), 600), ("b", moment("01 09:00:00"), 600), ("b", moment("01 10:00:00"), 600)], [("z", moment("09 00:00:00"), 1)]],
        [[("a", moment("01 09:00:00")), ("b", moment("01 10:05:00")), ("b", moment("01 09:05:00"))], [("z", moment("09 00:00:00"))]],
    )
    got = [(r[0], r[1], r[4]) for r in matched(spark, begins, ends) if r[0] in "ab"]
    assert got == [("a", "finished", 86_400), ("b", "finished", 300), ("b", "finished", 300)]


def test_numbers_within_keys_of_every_size(spark):
    """One key holds most rows and lies in several ranges."""
    rows = [("hot", n % 977, n) for n in range(5000)] + [(f"k{n % 40}", n, n) for n in range(300)]
    rows += [("null", None, 1), ("null", 3, 2), (None, 1, 1)]
    frame = spark.createDataFrame(rows, "k string, v long, id long").repartition(7)
    got = numbering.numbered(frame, ["k"], [F.asc_nulls_first("v"), F.col("id")], "n").collect()
    want = {}
    for k, v, i in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        want.setdefault(k, []).append((v, i))
    assert len(got) == len(rows) - 1
    assert all(want[r.k][r.n] == (r.v, r.id) for r in got)
    total = numbering.numbered(frame.where("k = 'hot'"), [], [F.col("id")], "n").collect()
    assert all(r.n == r.id for r in total)
    assert numbering.numbered(frame.where("false"), ["k"], [F.col("id")]).collect() == []


def test_a_far_page_opens_the_range_that_it_lies_in(spark):
    days = [(n, dt.date(2020, 1, 1) + dt.timedelta(days=n % 1500)) for n in range(20_000)]
    found = spark.createDataFrame(days, "record_id long, date date").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        pages = search.ranked(found)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (pages.count, pages.pages(30)) == (20_000, 667) and len(pages.sizes) > 1
    for number in (1, 2, 300, 667, 668):
        want = [tuple(r) for r in search.page(found, number, 30).collect()]
        assert [tuple(r) for r in pages.page(number, 30).collect()] == want
    plan = pages.page(600, 30)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((_part" in plan or "PartitionFilters: [(_part" in plan or "PartitionFilters: [isnotnull(_part" in plan
    assert "GreaterThanOrEqual(_at" in plan
    begin, part = 0, 0
    while begin + pages.sizes[part] <= 300 * 30:
        begin, part = begin + pages.sizes[part], part + 1
    want = pages.page(301, 30).collect()
    for file in pages.rows.inputFiles():
        if f"_part={part}/" not in file:
            with open(file.removeprefix("file://"), "w") as out:
                out.write("no Parquet: reading this range fails")
    assert pages.page(301, 30).collect() == want
    with pytest.raises(Exception, match="Parquet|parquet|CANNOT_READ"):
        pages.page(1 if part else 667, 30).collect()
    with pytest.raises(ValueError):
        pages.page(0, 30)
    assert search.ranked(found.where("false")).page(1, 30).collect() == []


def test_state_is_kept_by_bucket_and_not_by_key(spark, sides, tmp_path):
    """Of 6,000 keys all are open after the first micro-batch; 3,000 end in the second."""
    begin, end, later = moment("01 09:00:00"), moment("01 09:20:00"), moment("02 00:00:00")
    begins, ends = sides(
        [[(f"k{n}", begin, 1800) for n in range(6000)], [("z", later, 1)]],
        [[("y", begin)], [*((f"k{n}", end) for n in range(3000)), ("x", later)]],
    )
    found = matching.matched_records(begins, ends, planned=F.col("plan"), delay="10 minutes")
    with matching.timer_state(spark):
        run = (
            found.writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", str(tmp_path / "state"))
            .option("path", str(tmp_path / "rows"))
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in run.recentProgress) <= 4096
    states = spark.read.schema(found.schema).parquet(str(tmp_path / "rows")).groupBy("state").count()
    assert dict(map(tuple, states.collect())) == {"finished": 3000, "expired": 3000, "no beginning": 1}


def _matched_one_by_one(begins, ends, delay):
    """Key by key and batch by batch; no row comes behind the watermark."""
    opened, waiting, found = [], [], []
    for some, others in zip(begins, ends, strict=True):
        opened += [(key, t, t + dt.timedelta(seconds=plan)) for key, t, plan in some if key]
        waiting += [row for row in others if row[0]]
        for begin in sorted(opened, key=lambda b: b[1:]):
            fits = [e for e in waiting if e[0] == begin[0] and begin[1] <= e[1] <= begin[2]]
            if fits:
                end = min(fits)
                opened.remove(begin)
                waiting.remove(end)
                found.append((begin[0], "finished", begin[1], end[1]))
    mark = min(max(row[1] for batch in side for row in batch) for side in (begins, ends)) - delay
    found += [(key, "expired", t, due) for key, t, due in opened if due <= mark]
    return found + [(key, "no beginning", None, t) for key, t in waiting if t <= mark]


def test_keys_of_one_bucket_and_rows_of_one_key_are_matched_as_one_by_one(spark, sides):
    """Three buckets for keys of few rows and one of many, over micro-batches; no Spark in the other."""
    dice = random.Random(5)
    begins, ends = [], []
    for hour in range(0, 24, 4):
        time = lambda: moment("01 00:00:00") + dt.timedelta(hours=hour, seconds=dice.randrange(14_400))  # noqa: B023, E731
        keys = [*(f"k{n}" for n in range(40)), *["hot"] * 20, None]
        begins.append([(dice.choice(keys), time(), dice.choice([-5, 0, 60, 1800, 30_000])) for _ in range(80)])
        ends.append([(dice.choice(keys), time()) for _ in range(80)])
        begins[-1] += begins[-1][:9]
    begins.append([("z", moment("02 06:00:00"), 1)])
    ends.append([("z", moment("02 07:00:00"))])
    want = _matched_one_by_one(begins, ends, dt.timedelta(minutes=10))
    assert {state for _, state, _, _ in want} == {"finished", "expired", "no beginning"}
    first, second = sides(begins, ends)
    found = matching.matched_records(first, second, planned=F.col("plan"), delay="10 minutes", buckets=3)
    with matching.timer_state(spark):
        rows = running.drain_appends(spark, found, "t")
    times = [F.col(name).cast("timestamp_ntz") for name in ("begin_time", "end_time")]
    got = rows.select("guid", "state", *times).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_missing_users_long_numbers_and_times_far_away(spark, sides):
    """Users come out as they went in; years that pandas cannot tell are matched all the same."""
    far = dt.datetime(9999, 12, 30)
    begins, ends = sides(
        [[("a", moment("01 09:00:00"), 60), ("n", moment("01 09:00:00"), 60), ("f", far, 60)]],
        [[("a", moment("01 09:00:30")), ("n", moment("01 09:00:30")), ("f", far + dt.timedelta(seconds=9))]],
    )
    user = F.when(F.col("guid") != "n", F.lit(2**60 + 1))
    found = matching.matched_records(begins.withColumn("user_id", user), ends, planned=F.col("plan"))
    with matching.timer_state(spark):
        rows = running.drain_appends(spark, found, "t")
    got = sorted(tuple(r) for r in rows.select("guid", "user_id", "elapsed_s", "state").collect())
    assert got == [("a", 2**60 + 1, 30, "finished"), ("f", 2**60 + 1, 9, "finished"), ("n", None, 30, "finished")]
