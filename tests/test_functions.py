
import pytest
from pyspark.sql import functions as F

from chronofold.functions import durations, text
from chronofold.functions.keys import stable_guid
from chronofold.sources.schema import known_columns, snake_case_columns


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("seconds", "unit", "expected"),
    [
        (0, "hour", "00:00:00"),
        (300, "hour", "00:05:00"),
        (86399, "day", "23:59:59"),
        (86400, "day", "01:00:00:00"),
        (86400, "hour", "24:00:00"),
        (360000, "hour", "100:00:00"),
        (360000, "day", "04:04:00:00"),
        (90061.9, "day", "01:01:01:01"),
        (None, "day", None),
    ],
)
def test_duration_text(spark, seconds, unit, expected):
    value = F.lit(seconds).cast("double")
    assert one(spark, durations.duration_text(value, unit)) == expected


def test_scaled_duration_uses_days_only_beyond_one_day(spark):
    assert one(spark, durations.scaled_duration_text(F.lit(86400))) == "24:00:00"
    assert one(spark, durations.scaled_duration_text(F.lit(86401))) == "01:00:00:01"
    parts = durations.split_text(durations.scaled_duration_text(F.lit(86401)))
    assert one(spark, parts) == ["01", "00", "00", "01"]


def test_duration_rejects_other_units():
    with pytest.raises(ValueError):
        durations.duration_text(F.lit(1), "week")


@pytest.mark.parametrize(
    ("begin", "end", "expected"),
    [
        ("12:00:00", "12:05:00", 300),
        ("23:50:00", "00:10:00", 1200),
        ("08:00:00", "08:00:00", 86400),
        ("08:00:00", None, None),
    ],
)
def test_elapsed_seconds(spark, begin, end, expected):
    def moment(time):
        whole = None if time is None else f"2025-01-01 {time}"
        return F.lit(whole).cast("timestamp_ntz")

    assert one(spark, durations.elapsed_seconds(moment(begin), moment(end))) == expected


def test_percent_is_exact_and_null_for_an_empty_whole(spark):
    rows = [(1, 3, 33.3), (2, 3, 66.7), (1, 2000, 0.1), (1, 2001, 0.0), (0, 5, 0.0), (0, 0, None), (10**12, 3 * 10**12, 33.3)]
    frame = spark.createDataFrame(rows, "part long, whole long, expected double")
    got = frame.select("expected", durations.percent(F.col("part"), F.col("whole")).alias("x"))
    for row in got.collect():
        assert row.x == row.expected


@pytest.mark.parametrize(
    "value", ["foo-bar o'neil", "2x 3rd", "ÉCOLE été", "already Title", "", "a_b-c", "x\ny"]
)
def test_title_case_matches_python(spark, value):
    assert one(spark, text.title_case(F.lit(value))) == value.title()


@pytest.mark.parametrize(
    ("value", "task", "subtask"),
    [
        ("work", "Work", None),
        ("  work report ", "Work", "Report"),
        ("work/report draft", "Work", "Report Draft"),
        ("under_score", "Under_Score", None),
        ("été-projet", "Été", "Projet"),
        ("work-", "Work", ""),
    ],
)
def test_split_task_text(spark, value, task, subtask):
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(text.split_task_text(F.lit(value)), "ab")]).first()
    assert (row.a, row.b) == (task, subtask)


@pytest.mark.parametrize(
    ("needle", "found"),
    [("RED", True), ("50%", True), ("5_%", False), ("a.b", False), ("É", False), ("é", True), ("\\E", True), ("line\nbreak", True)],
)
def test_contains_text_takes_signs_literally(spark, needle, found):
    log = F.lit("Fixed red thing, 50% done, é \\e axb line\nbreak")
    assert one(spark, text.contains_text(log, needle)) is found


@pytest.mark.parametrize(
    ("pattern", "name", "matches"),
    [("wor%", "Work", True), ("w_rk", "WORK", True), ("w_rk", "woork", False), ("a.c", "abc", False), ("%", "", True)],
)
def test_matches_like(spark, pattern, name, matches):
    assert one(spark, text.matches_like(F.lit(name), pattern)) is matches


def test_snake_case_columns_and_unknown_fields(spark):
    frame = spark.createDataFrame([("2025-01-01", "08:00:00", 1)], "date string, timeBeginning string, hack int")
    clean = known_columns(snake_case_columns(frame))
    assert clean.columns == ["date", "time_beginning"]


def test_log_pieces_in_entry_order(spark):
    rows = [(1, 2, "second"), (1, 1, "first"), (2, 1, "only"), (1, 10, "tenth")]
    frame = spark.createDataFrame(rows, "id long, turn long, text string").repartition(4)
    logs = frame.groupBy("id").agg(text.join_log_pieces("turn", "text").alias("log"))
    assert {r.id: r.log for r in logs.collect()} == {1: "first  \nsecond  \ntenth", 2: "only"}


def test_stable_guid_has_the_required_length(spark):
    guid = one(spark, stable_guid(F.lit("Task"), F.lit(None)))
    assert len(guid) == 26
    # parts that read alike when joined give different keys, and so do no value and an empty one
    assert guid != one(spark, stable_guid(F.lit("Task"), F.lit("")))
    split = one(spark, stable_guid(F.lit("A|B"), F.lit("C")))
    assert split != one(spark, stable_guid(F.lit("A"), F.lit("B|C")))
    assert guid != one(spark, stable_guid(F.lit("Task"), F.lit("Sub")))
