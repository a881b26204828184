"""Fixed schemas of the record tables.

Begin and end are wall-clock times without a zone, as a person notes them down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronofold.functions.text import snake_case

RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("task_id", T.LongType(), False),
        T.StructField("date", T.DateType(), True),
        T.StructField("begin_ts", T.TimestampNTZType(), True),
        T.StructField("end_ts", T.TimestampNTZType(), True),
        T.StructField("elapsed_s", T.LongType(), True),
        T.StructField("tag_id", T.LongType(), True),
        T.StructField("log", T.StringType(), True),
    ]
)

TASKS = T.StructType(
    [
        T.StructField("task_id", T.LongType(), False),
        T.StructField("task_name", T.StringType(), False),
        T.StructField("subtask", T.StringType(), True),
        T.StructField("guid", T.StringType(), False),
    ]
)

TAGS = T.StructType(
    [
        T.StructField("tag_id", T.LongType(), False),
        T.StructField("tag", T.StringType(), False),
        T.StructField("guid", T.StringType(), False),
    ]
)

# Columns of an incoming record batch, all text as a client sends it.
INCOMING = (
    "guid",
    "user_id",
    "operation",
    "task_guid",
    "tag_guid",
    "date",
    "time_beginning",
    "time_ending",
    "log",
)


def snake_case_columns(frame: DataFrame) -> DataFrame:
    return frame.toDF(*[snake_case(name) for name in frame.columns])


def known_columns(frame: DataFrame, known: tuple[str, ...] = INCOMING) -> DataFrame:
    """Drop the fields nobody asked for, keep the known ones in their fixed order."""
    present = set(frame.columns)
    return frame.select(*[name for name in known if name in present])
