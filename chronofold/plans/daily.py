"""Daily totals: the records collapsed to one row per (user, day, task, subtask, tag).

They stand in for the records wherever only counts, sums and days matter, which is every
total, mean, share, streak, weekly series, chart and page: those operators sum ``elapsed_s``
and count through ``record_count``. Reading them costs a fraction of reading the records,
and a merge refreshes just the months it touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions.calendar import MONTH_FORMAT
from chronofold.plans.selection import join_tags, join_tasks
from chronofold.sources import schema, tables

GRAIN = ("user_id", "date", "task_name", "subtask", "tag")


def daily_totals(records: DataFrame) -> DataFrame:
    return records.groupBy(*GRAIN).agg(
        F.sum("elapsed_s").alias("elapsed_s"),
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.col("elapsed_s").isNull()).alias("open_count"),
    )


def record_count(frame: DataFrame) -> Column:
    """Aggregate: the number of records behind a frame of records or of daily totals."""
    if "record_count" in frame.columns:
        return F.sum("record_count")
    return F.count(F.lit(1))


def open_count(frame: DataFrame) -> Column:
    """Aggregate: the number of running records."""
    if "open_count" in frame.columns:
        return F.sum("open_count")
    return F.count_if(F.col("elapsed_s").isNull())


_STORED = T.StructType(
    [
        T.StructField("elapsed_s", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("open_count", T.LongType()),
        T.StructField("task_name", T.StringType()),
        T.StructField("subtask", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("month", T.StringType()),
    ]
)


def write(records: DataFrame, root: str, version: str) -> list[str]:
    """Write the totals of whole months of records under a version's name; returns these months.

    The sums are taken by key numbers first; names are joined to the much smaller result.
    """
    spark = records.sparkSession
    summed = records.groupBy("user_id", "date", "task_id", "tag_id").agg(
        F.sum("elapsed_s").alias("elapsed_s"),
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.col("elapsed_s").isNull()).alias("open_count"),
    )
    tasks = spark.read.schema(schema.TASKS).parquet(f"{root}/tasks")
    tags = spark.read.schema(schema.TAGS).parquet(f"{root}/tags")
    named = join_tags(join_tasks(summed, tasks), tags).drop("task_id", "tag_id")
    named = named.withColumn("month", F.date_format("date", MONTH_FORMAT))
    tables.write_part(named, root, version, "daily", "month", ("user_id", "date"))
    written = spark.read.schema(_STORED).parquet(f"{root}/daily/version={version}")
    return tables.values_of(written, "month")


def keep(spark: SparkSession, root: str, before: str, version: str) -> str:
    """A version like the one before that also holds daily totals, as all later ones will."""
    months = write(tables.read_records(spark, root, before), root, version)
    parts = tables.listing(spark, root, before)
    tables.publish(spark, root, version, parts, {"daily": months}, {"daily": months})
    return version


def stored(spark: SparkSession, root: str, version: str) -> bool:
    """Whether daily totals are kept in this version."""
    return "daily" in tables.listing(spark, root, version)


def read(spark: SparkSession, root: str, version: str) -> DataFrame:
    return tables.read_part(spark, root, version, "daily", _STORED, "month")
