"""Runs of days by month: what streaks need, without reading history again.

A month of one user and task is summed up by its first and last day, the runs of consecutive days at
either end, the longest run and the number of days. Two neighbouring months of such sums are
enough to know the runs across them, so a merge makes only its months anew, and streaks are read
from one row for each month instead of all days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions.calendar import MONTH_FORMAT
from chronofold.functions.text import matches_like
from chronofold.plans.selection import join_tasks
from chronofold.sources import schema, tables

_BY = ("user_id", "task_name")
_STORED = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("task_name", T.StringType()),
        *[T.StructField(name, T.DateType()) for name in ("first", "last")],
        *[T.StructField(name, T.LongType()) for name in ("head", "tail", "best", "days")],
        T.StructField("month", T.StringType()),
    ]
)


def month_runs(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, month, first, last, head, tail, best, days`` of distinct days.

    Days shrink with a map-side pass; a window holds the days of one month.
    """
    month = F.date_format("date", MONTH_FORMAT).alias("month")
    days = records.where(F.col("date").isNotNull()).select(*by, month, "date").distinct()
    group = [*by, "month"]
    number = F.row_number().over(Window.partitionBy(*group).orderBy("date"))
    islands = days.withColumn("_island", F.date_sub(F.col("date"), number))
    runs = islands.groupBy(*group, "_island").agg(
        F.min("date").alias("begin"), F.max("date").alias("end"), F.count(F.lit(1)).alias("length")
    )
    return runs.groupBy(*group).agg(
        F.min("begin").alias("first"),
        F.max("end").alias("last"),
        F.min_by("length", "begin").alias("head"),
        F.max_by("length", "begin").alias("tail"),
        F.max("length").alias("best"),
        F.sum("length").alias("days"),
    )


def streaks_of_runs(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``longest_streak, current_streak, current_is_longest`` from the sums of months.

    Each month hands on the run that reaches its last day: its own tail, or all of its days on top
    of what it was handed when it is full. These chains begin anew at every month that is not
    full or does not follow on the month before, so they are sums within chains.
    """
    group = Window.partitionBy(*by).orderBy("first")
    month_begin, month_end = F.trunc("first", "month"), F.last_day("first")
    at_begin, at_end = F.col("first") == month_begin, F.col("last") == month_end
    full = F.col("days") == F.dayofmonth(month_end)
    follows = F.coalesce(F.lag("last").over(group) == F.date_sub(F.col("first"), 1), F.lit(False))
    chained = runs.withColumns(
        {
            "_follows": follows,
            "_opens": (~(full & follows)).cast("int"),
            "_adds": F.when(full, F.col("days")).when(at_end, F.col("tail")).otherwise(0),
            "_at_begin": at_begin,
        }
    )
    chained = chained.withColumn("_chain", F.sum("_opens").over(group))
    within = Window.partitionBy(*by, "_chain").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)
    chained = chained.withColumn("_hands_on", F.sum("_adds").over(within))
    handed = F.when(F.col("_follows"), F.lag("_hands_on").over(group)).otherwise(0)
    chained = chained.withColumn("_handed", handed)
    reaches_back = F.col("_at_begin") & (F.col("tail") == F.datediff("last", "first") + 1)
    return chained.groupBy(*by).agg(
        F.max(F.greatest(F.col("best"), F.col("head") + F.col("_handed"))).alias("longest_streak"),
        F.max_by(F.col("tail") + F.when(reaches_back, F.col("_handed")).otherwise(0), "first").alias(
            "current_streak"
        ),
    ).withColumn("current_is_longest", F.col("current_streak") == F.col("longest_streak"))


def write(records: DataFrame, root: str, version: str) -> list[str]:
    """Write the sums of whole months of records under a version's name; returns these months.

    Days shrink by task number first; names are joined to the much smaller result.
    """
    spark = records.sparkSession
    days = records.select("user_id", "task_id", "date").distinct()
    named = join_tasks(days, spark.read.schema(schema.TASKS).parquet(f"{root}/tasks"))
    tables.write_part(month_runs(named, _BY), root, version, "runs", "month", _BY)
    written = spark.read.schema(_STORED).parquet(f"{root}/runs/version={version}")
    return tables.values_of(written, "month")


def keep(spark: SparkSession, root: str, before: str, version: str) -> str:
    """A version like the one before that also holds runs, as all later ones will."""
    months = write(tables.read_records(spark, root, before), root, version)
    parts = tables.listing(spark, root, before)
    tables.publish(spark, root, version, parts, {"runs": months}, {"runs": months})
    return version


def read(spark: SparkSession, root: str, version: str) -> DataFrame:
    return tables.read_part(spark, root, version, "runs", _STORED, "month")


def stored_streaks(
    spark: SparkSession, root: str, version: str, pattern: str | None = None
) -> DataFrame:
    """``operators.streaks`` of a stored table, from its runs."""
    runs = read(spark, root, version)
    if pattern is not None:
        runs = runs.filter(matches_like(F.col("task_name"), pattern))
    return streaks_of_runs(runs, _BY)
