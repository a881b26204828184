"""Runs of consecutive days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.text import matches_like
from chronofold.plans.series import USER


def streaks(
    records: DataFrame, pattern: str | None = None, keys: Sequence[str] = USER
) -> DataFrame:
    """Longest run of days per task and its latest run, which need not reach today.

    Records shrink to distinct days before the window, with a map-side pass, so a window
    partition is at most as long as the calendar. The island number ``date - row_number``
    is constant along a run, and the groupings on it reuse the window's partitioning.
    """
    if pattern is not None:
        records = records.filter(matches_like(F.col("task_name"), pattern))
    task = [*keys, "task_name"]
    days = records.select(*task, "date").distinct()
    number = F.row_number().over(Window.partitionBy(*task).orderBy("date"))
    islands = days.select(*task, F.date_sub(F.col("date"), number).alias("_island"))
    runs = islands.groupBy(*task, "_island").agg(F.count(F.lit(1)).alias("_days"))
    result = runs.groupBy(*task).agg(
        F.max("_days").alias("longest_streak"),
        F.max_by("_days", "_island").alias("current_streak"),
    )
    return result.withColumn(
        "current_is_longest", F.col("current_streak") == F.col("longest_streak")
    )
