"""Running totals per day or Monday week, and the tables that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.sources.session import kept, scratch_dir
from chronofold.sources.tables import exists
from chronofold.streaming.clock import wall_date

KEYS = ("user_id", "task_name")


def _totals(
    records: DataFrame, window: Column, name: str, delay: str, keys: Sequence[str]
) -> DataFrame:
    totals = (
        records.withWatermark("event_time", delay)
        .groupBy(window.alias("_window"), *keys)
        .agg(F.sum("elapsed_s").alias("total"), F.count(F.lit(1)).alias("count"))
    )
    return totals.select(*keys, wall_date(F.col("_window.start")).alias(name), "total", "count")


def daily_totals(records: DataFrame, delay: str = "1 day", keys: Sequence[str] = KEYS) -> DataFrame:
    return _totals(records, F.window("event_time", "1 day"), "date", delay, keys)


def weekly_totals(records: DataFrame, delay: str = "1 day", keys: Sequence[str] = KEYS) -> DataFrame:
    """Weeks start on Monday: the fifth day of the epoch was one."""
    window = F.window("event_time", "7 days", startTime="4 days")
    return _totals(records, window, "week_start", delay, keys)


def missed_totals(
    current: DataFrame, records: DataFrame, name: str, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Groups whose running total lacks rows that came behind the watermark, with their totals
    from the stored records (columns as in ``current``; ``records`` carries the column ``name``).

    Every row reaches the record table, also those a windowed total no longer takes, so this is
    what a day's close corrects the running totals by.
    """
    group = [*keys, name]
    true = records.groupBy(*group).agg(
        F.sum("elapsed_s").alias("_total"), F.count(F.lit(1)).alias("_count")
    )
    joined = true.join(current, group, "left")
    same = F.col("total").eqNullSafe(F.col("_total")) & F.col("count").eqNullSafe(F.col("_count"))
    return joined.filter(~same).select(
        *group, F.col("_total").alias("total"), F.col("_count").alias("count")
    )


def unique_records(records: DataFrame, key: str = "guid", delay: str = "1 day") -> DataFrame:
    """One row per key among the records that arrive within the delay of each other."""
    return records.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


def _empty_table(spark: SparkSession, stream: DataFrame, path: str) -> None:
    """So that a stream without any data reads as an empty table."""
    spark.createDataFrame([], stream.schema).write.parquet(path)


def drain_appends(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over everything available, appending to Parquet, and read the result."""
    root = scratch_dir(spark, purpose)
    _empty_table(spark, stream, f"{root}/rows")
    run = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{root}/state")
        .option("path", f"{root}/rows")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def drain_updates(
    spark: SparkSession,
    stream: DataFrame,
    keys: Sequence[str],
    purpose: str,
    root: str | None = None,
) -> DataFrame:
    """Run an aggregation over everything available and read its current totals.

    Each micro-batch writes the groups it changed under its own number, replacing a failed
    attempt of the same number. The current value of a group is the one with the highest
    number, so groups whose window is still open are part of the answer. With a ``root`` of its own
    the stream goes on from there the next time, and ``correct_totals`` can be run between.
    """
    root = root or scratch_dir(spark, purpose)
    if not exists(spark, f"{root}/versions"):
        _empty_table(spark, stream, f"{root}/versions/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/versions/batch={number}")

    run = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return current_totals(spark, root, keys)


def current_totals(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """The newest value of every group: of the last micro-batch that changed it, or of a
    correction made after that one."""
    versions = spark.read.parquet(f"{root}/versions").withColumn("_round", F.lit(0))
    values = [name for name in versions.columns if name not in (*keys, "batch", "_round")]
    if exists(spark, f"{root}/corrections"):
        made = spark.read.schema(versions.drop("_round").schema).parquet(f"{root}/corrections")
        versions = versions.unionByName(made.withColumn("_round", F.lit(1)))
    newest = F.max_by(F.struct(*values), F.struct("batch", "_round"))
    return versions.groupBy(*keys).agg(newest.alias("_current")).select(*keys, "_current.*")


def correct_totals(
    spark: SparkSession, root: str, records: DataFrame, name: str, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Merge what came behind the watermark into the stored totals, and read them.

    To be run between two runs of the stream, at a day's close say. The groups whose totals
    lack rows are written after the last micro-batch; a group that rows were too late for is
    closed, so no later micro-batch writes it again. Running it again changes nothing.
    """
    group = [*keys, name]
    missed = missed_totals(current_totals(spark, root, group), records, name, keys)
    last = spark.read.parquet(f"{root}/versions").agg(F.max("batch")).first()[0]
    staged = kept(missed, "missed")  # the totals are read again below, and may not be written meanwhile
    before = f"{root}/corrections/batch={last}"
    if exists(spark, before):
        earlier = spark.read.schema(staged.schema).parquet(before).join(staged, group, "left_anti")
        staged = kept(staged.unionByName(earlier), "missed")
    staged.write.mode("overwrite").parquet(before)
    return current_totals(spark, root, group)
