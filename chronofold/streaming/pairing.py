"""Beginnings and endings of records as two streams.

Both sides carry a watermark and the end must follow its begin within ``longest``, so a
begin leaves the state as soon as no matching end can arrive any more. What finds no partner that
way is not lost: ``unpaired_beginnings`` and ``unpaired_endings`` are the streams of it, to be merged
into the record table like any correction (``streaming.late``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.durations import elapsed_instants


def _joined(begins: DataFrame, ends: DataFrame, longest: str, delay: str, how: str) -> DataFrame:
    begins = begins.withWatermark("begin_time", delay)
    ends = ends.select(F.col("guid").alias("_guid"), "end_time").withWatermark("end_time", delay)
    match = (
        (F.col("guid") == F.col("_guid"))
        & (F.col("end_time") >= F.col("begin_time"))
        & (F.col("end_time") <= F.col("begin_time") + F.expr(f"interval {longest}"))
    )
    return begins.join(ends, match, how).drop("_guid")


def paired_records(
    begins: DataFrame, ends: DataFrame, longest: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Finished records: begin, end and elapsed seconds."""
    pairs = _joined(begins, ends, longest, delay, "inner")
    return pairs.withColumn("elapsed_s", elapsed_instants(F.col("begin_time"), F.col("end_time")))


def unpaired_beginnings(
    begins: DataFrame, ends: DataFrame, longest: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Beginnings whose end did not come within ``longest``, once it no longer can."""
    rows = _joined(begins, ends, longest, delay, "left_outer")
    return rows.filter(F.col("end_time").isNull()).drop("end_time")


def unpaired_endings(
    begins: DataFrame, ends: DataFrame, longest: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Endings without a beginning in the ``longest`` before them: it never came, came later than
    its end, or lies further back."""
    begins = begins.select("guid", "begin_time").withWatermark("begin_time", delay)
    ends = ends.withColumnRenamed("guid", "_guid").withWatermark("end_time", delay)
    match = (
        (F.col("guid") == F.col("_guid"))
        & (F.col("end_time") >= F.col("begin_time"))
        & (F.col("end_time") <= F.col("begin_time") + F.expr(f"interval {longest}"))
    )
    rows = begins.join(ends, match, "right_outer").filter(F.col("guid").isNull())
    return rows.drop("guid", "begin_time").withColumnRenamed("_guid", "guid")


def closed_records(
    begins: DataFrame,
    ends: DataFrame,
    planned: str = "1 day",
    delay: str = "1 hour",
) -> DataFrame:
    """Finished records, plus those whose planned duration passed without an end; the latter
    end where the plan does. Records still inside their plan are not reported yet. The true end of
    an expired record is in ``unpaired_endings`` with ``longest=planned`` when it comes."""
    rows = _joined(begins, ends, planned, delay, "left_outer")
    expired = F.col("end_time").isNull()
    return rows.select(
        *[name for name in rows.columns if name != "end_time"],
        F.coalesce(F.col("end_time"), F.col("begin_time") + F.expr(f"interval {planned}")).alias("end_time"),
        F.when(expired, F.lit("expired")).otherwise(F.lit("finished")).alias("state"),
    )
