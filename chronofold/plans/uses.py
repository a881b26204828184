"""Reference counts by month: how many records name each task and tag.

A deletion needs to know which keys are in use. A merge makes the counts of its months anew, so the
check reads a row for each key and month instead of all records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions.calendar import MONTH_FORMAT
from chronofold.sources import tables

KINDS = ("task_id", "tag_id")
_STORED = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.LongType()),
        T.StructField("records", T.LongType()),
        T.StructField("month", T.StringType()),
    ]
)


def month_uses(records: DataFrame) -> DataFrame:
    """``kind, key, records, month``: one pass, with map-side counts, so no key fills a task."""
    month = F.date_format("date", MONTH_FORMAT).alias("month")
    counts = records.groupBy(month, *KINDS).agg(F.count(F.lit(1)).alias("records"))
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("key")) for k in KINDS]))
    rows = counts.select("month", "records", pairs).where(F.col("key").isNotNull())
    return rows.groupBy("kind", "key", "month").agg(F.sum("records").alias("records"))


def used(counts: DataFrame, kind: str) -> DataFrame:
    """The keys of a kind that records name, as a column of that name."""
    return counts.where((F.col("kind") == kind) & (F.col("records") > 0)).select(F.col("key").alias(kind))


def write(records: DataFrame, root: str, version: str) -> list[str]:
    """Write the counts of whole months of records under a version's name; returns these months."""
    tables.write_part(month_uses(records), root, version, "uses", "month", ("kind", "key"))
    written = records.sparkSession.read.schema(_STORED).parquet(f"{root}/uses/version={version}")
    return tables.values_of(written, "month")


def keep(spark: SparkSession, root: str, before: str, version: str) -> str:
    """A version like the one before that also holds reference counts, as all later ones will."""
    months = write(tables.read_records(spark, root, before), root, version)
    parts = tables.listing(spark, root, before)
    tables.publish(spark, root, version, parts, {"uses": months}, {"uses": months})
    return version


def read(spark: SparkSession, root: str, version: str) -> DataFrame:
    return tables.read_part(spark, root, version, "uses", _STORED, "month")
