"""Readers and writers of the Parquet record tables.

Records are partitioned by calendar month, so every date range becomes a partition range,
and each file is sorted by user and date, so row groups can be skipped on either.

A table has versions. A merge is a join, written to folders of its own under a new version's name:
the months that it changes (``records/version=7/month=2025-01``), the buckets of the narrow table
that says which month a record lies in (``places``), the months of the daily totals. Last comes the
version's listing, one row for each month or bucket with the version whose folder holds it. Nothing
is overwritten that a reader may be reading, and a version without its listing does not exist, so
a job that dies leaves nothing to repair: it is run again under the same name. Whoever
runs the merge hands the new name to the readers; one job writes at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions.calendar import MONTH_FORMAT
from chronofold.sources import schema

FIRST = "0"
#: Buckets of ``places``. A lookup opens those of its ids, a merge rewrites those of its records.
BUCKETS = 256
#: Ids up to which a lookup names them in the scan, so that row groups are skipped as well.
NAMED = 1000

_MONTH = T.StructField("month", T.StringType())
_VERSION = T.StructField("version", T.StringType())
_STORED_RECORDS = T.StructType([*schema.RECORDS.fields, _MONTH])
_PLACES = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("at", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)
_RECORD_ORDER = ("user_id", "date", "record_id")
_LISTING = "name string, value string, at string"


@dataclass(frozen=True)
class WorkLog:
    """A fact table and its two dimensions."""

    records: DataFrame
    tasks: DataFrame
    tags: DataFrame


def listing(spark: SparkSession, root: str, version: str) -> dict[str, dict[str, str]]:
    """For each part of a version (records, places, daily) its months or buckets and the version
    whose folder holds each: as many entries as there are months and buckets."""
    rows = spark.read.schema(_LISTING).parquet(f"{root}/versions/version={version}").collect()
    parts: dict[str, dict[str, str]] = {}
    for row in rows:
        parts.setdefault(row["name"], {})[row["value"]] = row["at"]
    return parts


def versions(spark: SparkSession, root: str) -> DataFrame:
    """The names of all versions that can be read."""
    read = spark.read.schema(f"{_LISTING}, version string").parquet(f"{root}/versions")
    return read.select("version").distinct()


def read_part(
    spark: SparkSession,
    root: str,
    version: str,
    name: str,
    columns: T.StructType,
    by: str,
    only: Iterable[str] | None = None,
) -> DataFrame:
    """A part of a version as one scan of the folders that hold it, or of some of them."""
    where = listing(spark, root, version).get(name, {})
    wanted = sorted(where if only is None else set(only) & set(where))
    if not wanted:
        return spark.createDataFrame([], columns)
    folder = f"{root}/{name}"
    paths = [f"{folder}/version={where[value]}/{by}={value}" for value in wanted]
    full = T.StructType([*columns.fields, _VERSION])
    read = spark.read.schema(full).option("basePath", folder).parquet(*paths)
    return read.select(*columns.names)


def read_records(
    spark: SparkSession, root: str, version: str = FIRST, months: Iterable[str] | None = None
) -> DataFrame:
    return read_part(spark, root, version, "records", _STORED_RECORDS, "month", months)


def read_worklog(spark: SparkSession, root: str, version: str = FIRST) -> WorkLog:
    return WorkLog(
        records=read_records(spark, root, version),
        tasks=spark.read.schema(schema.TASKS).parquet(f"{root}/tasks"),
        tags=spark.read.schema(schema.TAGS).parquet(f"{root}/tags"),
    )


def write_part(
    frame: DataFrame, root: str, version: str, name: str, by: str, order: tuple[str, ...]
) -> None:
    """Write a part's changed months or buckets, one folder each, under the version's name.

    Rebalancing lets Spark cut a busy month into several even files and join the small ones,
    by their measured size. Record ids get Bloom filters, since files are not sorted by them.
    """
    sorted_rows = frame.hint("rebalance", by).sortWithinPartitions(by, *order)
    writer = sorted_rows.write.mode("overwrite").partitionBy(by)
    if "record_id" in frame.columns:
        writer = writer.option("parquet.bloom.filter.enabled#record_id", "true").option(
            "parquet.bloom.filter.adaptive.enabled", "true"
        )
    writer.parquet(f"{root}/{name}/version={version}")


def publish(
    spark: SparkSession,
    root: str,
    version: str,
    before: dict[str, dict[str, str]],
    changed: dict[str, Iterable[str]],
    filled: dict[str, Iterable[str]],
) -> None:
    """Write the listing of a version: that of the one before, but for the months and buckets that
    have changed. Those that are not filled any more have no folder and leave it."""
    parts = {name: dict(values) for name, values in before.items()}
    for name, values in changed.items():
        kept = {v: at for v, at in parts.get(name, {}).items() if v not in set(values)}
        parts[name] = kept | dict.fromkeys(filled.get(name, ()), version)
    rows = [(name, value, at) for name, values in parts.items() for value, at in values.items()]
    frame = spark.createDataFrame(rows, _LISTING).coalesce(1)
    frame.write.mode("overwrite").parquet(f"{root}/versions/version={version}")


def values_of(frame: DataFrame, column: str) -> list[str]:
    """The months or buckets of a frame: a list as long as the calendar, or the buckets, at most."""
    return sorted(str(row[0]) for row in frame.select(column).distinct().collect())


def _bucket(record_id: Column) -> Column:
    return F.pmod(F.xxhash64(record_id), F.lit(BUCKETS)).cast("int")


def write_records(records: DataFrame, root: str, version: str = FIRST) -> str:
    """Write all records as a version without a predecessor, and return its name."""
    spark = records.sparkSession
    with_month = records.withColumn("month", F.date_format("date", MONTH_FORMAT))
    write_part(with_month, root, version, "records", "month", _RECORD_ORDER)
    path = f"{root}/records/version={version}"
    stored = spark.read.schema(_STORED_RECORDS).parquet(path)
    places = stored.select("record_id", F.col("month").alias("at"), _bucket(F.col("record_id")).alias("bucket"))
    write_part(places, root, version, "places", "bucket", ("record_id",))
    buckets = spark.read.schema(_PLACES).parquet(f"{root}/places/version={version}")
    filled = {"records": values_of(stored, "month"), "places": values_of(buckets, "bucket")}
    publish(spark, root, version, {}, filled, filled)
    return version


def _named(ids: DataFrame) -> list[str] | None:
    """The ids themselves when they are few."""
    rows = ids.select("record_id").distinct().limit(NAMED + 1).collect()
    return [row[0] for row in rows] if len(rows) <= NAMED else None


def _with_ids(frame: DataFrame, ids: DataFrame, named: list[str] | None) -> DataFrame:
    if named is not None:
        frame = frame.where(F.col("record_id").isin(named))
    return frame.join(ids.select("record_id").distinct(), "record_id", "left_semi")


def places_of(
    spark: SparkSession, root: str, version: str, ids: DataFrame, named: list[str] | None = None
) -> DataFrame:
    """``record_id, at, bucket`` of the stored ones among these ids; reads their buckets alone."""
    buckets = values_of(ids.select(_bucket(F.col("record_id")).alias("bucket")), "bucket")
    places = read_part(spark, root, version, "places", _PLACES, "bucket", buckets)
    return _with_ids(places, ids, named)


def records_of(spark: SparkSession, root: str, version: str, ids: DataFrame) -> DataFrame:
    """Stored records with these ids, read from the months that hold them and no others."""
    named = _named(ids)
    months = values_of(places_of(spark, root, version, ids, named), "at")
    return _with_ids(read_records(spark, root, version, months), ids, named)


def upsert_records(
    spark: SparkSession,
    root: str,
    changed: DataFrame,
    before: str,
    version: str,
    run: str | None = None,
) -> list[str]:
    """Write full rows over the stored ones with the same ``record_id``, or add them: the content
    of ``version``, which follows on ``before`` and is not listed yet (see ``publish``).

    Rows without a key or a date go to ``rejected_records`` under the run's name (the version's,
    unless given). Of several rows with one key the greatest counts. Only months that hold or get
    one of the records are read and written. Returns these months.
    """
    names = [field.name for field in schema.RECORDS.fields]
    incoming = changed.select(*names).withColumn("month", F.date_format("date", MONTH_FORMAT))
    staged = f"{root}/changes/version={version}"
    incoming.write.mode("overwrite").parquet(f"{staged}/incoming")
    incoming = spark.read.schema(_STORED_RECORDS).parquet(f"{staged}/incoming")
    complete = F.col("record_id").isNotNull() & F.col("date").isNotNull()
    rejected = incoming.filter(~complete).select(
        *names,
        F.when(F.col("record_id").isNull(), F.lit("no key")).otherwise(F.lit("no date")).alias("problem"),
    )
    if not rejected.isEmpty():
        folder = f"{root}/rejected/run={run or version}/version={version}"
        rejected.write.mode("overwrite").parquet(folder)
    rest = [n for n in (*names, "month") if n != "record_id"]
    unique = incoming.filter(complete).groupBy("record_id").agg(F.max(F.struct(*rest)).alias("_row"))
    unique = unique.select("record_id", *[f"_row.{n}" for n in rest])
    unique.write.mode("overwrite").parquet(f"{staged}/rows")
    rows = spark.read.schema(_STORED_RECORDS).parquet(f"{staged}/rows")
    ids = rows.select("record_id")
    known = places_of(spark, root, before, ids)
    months = sorted({*values_of(known, "at"), *values_of(rows, "month")})
    if not months:
        return []
    kept = read_records(spark, root, before, months).join(ids, "record_id", "left_anti")
    write_part(kept.unionByName(rows), root, version, "records", "month", _RECORD_ORDER)
    now = rows.select("record_id", F.col("month").alias("at"), _bucket(F.col("record_id")).alias("bucket"))
    old = read_part(spark, root, before, "places", _PLACES, "bucket", values_of(now, "bucket"))
    places = old.join(ids, "record_id", "left_anti").unionByName(now)  # a row for each record
    write_part(places, root, version, "places", "bucket", ("record_id",))
    return months


def written_records(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The months that a merge has written, whole, whether it is listed yet or not."""
    return spark.read.schema(_STORED_RECORDS).parquet(f"{root}/records/version={version}")


def filled_parts(spark: SparkSession, root: str, version: str) -> dict[str, list[str]]:
    """The months and buckets that a merge has written."""
    places = spark.read.schema(_PLACES).parquet(f"{root}/places/version={version}")
    return {
        "records": values_of(written_records(spark, root, version), "month"),
        "places": values_of(places, "bucket"),
    }


def merge_records(
    spark: SparkSession, root: str, changed: DataFrame, before: str, version: str
) -> list[str]:
    """``upsert_records`` as a version of its own; returns the months that changed."""
    months = upsert_records(spark, root, changed, before, version)
    filled = filled_parts(spark, root, version) if months else {}
    changed_parts = {"records": months, "places": filled.get("places", ())}
    publish(spark, root, version, listing(spark, root, before), changed_parts, filled)
    return months


def rejected_records(spark: SparkSession, root: str) -> DataFrame:
    """Rows that merges could not store, with their ``problem``, ``run`` and ``version``."""
    kept = T.StructType(
        [
            *schema.RECORDS.fields,
            T.StructField("problem", T.StringType()),
            T.StructField("run", T.StringType()),
            _VERSION,
        ]
    )
    if not exists(spark, f"{root}/rejected"):
        return spark.createDataFrame([], kept)
    return spark.read.schema(kept).parquet(f"{root}/rejected")


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def write_dimension(frame: DataFrame, root: str, name: str) -> None:
    frame.write.mode("overwrite").parquet(f"{root}/{name}")


def within_any(records: DataFrame, periods: list) -> DataFrame:
    """Rows whose date lies in one of the periods; what lies between them is not read."""
    kept = F.lit(False)
    for period in periods:
        inside = period.contains(F.col("date"))
        if "month" in records.columns:
            if period.first is not None:
                inside = inside & (F.col("month") >= period.first.strftime("%Y-%m"))
            if period.last is not None:
                inside = inside & (F.col("month") <= period.last.strftime("%Y-%m"))
        kept = kept | inside
    return records.filter(kept)


def in_period(records: DataFrame, period) -> DataFrame:
    """Date filter plus, on a stored table, the matching month filter that prunes folders."""
    kept = records.filter(period.contains(F.col("date")))
    if "month" not in records.columns:
        return kept
    if period.first is not None:
        kept = kept.filter(F.col("month") >= period.first.strftime("%Y-%m"))
    if period.last is not None:
        kept = kept.filter(F.col("month") <= period.last.strftime("%Y-%m"))
    return kept
