"""Corrections: old records entered late and edits of stored ones.

They may reach back further than any watermark, so they bypass the windowed aggregations:
every micro-batch is merged into the record table as a version of its own, and totals are read
from there.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.operators.ingest import apply_edits, last_per_key
from chronofold.plans import daily, runs, uses
from chronofold.sources import schema, tables

_FIELDS = [field.name for field in schema.RECORDS.fields]
_PENDING = T.StructType(
    [
        *[T.StructField(f.name, f.dataType) for f in schema.RECORDS.fields],
        T.StructField("seq", T.LongType()),
    ]
)


def merge_batch(
    spark: SparkSession,
    root: str,
    batch: DataFrame,
    before: str,
    version: str,
    run: str | None = None,
) -> str:
    """The version that follows on ``before`` by one batch of rows with ``operation`` (``old`` or
    ``edit``) and ``seq``; returns its name.

    Old records come first, then edits of what is stored. Edits of records that are not stored
    yet wait in ``pending_edits`` and are tried again with every batch. Daily totals, runs of
    days and reference counts, where they are kept, are made anew for the months that changed. Running it again writes the same version.
    """
    batch = batch.persist()
    try:
        old = last_per_key(batch.filter("operation = 'old'"), "record_id", "seq").select(*_FIELDS)
        edits = batch.filter("operation = 'edit'").select(*_FIELDS, F.col("seq").cast("long"))
        edits = edits.unionByName(pending_edits(spark, root, before))
        edits = last_per_key(edits, "record_id", "seq").persist()
        stored = tables.records_of(spark, root, before, edits.select("record_id")).select(*_FIELDS)
        stored = stored.join(old, "record_id", "left_anti")
        base = old.unionByName(stored)
        months = tables.upsert_records(spark, root, apply_edits(base, edits), before, version, run)
        waiting = edits.join(base.select("record_id"), "record_id", "left_anti")
        waiting = waiting.filter(F.col("record_id").isNotNull()).select(*_PENDING.names)
        waiting.write.mode("overwrite").parquet(f"{root}/pending/version={version}")
        edits.unpersist()
    finally:
        batch.unpersist()
    parts = tables.listing(spark, root, before)
    filled = tables.filled_parts(spark, root, version) if months else {}
    changed = {"records": months, "places": filled.get("places", ())}
    for name, summed in (("daily", daily), ("runs", runs), ("uses", uses)):
        if months and name in parts:
            changed[name] = months
            whole = tables.written_records(spark, root, version)
            filled[name] = summed.write(whole, root, version)
    changed["pending"] = filled["pending"] = [_WHOLE]
    tables.publish(spark, root, version, parts, changed, filled)
    return version


_WHOLE = "all"


def pending_edits(spark: SparkSession, root: str, version: str) -> DataFrame:
    """Edits whose record has not come yet."""
    at = tables.listing(spark, root, version).get("pending", {}).get(_WHOLE)
    if at is None:
        return spark.createDataFrame([], _PENDING)
    return spark.read.schema(_PENDING).parquet(f"{root}/pending/version={at}")


def drain_corrections(
    spark: SparkSession, stream: DataFrame, root: str, before: str, state: str
) -> str:
    """Run a stream of corrections over everything available; returns the last version.

    Versions are named by the stream's own id, which its checkpoint keeps, and the number of the
    micro-batch: a retried one writes the same version again, and another stream, or one whose
    checkpoint is new, writes others. Its first micro-batch follows on ``before``.
    """
    known = threading.Event()
    started = {}

    def merge(batch: DataFrame, number: int) -> None:
        known.wait()
        run = started["run"]
        last = _last_version(spark, root, run, number)
        merge_batch(spark, root, batch, last or before, _name(run, number), run)

    run = (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    started["run"] = str(run.id)
    known.set()
    run.awaitTermination()
    return _last_version(spark, root, started["run"], None) or before


def _name(run: str, number: int) -> str:
    return f"{run}-{number:09d}"


def _last_version(spark: SparkSession, root: str, run: str, number: int | None) -> str | None:
    """The newest version of a stream, before that of a micro-batch when its number is given."""
    own = tables.versions(spark, root).filter(F.col("version").startswith(f"{run}-"))
    if number is not None:
        own = own.filter(F.col("version") < _name(run, number))
    return own.agg(F.max("version")).first()[0]
