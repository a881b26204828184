"""Batch ingest and merge.

Every function maps the current rows and a batch of changes to new rows; writing them back
is ``sources.tables.upsert_records``. When a batch names a key twice, its last entry (by the
``seq`` column) counts. All joins are plain equi-joins: small sides are broadcast after their
size is measured, large ones are shuffled.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.calendar import moment_lit
from chronofold.functions.durations import elapsed_seconds
from chronofold.functions.keys import with_free_keys
from chronofold.functions.text import split_task_text, strip, title_case
from chronofold.plans.series import USER


def last_per_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last entry of every key: the greatest ``order`` (NULL is lowest), among equals the
    greatest of the other values in turn. Partial maxima are taken before the shuffle, so a key
    that fills a third of the batch costs one row per task."""
    values = [name for name in batch.columns if name not in (key, order)]
    last = batch.groupBy(key).agg(F.max(F.struct(order, *values)).alias("_last"))
    return last.select(key, *[f"_last.{name}" for name in batch.columns if name != key])


def normalise_tasks(tasks: DataFrame) -> DataFrame:
    """Title case for both names; an empty subtask is no subtask."""
    subtask = F.nullif(F.col("subtask"), F.lit(""))
    return tasks.withColumns(
        {"task_name": title_case(F.col("task_name")), "subtask": title_case(subtask)}
    )


def _same_task(left: DataFrame, right: DataFrame) -> Column:
    """Equality of (task, subtask) in which two missing subtasks are equal."""
    return (left["task_name"] == right["task_name"]) & left["subtask"].eqNullSafe(right["subtask"])


def new_tasks(incoming: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows for the incoming (task, subtask) pairs that do not exist yet."""
    pairs = normalise_tasks(incoming.select("task_name", "subtask")).distinct()
    missing = pairs.join(tasks, _same_task(pairs, tasks), "left_anti")
    return with_free_keys(missing, ("task_name", "subtask"), tasks, "task_id")


def add_tasks(incoming: DataFrame, tasks: DataFrame) -> DataFrame:
    return tasks.unionByName(new_tasks(incoming, tasks))


def resolve_task_names(named: DataFrame, tasks: DataFrame) -> DataFrame:
    """Add ``task_id`` by names; NULL where the task does not exist."""
    keys = tasks.select("task_id", "task_name", "subtask")
    return named.join(keys, _same_task(named, keys), "left").select(
        *[named[name] for name in named.columns], keys["task_id"]
    )


def task_ids_from_text(
    incoming: DataFrame, tasks: DataFrame, text: str = "task_text"
) -> tuple[DataFrame, DataFrame]:
    """Records whose task is written as ``task subtask`` text: the tasks, completed by the
    ones the batch names for the first time, and the batch with ``task_id``."""
    task, subtask = split_task_text(F.col(text))
    named = normalise_tasks(incoming.withColumns({"task_name": task, "subtask": subtask}))
    complete = add_tasks(named, tasks)
    return complete, resolve_task_names(named, complete)


def resolve_keys(incoming: DataFrame, tasks: DataFrame, tags: DataFrame) -> DataFrame:
    """Replace task and tag guids by ids. ``problem`` names what could not be resolved; a
    record needs a task, a tag is optional."""
    by_task = tasks.select(F.col("guid").alias("task_guid"), "task_id")
    by_tag = tags.select(F.col("guid").alias("tag_guid"), "tag_id")
    resolved = incoming.join(by_task, "task_guid", "left").join(by_tag, "tag_guid", "left")
    problem = F.when(F.col("task_id").isNull(), F.lit("unknown task")).when(
        F.col("tag_guid").isNotNull() & F.col("tag_id").isNull(), F.lit("unknown tag")
    )
    return resolved.withColumn("problem", problem).drop("task_guid", "tag_guid")


def _claims(
    rows: DataFrame, latest: DataFrame, names: Sequence[str]
) -> DataFrame:
    """``latest`` changes (guid, seq, new names) with their ``outcome``.

    ``unknown`` guid; ``refused`` when another row has the new names, or an earlier change of the
    batch takes them; ``changed`` otherwise.
    """
    own = rows.select("guid", F.lit(True).alias("_known"))
    found = latest.join(own, "guid", "left")
    # Holders of a name: rows as they are, and the first change that asks for it.
    key = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("_name")
    holders = rows.select(key, F.col("guid").alias("_holder"))
    asked = found.filter("_known").select(key, F.struct("seq", "guid").alias("_ask"))
    first = asked.groupBy("_name").agg(F.min("_ask")["guid"].alias("_first"))
    judged = (
        found.withColumn("_name", key).join(holders, "_name", "left").join(first, "_name", "left")
    )
    taken = F.col("_holder").isNotNull() & (F.col("_holder") != F.col("guid"))
    outcome = (
        F.when(F.col("_known").isNull(), F.lit("unknown"))
        .when(taken | (F.col("_first") != F.col("guid")), F.lit("refused"))
        .otherwise(F.lit("changed"))
    )
    return judged.select(*latest.columns, outcome.alias("outcome"))


def _task_changes(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    latest = last_per_key(normalise_tasks(changes), "guid", "seq")
    return _claims(tasks, latest.select("guid", "seq", "task_name", "subtask"), ("task_name", "subtask"))


def task_change_outcome(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """For each guid to change: ``changed``, ``refused`` (its new names are taken) or ``unknown``."""
    return _task_changes(tasks, changes).select("guid", "outcome")


def update_tasks(tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace both names of the tasks whose guid a change mentions, unless another task has
    them; ``task_change_outcome`` tells what became of every change."""
    latest = _task_changes(tasks, changes).filter("outcome = 'changed'").select(
        "guid",
        F.col("task_name").alias("_task"),
        F.col("subtask").alias("_subtask"),
        F.lit(True).alias("_changed"),
    )
    return tasks.join(latest, "guid", "left").select(
        "task_id",
        F.coalesce("_task", "task_name").alias("task_name"),
        F.when(F.col("_changed"), F.col("_subtask")).otherwise(F.col("subtask")).alias("subtask"),
        "guid",
    )


def deletion_outcome(
    dimension: DataFrame, key: str, wanted: DataFrame, records: DataFrame
) -> DataFrame:
    """For each guid to delete: ``deleted``, ``blocked`` by a record, or ``unknown``.

    Records shrink to their distinct keys on the map side, so no busy task can fill a join
    partition.
    """
    used = records.select(key).distinct().withColumn("_used", F.lit(True))
    found = wanted.select("guid").distinct().join(dimension.select("guid", key), "guid", "left")
    outcome = (
        F.when(F.col(key).isNull(), F.lit("unknown"))
        .when(F.col("_used"), F.lit("blocked"))
        .otherwise(F.lit("deleted"))
    )
    return found.join(used, key, "left").select("guid", outcome.alias("outcome"))


def delete_unreferenced(
    dimension: DataFrame, key: str, wanted: DataFrame, records: DataFrame
) -> DataFrame:
    """The dimension without the wanted rows that no record refers to."""
    gone = deletion_outcome(dimension, key, wanted, records).filter("outcome = 'deleted'")
    return dimension.join(gone, "guid", "left_anti")


def merge_tags(tags: DataFrame, changes: DataFrame, records: DataFrame) -> DataFrame:
    """Apply ``rename``, ``delete`` and ``add`` entries (column ``operation``), in that order.

    A rename to a name that is taken is refused (``tag_rename_outcome``), referenced tags stay, tags
    that exist are not added again.
    """
    renames = _tag_renames(tags, changes).filter("outcome = 'changed'")
    renamed = tags.join(renames.select("guid", F.col("tag").alias("_tag")), "guid", "left").select(
        "tag_id", F.coalesce("_tag", "tag").alias("tag"), "guid"
    )
    kept = delete_unreferenced(renamed, "tag_id", changes.filter("operation = 'delete'"), records)
    added = changes.filter("operation = 'add'").select("tag")
    return kept.unionByName(new_tags(added, kept)).select("tag_id", "tag", "guid")


def _tag_renames(tags: DataFrame, changes: DataFrame) -> DataFrame:
    latest = last_per_key(changes.filter("operation = 'rename'"), "guid", "seq")
    return _claims(tags, latest.select("guid", "seq", "tag"), ("tag",))


def tag_rename_outcome(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """For each guid to rename: ``changed``, ``refused`` (the name is taken) or ``unknown``."""
    return _tag_renames(tags, changes).select("guid", "outcome")


def new_tags(incoming: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows for the incoming ``tag`` names that do not exist yet; no name, no tag."""
    names = incoming.select("tag").filter(F.col("tag") != "").distinct()
    return with_free_keys(names.join(tags, "tag", "left_anti"), ("tag",), tags, "tag_id")


def resolve_tag_names(named: DataFrame, tags: DataFrame) -> DataFrame:
    """Add ``tag_id`` by name; NULL where the tag does not exist."""
    return named.join(tags.select("tag", "tag_id"), "tag", "left")


def tag_ids_from_text(
    incoming: DataFrame, tags: DataFrame, text: str = "tag_text"
) -> tuple[DataFrame, DataFrame]:
    """Records whose tag is written as text: the tags, completed by those the batch names for the
    first time, and the batch with ``tag_id`` (NULL for empty text)."""
    named = incoming.withColumn("tag", F.nullif(strip(F.col(text)), F.lit("")))
    complete = tags.unionByName(new_tags(named, tags).select(*tags.columns))
    return complete, resolve_tag_names(named, complete)


def change_outcome(records: DataFrame, changes: DataFrame) -> DataFrame:
    """For each record an ending or edit names: ``applied``, or ``unknown`` when no such record is
    stored. Unknown ones belong in a table of their own until their record comes."""
    wanted = changes.select("record_id").distinct()
    known = records.select("record_id", F.lit(True).alias("_known"))
    outcome = F.when(F.col("_known"), F.lit("applied")).otherwise(F.lit("unknown"))
    return wanted.join(known, "record_id", "left").select("record_id", outcome.alias("outcome"))


def _moment(date: str, time: str) -> Column:
    """Date text and time text as one wall-clock time, NULL when either is malformed."""
    return F.concat(F.col(date), F.lit(" "), F.col(time)).try_cast("timestamp_ntz")


def _later(begin: Column, seconds: Column) -> Column:
    return begin + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def typed_records(incoming: DataFrame) -> DataFrame:
    """Text columns of a batch as dates and times, with elapsed seconds.

    An end at or before the begin is on the next day. A batch without ``time_ending`` holds
    beginnings and gives running records.
    """
    if "time_ending" not in incoming.columns:
        incoming = incoming.withColumn("time_ending", F.lit(None).cast("string"))
    begin, end = _moment("date", "time_beginning"), _moment("date", "time_ending")
    seconds = elapsed_seconds(begin, end)
    others = [
        name for name in incoming.columns if name not in ("date", "time_beginning", "time_ending")
    ]
    return incoming.select(
        *others,
        F.col("date").try_cast("date").alias("date"),
        begin.alias("begin_ts"),
        _later(begin, seconds).alias("end_ts"),
        seconds.alias("elapsed_s"),
    )


def add_endings(records: DataFrame, endings: DataFrame) -> DataFrame:
    """Close records by key: end time, log and elapsed seconds. Others stay as they are."""
    latest = last_per_key(endings, "record_id", "seq").select(
        "record_id", F.col("time_ending").alias("_end"), F.col("log").alias("_log")
    )
    closed = F.col("_end").isNotNull()
    seconds = elapsed_seconds(F.col("begin_ts"), F.col("_end"))
    joined = records.join(latest, "record_id", "left")
    return joined.withColumns(
        {
            "end_ts": F.when(closed, _later(F.col("begin_ts"), seconds)).otherwise(F.col("end_ts")),
            "elapsed_s": F.when(closed, seconds).otherwise(F.col("elapsed_s")),
            "log": F.when(closed, F.col("_log")).otherwise(F.col("log")),
        }
    ).select(*records.columns)


def apply_edits(records: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace task, date and times of the edited records; tag and log only when the edit
    carries a new value. Elapsed seconds are computed again; an end at or before the begin is on
    the next day."""
    names = ("task_id", "date", "begin_ts", "end_ts", "tag_id", "log")
    latest = last_per_key(edits, "record_id", "seq").select(
        "record_id", *[F.col(name).alias(f"_{name}") for name in names], F.lit(True).alias("_edited")
    )
    edited = F.col("_edited")
    seconds = elapsed_seconds(F.col("_begin_ts"), F.col("_end_ts"))
    columns = {
        name: F.when(edited, F.col(f"_{name}")).otherwise(F.col(name))
        for name in ("task_id", "date", "begin_ts")
    }
    end = _later(F.col("_begin_ts"), seconds)
    columns["end_ts"] = F.when(edited, end).otherwise(F.col("end_ts"))
    columns["tag_id"] = F.coalesce("_tag_id", "tag_id")
    columns["log"] = F.coalesce("_log", "log")
    columns["elapsed_s"] = F.when(edited, seconds).otherwise(F.col("elapsed_s"))
    return records.join(latest, "record_id", "left").withColumns(columns).select(*records.columns)


def extend_last(
    records: DataFrame, now: dt.datetime, order: str = "record_id", keys: Sequence[str] = USER
) -> DataFrame:
    """The latest record of every user with its end moved to ``now``: the rows to write back.

    ``order`` is unique within a user. It is found from two narrow columns with map-side
    maxima; only then are whole records matched, on a key that no user can make busy.
    """
    last = records.groupBy(*keys).agg(F.max(order).alias(order))
    rows = records.join(last, [*keys, order], "left_semi")
    seconds = elapsed_seconds(F.col("begin_ts"), moment_lit(now))
    return rows.withColumns(
        {"end_ts": _later(F.col("begin_ts"), seconds), "elapsed_s": seconds}
    )
