"""Checks on batches and tables: rows are flagged, not refused one request at a time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.calendar import moment_lit
from chronofold.functions.keys import GUID_LENGTH
from chronofold.sources.session import kept

# The operations a batch may carry, and what each of them needs.
INSERTS = ("old", "begin")
UPDATES = ("ending", "edit")
_NEEDS_DATE = ("old", "begin", "edit")
_NEEDS_END = ("old", "ending", "edit")
_NEEDS_GUID = UPDATES

_DATE_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}$"
_TIME_SHAPE = r"^\d{1,2}:\d{1,2}:\d{1,2}$"


def is_date(text: Column) -> Column:
    return F.coalesce(text.rlike(_DATE_SHAPE), F.lit(False)) & text.try_cast("date").isNotNull()


def is_time(text: Column) -> Column:
    moment = F.concat(F.lit("2000-01-01 "), text).try_cast("timestamp_ntz")
    return F.coalesce(text.rlike(_TIME_SHAPE), F.lit(False)) & moment.isNotNull()


def record_problems(incoming: DataFrame, now: dt.datetime) -> DataFrame:
    """Add ``problems``, the names of the rules a text record breaks, in a fixed order."""
    operation = F.col("operation")
    date, begin, end = F.col("date"), F.col("time_beginning"), F.col("time_ending")
    guid = F.col("guid")
    moment = moment_lit(now)

    def future(time: Column) -> Column:
        whole = F.concat(date, F.lit(" "), time).try_cast("timestamp_ntz")
        return is_date(date) & is_time(time) & (whole > moment)

    dated = operation.isin(*_NEEDS_DATE)
    ended = operation.isin(*_NEEDS_END)
    keyed = operation.isin(*_NEEDS_GUID)
    rules = {
        "operation": ~F.coalesce(operation.isin(*INSERTS, *UPDATES), F.lit(False)),
        "guid": F.coalesce(F.length(guid) != GUID_LENGTH, keyed),
        "date": F.when(date.isNull(), dated).otherwise(~is_date(date)),
        "time_beginning": F.when(begin.isNull(), dated).otherwise(~is_time(begin)),
        "time_ending": F.when(end.isNull(), ended).otherwise(~is_time(end)),
        "future": F.coalesce(future(begin), F.lit(False)) | F.coalesce(future(end), F.lit(False)),
    }
    found = [F.when(broken, F.lit(name)) for name, broken in rules.items()]
    return incoming.withColumn("problems", F.array_compact(F.array(*found)))


def duplicates(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once; missing values equal each other."""
    counts = frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") > 1)


def name_problem(name: Column, required: bool = False) -> Column:
    """What is wrong with a task, subtask or tag name, NULL when nothing is."""
    problem = F.when(name.rlike(r"(?U)\s"), F.lit("whitespace")).when(
        name.rlike(r"^[+-]?\d+(_\d+)*$"), F.lit("number")
    )
    if required:
        problem = problem.when(name.isNull() | (name == ""), F.lit("empty"))
    return problem


def orphans(records: DataFrame, tasks: DataFrame, tags: DataFrame) -> DataFrame:
    """Records whose task or tag does not exist, a row for each missing key.

    The keys in use shrink to distinct ones on the map side, in one scan of two columns, so no busy
    key fills a task, and only these meet the dimensions. What is missing is a short list as a
    rule, whose measured size lets Spark match the records with it where they are.
    """
    known = _keys(tasks, "task_id").unionByName(_keys(tags, "tag_id"))
    missing = kept(_keys(records, "task_id", "tag_id").join(known, ["_kind", "_key"], "left_anti"), "missing")
    joined = records
    for key in ("task_id", "tag_id"):
        lost = missing.where(F.col("_kind") == key).select(F.col("_key").alias(key), F.lit(True).alias(f"_no_{key}"))
        joined = joined.join(lost, key, "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("_no_task_id"), F.lit("unknown task")),
            F.when(F.col("_no_tag_id"), F.lit("unknown tag")),
        )
    )
    found = joined.filter(F.col("_no_task_id") | F.col("_no_tag_id"))
    return found.select(*records.columns, F.explode(problems).alias("problem"))


def _keys(frame: DataFrame, *names: str) -> DataFrame:
    """The distinct keys of some columns, with the column that each comes from."""
    pairs = F.array(*[F.struct(F.lit(n).alias("_kind"), F.col(n).alias("_key")) for n in names])
    rows = frame.select(*names).distinct().select(F.inline(pairs))
    return rows.where(F.col("_key").isNotNull()).distinct()
