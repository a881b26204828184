"""Record selection: filters, and only those dimension joins a request needs.

No dimension is broadcast by hint. Spark broadcasts the ones whose measured size is under
its threshold and shuffles the rest, with adaptive skew splitting for busy tasks.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.text import contains_text
from chronofold.plans import period as periods
from chronofold.plans.period import Period
from chronofold.sources.tables import WorkLog, in_period


@dataclass(frozen=True)
class RecordFilter:
    period: Period | None = None
    task: str | None = None
    subtask: str | None = None
    without_subtask: bool = False
    tag: str | None = None
    log_contains: str | None = None

    @classmethod
    def from_request(
        cls, request: Mapping, order: tuple[str, ...] = periods.STATS_ORDER
    ) -> RecordFilter:
        """A subtask counts only next to a task; the subtask ``"None"`` asks for records without one."""
        task = request.get("task")
        subtask = request.get("subtask") if task is not None else None
        return cls(
            period=periods.from_request(request, order),
            task=task,
            subtask=None if subtask == "None" else subtask,
            without_subtask=subtask == "None",
            tag=request.get("tag"),
            log_contains=request.get("logIncludes", request.get("logSearch")),
        )


def where(records: DataFrame, wanted: RecordFilter) -> DataFrame:
    """Apply a filter to records that already carry the columns it mentions."""
    if wanted.period is not None:
        records = in_period(records, wanted.period)
    if wanted.task is not None:
        records = records.filter(F.col("task_name") == wanted.task)
    if wanted.subtask is not None:
        records = records.filter(F.col("subtask") == wanted.subtask)
    if wanted.without_subtask:
        records = records.filter(F.col("subtask").isNull())
    if wanted.tag is not None:
        records = records.filter(F.col("tag") == wanted.tag)
    if wanted.log_contains:
        records = records.filter(contains_text(F.col("log"), wanted.log_contains))
    return records


def join_tasks(records: DataFrame, tasks: DataFrame, how: str = "inner") -> DataFrame:
    return records.join(tasks.select("task_id", "task_name", "subtask"), "task_id", how)


def join_tags(records: DataFrame, tags: DataFrame, how: str = "left") -> DataFrame:
    """With the tag's name. Records without a tag, which may be most of them, are not sent to one
    task to find that they match nothing: in a shuffle they are spread by a key of their own."""
    if how != "left":
        return records.where(F.col("tag_id").isNotNull()).join(
            tags.select("tag_id", "tag"), "tag_id", how
        )
    lone = F.coalesce(F.col("tag_id"), _spread_null(records)).alias("_tag_key")
    names = tags.select(F.col("tag_id").alias("_tag_key"), "tag")
    joined = records.select("*", F.col("tag_id").isNull().alias("_no_tag"), lone)
    joined = joined.join(names, "_tag_key", "left")
    tag = F.when(~F.col("_no_tag"), F.col("tag")).alias("tag")
    rest = [c for c in records.columns if c != "tag_id"]
    return joined.select("tag_id", *rest, tag)


def _spread_null(records: DataFrame) -> Column:
    """A number below 0 that differs from record to record; keys are 0 and above."""
    other = [c for c in ("record_id", "user_id", "date") if c in records.columns]
    return -1 - F.pmod(F.xxhash64(*other), F.lit(1 << 40))


def select_records(log: WorkLog, wanted: RecordFilter, with_names: bool = False) -> DataFrame:
    """Records of a star schema that pass the filter.

    Tasks are joined only for a task filter, tags only for a tag filter, unless
    ``with_names`` asks for the enriched projection.
    """
    records = log.records
    if with_names or wanted.task is not None:
        records = join_tasks(records, log.tasks)
    if wanted.tag is not None:
        records = join_tags(records, log.tags, "inner")
    elif with_names:
        records = join_tags(records, log.tags, "left")
    return where(records, wanted)
