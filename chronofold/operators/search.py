"""Record search: filters, order, pages, lookups and the JSON shape of a record."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.durations import whole_div
from chronofold.plans.numbering import Ranked, rank
from chronofold.plans.period import SEARCH_ORDER
from chronofold.plans.selection import (
    RecordFilter,
    join_tags,
    join_tasks,
    select_records,
    where,
)
from chronofold.sources.tables import FIRST, WorkLog, read_worklog, records_of

RECORD_COLUMNS = (
    "record_id",
    "user_id",
    "task_name",
    "subtask",
    "date",
    "begin_ts",
    "end_ts",
    "tag",
    "elapsed_s",
    "log",
)


def record_columns(records: DataFrame) -> DataFrame:
    """The enriched projection, as far as the frame carries its columns."""
    present = set(records.columns)
    return records.select(*[name for name in RECORD_COLUMNS if name in present])


def search(records: DataFrame, request: Mapping) -> DataFrame:
    """Matching records of a named frame; no filter means all of them."""
    return record_columns(where(records, RecordFilter.from_request(request, SEARCH_ORDER)))


def find_records(log: WorkLog, request: Mapping) -> DataFrame:
    """``search`` on a star schema."""
    wanted = RecordFilter.from_request(request, SEARCH_ORDER)
    return record_columns(select_records(log, wanted, with_names=True))


def page_count(found: DataFrame, page_size: int) -> DataFrame:
    count = F.count(F.lit(1))
    return found.agg(whole_div(count + (page_size - 1), page_size).cast("long").alias("pages"))


def _newest_first() -> tuple[Column, Column]:
    return F.desc("date"), F.asc("record_id")


def page(found: DataFrame, number: int, page_size: int) -> DataFrame:
    """Page ``number`` (from 1), newest first. Each partition keeps only its leading rows, so
    nothing is sorted in full; the cost grows with the page number, see ``page_after`` and
    ``ranked``."""
    if number < 1 or page_size < 1:
        raise ValueError("page number and size start at 1")
    return found.orderBy(*_newest_first()).offset((number - 1) * page_size).limit(page_size)


def page_after(found: DataFrame, last_date: dt.date, last_id, page_size: int) -> DataFrame:
    """The page that follows a known last row; deep pages cost no more than the first."""
    date, record = F.col("date"), F.col("record_id")
    older = (date < F.lit(last_date)) | ((date == F.lit(last_date)) & (record > F.lit(last_id)))
    return found.filter(older).orderBy(*_newest_first()).limit(page_size)


def ranked(found: DataFrame) -> Ranked:
    """The rows ranked newest first and written once: ``.page(number, size)`` opens the range
    of one page, so a far page costs what the first one does."""
    return rank(found, _newest_first())


def page_with_count(found: DataFrame, number: int, page_size: int) -> DataFrame:
    """A page whose rows also tell how many pages there are."""
    pages = page_count(found.select("record_id"), page_size).scalar()
    return page(found, number, page_size).withColumn("pages", pages)


def by_keys(log: WorkLog, wanted: DataFrame) -> DataFrame:
    """Enriched records for a batch of record keys."""
    found = log.records.join(wanted.select("record_id").distinct(), "record_id", "left_semi")
    return record_columns(join_tags(join_tasks(found, log.tasks), log.tags))


def find_by_keys(
    spark: SparkSession, root: str, wanted: DataFrame, version: str = FIRST
) -> DataFrame:
    """``by_keys`` on a stored table: only the buckets of the keys and the months that hold them
    are opened, and within these only row groups whose filters may hold one of a few keys."""
    log = read_worklog(spark, root, version)
    found = records_of(spark, root, version, wanted.select("record_id"))
    return record_columns(join_tags(join_tasks(found, log.tasks), log.tags))


def as_json(records: DataFrame) -> DataFrame:
    """One JSON text per record."""
    fields: list[Column] = [F.col(name) for name in records.columns]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"})
    return records.select("record_id", text.alias("record"))
