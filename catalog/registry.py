"""Registration of queries and the format their results leave the engine in."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Runner = Callable[[SparkSession, str], DataFrame]

_MODULES = (
    "selection",
    "totals",
    "calendars",
    "ratios",
    "charts",
    "search",
    "ingest",
    "quality",
    "streams",
)
_RUNNERS: dict[str, Runner] = {}
_TWINS: dict[str, str] = {}


def response(frame: DataFrame) -> DataFrame:
    """Dates and times as ISO text, nested values as JSON, as the reference answers requests."""
    columns = []
    for field in frame.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column, {"ignoreNullFields": "false"})
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("long")
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def query(name: str, twin: str | None = None) -> Callable[[Runner], Runner]:
    """Register ``run(spark, sf_dir)`` under a name, with its DuckDB twin when it has one."""

    def register(run: Runner) -> Runner:
        if name in _RUNNERS:
            raise ValueError(f"query {name} is registered twice")
        _RUNNERS[name] = lambda spark, sf_dir: response(run(spark, sf_dir))
        if twin is not None:
            _TWINS[name] = twin
        return run

    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"catalog.{module}")


def queries() -> dict[str, Runner]:
    _load()
    return dict(_RUNNERS)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_TWINS)
