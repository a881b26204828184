"""Array-valued chart series.

Every series is dense over its labels: 0 for a past period without records, NULL for a
period that lies in the future.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions import calendar as cal
from chronofold.functions.durations import percent
from chronofold.plans.period import Period
from chronofold.plans.series import (
    USER,
    by_user,
    dense_series,
    spread,
    sums,
    with_share,
)
from chronofold.sources.tables import in_period

# Fixed value: the name of every line series.
LINE_NAME = "Total time"


def known_places(grain: str, period: Period, as_of) -> int:
    """How many labels of the period have begun by ``as_of``."""
    if as_of < period.first:
        return 0
    return cal.label_count(grain, period.first, min(as_of, period.last))


def _placed(records: DataFrame, grain: str, period: Period) -> DataFrame:
    """The records of a period with ``place``, the position of their label."""
    place = cal.label_position(grain, F.col("date"), period.first)
    return in_period(records, period).withColumn("place", place)


def line_chart(
    records: DataFrame,
    grain: str,
    period: Period,
    as_of=None,
    keys: Sequence[str] = USER,
    users: DataFrame | None = None,
) -> DataFrame:
    """``name`` and ``data``: one total per label. With ``as_of`` the future stays NULL."""
    placed = _placed(records, grain, period)
    size = cal.label_count(grain, period.first, period.last)
    known = None if as_of is None else known_places(grain, period, as_of)
    series = dense_series(placed, keys, size, users, known)
    return series.select(*keys, F.lit(LINE_NAME).alias("name"), "data")


def stacked_chart(
    records: DataFrame, grain: str, period: Period, keys: Sequence[str] = USER
) -> DataFrame:
    """Per task its share at every label, 0 where the task is absent."""
    totals = sums(_placed(records, grain, period), [*keys, "place", "task_name"], "task_total")
    shares = with_share(
        by_user(totals, keys), [*keys, "place"], "task_total", "whole", apart=bool(keys)
    )
    size = cal.label_count(grain, period.first, period.last)
    series = spread(shares, [*keys, "task_name"], size, {"data": (F.max("ratio"), "0D")})
    return series.withColumnRenamed("task_name", "name")


def chart_pair(
    records: DataFrame,
    grain: str,
    period: Period,
    line_period: Period | None = None,
    known_until: int | None = None,
    keys: Sequence[str] = USER,
) -> DataFrame:
    """Stacked and line chart of one period from a single pass over the records.

    The records are summed once per (user, label, task). Those sums are then placed by user,
    and the task arrays, the label totals and the user's row all reuse that placement without
    a sort. A user's row holds tasks x labels values, whatever the number of records behind
    them. ``line_period`` narrows the line to part of the period.
    """
    if not keys:
        raise ValueError("a chart pair is one row per key; everybody's tasks do not fit in one row")
    size = cal.label_count(grain, period.first, period.last)
    known = size if known_until is None else known_until
    seconds = {"data": F.col("elapsed_s")}
    if line_period is not None:
        seconds["line"] = F.when(line_period.contains(F.col("date")), F.col("elapsed_s"))
    totals = (
        _placed(records, grain, period)
        .groupBy(*keys, "place", "task_name")
        .agg(*[F.sum(column).alias(name) for name, column in seconds.items()])
    )
    values = {name: (F.sum(name), "0L") for name in seconds}
    per_task = spread(by_user(totals, keys), [*keys, "task_name"], size, values)

    def label_totals(name: str, until: int) -> Column:
        items = [
            f"sum(get({name}, {place}))" if place < until else "nullif(0L, 0L)"
            for place in range(size)
        ]
        return F.expr(f"array({', '.join(items)})")

    per_user = per_task.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("task_name", "data"))).alias("tasks"),
        label_totals("data", size).alias("whole"),
        label_totals("data" if line_period is None else "line", known).alias("line"),
    )

    def shares(task: Column) -> Column:
        return F.zip_with(
            task["data"], "whole", lambda part, whole: F.coalesce(percent(part, whole), F.lit(0.0))
        )

    stacked = F.transform(
        "tasks", lambda task: F.struct(task["task_name"].alias("name"), shares(task).alias("data"))
    )
    return per_user.select(*keys, stacked.alias("stacked"), "line")
