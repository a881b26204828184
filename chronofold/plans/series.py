"""Shares of a whole and dense series per group.

Both work on aggregates, never on raw records: by the time rows of one user meet in a
task there is at most one per (period, task), however many records that user wrote.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.functions.durations import percent

USER = ("user_id",)


def sums(records: DataFrame, by: Sequence[str | Column], alias: str = "total_time") -> DataFrame:
    """Seconds per group; a group with only running records has a NULL total."""
    return records.groupBy(*by).agg(F.sum("elapsed_s").alias(alias))


def with_share(
    parts: DataFrame,
    whole_by: Sequence[str],
    part: str,
    whole: str,
    ratio: str = "ratio",
    apart: bool = True,
) -> DataFrame:
    """Add the total of ``whole_by`` and each part's percentage of it.

    Without grouping columns the whole is one number, computed as a scalar subquery so that
    the parts stay where they are instead of meeting in a single window partition. When people
    are not kept apart (``apart`` is False) the parts of a group may be very many, so the wholes,
    one row per period, are summed by themselves and joined.
    """
    if whole_by and not apart:
        wholes = parts.groupBy(*whole_by).agg(F.sum(part).alias(whole))
        parts = parts.join(wholes, list(whole_by))
    else:
        total = (
            F.sum(part).over(Window.partitionBy(*whole_by))
            if whole_by
            else parts.select(F.sum(part)).scalar()
        )
        parts = parts.withColumn(whole, total)
    return parts.withColumn(ratio, percent(F.col(part), F.col(whole)))


def by_user(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put all aggregate rows of a user together once, so the groupings and windows that
    follow on finer keys need no further shuffle."""
    return frame.repartition(*keys) if keys else frame


def ordered(frame: DataFrame, keys: Sequence[str], *order: str | Column) -> DataFrame:
    """Order the rows of every user; a total order only when there is a single group.

    Expects rows of a user to be in one partition already (after a window or ``by_user``).
    """
    if keys:
        return frame.sortWithinPartitions(*keys, *order)
    return frame.orderBy(*order)


def spread(
    frame: DataFrame,
    by: Sequence[str],
    size: int,
    values: Mapping[str, tuple[Column, str]],
    known_until: int | None = None,
) -> DataFrame:
    """One array per entry of ``values``, indexed by the column ``place`` (0 .. size-1).

    An entry is an aggregate and the SQL literal that fills its gaps. Rows are first aggregated
    per (group, place) with map-side partial results, so a group has at most ``size`` rows when
    its array is built. Places from ``known_until`` on lie in the future and stay NULL.
    """
    if size <= 0:
        raise ValueError("a series needs at least one place")
    known = size if known_until is None else min(known_until, size)
    aggregates = [value.alias(name) for name, (value, _) in values.items()]
    narrow = frame.groupBy(*by, "place").agg(*aggregates)
    maps = narrow.groupBy(*by).agg(
        *[F.map_from_entries(F.collect_list(F.struct("place", name))).alias(name) for name in values]
    )

    def array(name: str, fill: str) -> Column:
        def at(place: Column) -> Column:
            value = F.coalesce(F.try_element_at(F.col(name), place), F.expr(fill))
            return F.when(place < known, value)

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at).alias(name)

    return maps.select(*by, *[array(name, fill) for name, (_, fill) in values.items()])


def dense_series(
    records: DataFrame,
    keys: Sequence[str],
    size: int,
    users: DataFrame | None = None,
    known_until: int | None = None,
) -> DataFrame:
    """Seconds per ``place`` as one array ``data`` per group, 0 where nothing was recorded.

    ``users`` adds the groups that recorded nothing at all in the range.
    """
    series = spread(records, keys, size, {"data": (F.sum("elapsed_s"), "0L")}, known_until)
    if users is None:
        return series
    known = size if known_until is None else known_until
    nothing = ", ".join("0L" if place < known else "nullif(0L, 0L)" for place in range(size))
    return users.join(series, list(keys), "left").select(
        *keys, F.coalesce("data", F.expr(f"array({nothing})")).alias("data")
    )


def dense_rows(
    records: DataFrame, keys: Sequence[str], size: int, users: DataFrame | None = None
) -> DataFrame:
    """``dense_series`` as one row per group and place, with its ``total``.

    The arrays are never empty; the outer form merely keeps the optimizer from testing that,
    which would build every array twice.
    """
    series = dense_series(records, keys, size, users)
    return series.select(*keys, F.posexplode_outer("data").alias("place", "total"))
