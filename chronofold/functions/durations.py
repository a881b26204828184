"""Seconds: elapsed time, clock text and exact percentages.

Seconds are kept as whole longs, so sums do not depend on the order in which
partitions arrive and every ratio is computed in integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400


def whole_div(numerator: Column, denominator: Column | int) -> Column:
    """Integer division; NULL when the denominator is zero (ANSI mode would raise)."""
    if not isinstance(denominator, Column):
        denominator = F.lit(denominator)
    return F.call_function("div", numerator, F.nullif(denominator, F.lit(0)))


def percent(part: Column, whole: Column) -> Column:
    """``part / whole`` in percent, rounded half up to one decimal, NULL for an empty whole."""
    part, whole = part.cast("decimal(28,0)"), whole.cast("decimal(28,0)")
    return whole_div(part * 2000 + whole, whole * 2).cast("double") / 10


def second_of_day(moment: Column) -> Column:
    return (F.hour(moment) * 3600 + F.minute(moment) * 60 + F.second(moment)).cast("long")


def elapsed_seconds(begin: Column, end: Column) -> Column:
    """Seconds between two clock times; an end at or before the begin is on the next day."""
    return _past_midnight(second_of_day(end) - second_of_day(begin))


def elapsed_instants(begin: Column, end: Column) -> Column:
    """``elapsed_seconds`` for instants at most a day apart, independent of the time zone."""
    return _past_midnight(F.unix_seconds(end) - F.unix_seconds(begin))


def _past_midnight(diff: Column) -> Column:
    return F.when(diff > 0, diff).otherwise(diff + DAY_SECONDS)


def _clock(total: Column) -> Column:
    return F.format_string(
        "%02d:%02d:%02d", whole_div(total, 3600), whole_div(total % 3600, 60), total % 60
    )


def _days_and_clock(total: Column) -> Column:
    return F.format_string(
        "%02d:%02d:%02d:%02d",
        whole_div(total, DAY_SECONDS),
        whole_div(total % DAY_SECONDS, 3600),
        whole_div(total % 3600, 60),
        total % 60,
    )


def duration_text(seconds: Column, max_unit: str = "hour") -> Column:
    """``HH:MM:SS``, or ``DD:HH:MM:SS`` from one day on when ``max_unit`` is day."""
    if max_unit not in ("hour", "day"):
        raise ValueError(f"max_unit must be hour or day, not {max_unit!r}")
    total = F.floor(seconds).cast("long")
    if max_unit == "day":
        return F.when(total >= DAY_SECONDS, _days_and_clock(total)).when(
            total.isNotNull(), _clock(total)
        )
    return F.when(total.isNotNull(), _clock(total))


def scaled_duration_text(seconds: Column) -> Column:
    """With days only when strictly more than one day."""
    total = F.floor(seconds).cast("long")
    return F.when(seconds > DAY_SECONDS, _days_and_clock(total)).when(
        total.isNotNull(), _clock(total)
    )


def split_text(duration: Column) -> Column:
    """The parts of a duration text."""
    return F.split(duration, ":")
