"""Pieces of DuckDB text the twins share."""

from __future__ import annotations


def hms(seconds: str) -> str:
    s = f"({seconds})"
    return f"printf('%02d:%02d:%02d', {s} // 3600, ({s} % 3600) // 60, {s} % 60)"


def dhms(seconds: str) -> str:
    s = f"({seconds})"
    days = (
        f"printf('%02d:%02d:%02d:%02d', {s} // 86400, ({s} % 86400) // 3600, "
        f"({s} % 3600) // 60, {s} % 60)"
    )
    return f"case when {s} >= 86400 then {days} else {hms(seconds)} end"


def parts(text: str) -> str:
    """Clock text as a JSON array of its parts."""
    return f"cast(to_json(string_split({text}, ':')) as varchar)"


def scaled(seconds: str) -> str:
    return f"case when ({seconds}) > 86400 then {dhms(seconds)} else {hms(seconds)} end"


def percent(part: str, whole: str) -> str:
    return (
        f"cast((2000 * cast({part} as bigint) + cast({whole} as bigint)) "
        f"// (2 * nullif(cast({whole} as bigint), 0)) as double) / 10"
    )


def total(column: str = "elapsed_s") -> str:
    return f"cast(sum({column}) as bigint)"


def iso(day: str) -> str:
    return f"strftime({day}, '%Y-%m-%d')"
