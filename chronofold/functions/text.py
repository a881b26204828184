"""Text rules for task names, tags and logs, as built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_SEPARATOR = "  \n"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+|(?U)\s+$", "")


def title_case(text: Column) -> Column:
    """Capital first letter in every run of letters, lower case after it."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(
            runs,
            lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(run.substr(F.lit(2), F.length(run)))),
        ),
        "",
    )


def split_task_text(text: Column) -> tuple[Column, Column]:
    """``task`` and ``subtask`` around the first non-word character; no separator, no subtask."""
    pieces = F.split(strip(text), r"(?U)\W", 2)
    return title_case(pieces[0]), title_case(F.try_element_at(pieces, F.lit(2)))


def contains_text(column: Column, needle: str) -> Column:
    """Literal containment, ignoring the case of ASCII letters only.

    The needle is escaped, so ``%``, ``_`` and regex signs stand for themselves, and the
    text is matched in place rather than lower-cased into a second copy.
    """
    return column.rlike("(?i)" + re.escape(needle))


def matches_like(column: Column, pattern: str) -> Column:
    """SQL LIKE over the whole value, ignoring the case of ASCII letters only."""
    signs = {"%": ".*", "_": "."}
    body = "".join(signs.get(char, re.escape(char)) for char in pattern)
    return column.rlike(rf"(?is)\A{body}\z")


def snake_case(name: str) -> str:
    """Column name: every capital becomes an underscore and a small letter."""
    return re.sub("[A-Z]", lambda capital: "_" + capital.group().lower(), name)


def join_log_pieces(order: str, piece: str) -> Column:
    """Aggregate: the pieces of one log in entry order."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(piece))))
    return F.array_join(F.transform(pieces, lambda entry: entry[piece]), LOG_SEPARATOR)
