"""Quality rules with host verdicts.

Each text is measured by itself. Rule failures are then summed by host, each host's rate is shrunk
towards the mean of all hosts by a beta prior fitted to the hosts (method of moments), and hosts
whose shrunk rate of any rule passes ``host_limit`` are rejected with all their texts. A small
host therefore needs more evidence than a large one.

Null text: no words, which fails the rule of least words. Null or empty source: a host unknown, so
only the text's own rules count. Repeated rows are measured and counted each. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.flat import (
    byte_hashes,
    pieces,
    run_hashes,
    run_starts,
    word_hashes,
    words,
)
from chronofold.llm.tables import written

#: A text fails a rule beyond these bounds; the first two also make ``base_failed``.
LEAST_WORDS = 10
REPEAT_PERCENT = 20
SYMBOL_PERCENT = 50
DUPLICATE_LINE_PERCENT = 50
WORD_CHARS = (2, 20)

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_MEASURES = (
    "doc_id long, source string, n_words long, word_chars long, n_symbols long, n_lines long, "
    "n_dup_lines long, n_repeat_words long"
)
_RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for every i."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether (owner, value) occurs twice or more, and whether it occurred before."""
    order = np.lexsort((np.arange(len(value)), value, owner))
    o, v = owner[order], value[order]
    same = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    before = np.concatenate([[False], same])[: len(v)]
    after = np.concatenate([same, [False]])[: len(v)]
    twice, again = np.zeros(len(v), dtype=bool), np.zeros(len(v), dtype=bool)
    twice[order], again[order] = before | after, before
    return twice, again


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in pieces(batches, "text"):
        n = batch.num_rows
        found = words(data, offsets)
        counts = found.counts
        hashes = word_hashes(data, found)

        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
        word_chars = _sums(chars[found.end] - chars[found.start], found.first)

        at = run_starts(counts, 5)
        owner = np.repeat(np.arange(n), np.maximum(counts - 4, 0))
        twice, _ = _repeated(owner, run_hashes(hashes, at, 5))
        mark = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(mark, at[twice], 1)
        np.add.at(mark, at[twice] + 5, -1)
        repeats = _sums(np.cumsum(mark)[:-1] > 0, found.first)

        breaks = np.flatnonzero(data == 0x0A)
        start = np.concatenate([offsets[:-1], breaks + 1])
        text = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, side="right") - 1])
        order = np.lexsort((start, text))
        start, text = start[order], text[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        last = np.append(text[1:] != text[:-1], True)[: len(text)]
        end[last] = offsets[text[last] + 1]
        solid = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
        start, end, text = start[solid], end[solid], text[solid]
        _, again = _repeated(text, byte_hashes(data, start, end))

        columns = [
            counts.astype(np.int64),
            word_chars,
            _sums(_SYMBOLS[data], offsets),
            np.bincount(text, minlength=n),
            np.bincount(text[again], minlength=n),
            repeats,
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), *map(pa.array, columns)],
            [c.split()[0] for c in _MEASURES.split(", ")],
        )


def measures(docs: DataFrame) -> DataFrame:
    """Counts of every text, with its id and source."""
    base = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text")
    return base.mapInArrow(_measure, _MEASURES)


def host_of(source: Column) -> Column:
    """Lower-case host of a source, which may be an address or a plain name; null if empty."""
    bare = F.regexp_replace(F.lower(F.trim(source)), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[/?#:].*$", ""), r"^www\.", "")
    return F.when(bare != "", bare)


def with_failures(measured: DataFrame) -> DataFrame:
    """One boolean for each rule, and ``base_failed``."""
    words_, mean = F.col("n_words"), F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return measured.withColumns(
        {
            "few_words": words_ < LEAST_WORDS,
            "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * words_,
            "symbols": 100 * F.col("n_symbols") > SYMBOL_PERCENT * words_,
            "dup_lines": 100 * F.col("n_dup_lines") > DUPLICATE_LINE_PERCENT * F.col("n_lines"),
            "word_length": ~mean.between(*WORD_CHARS),
        }
    ).withColumn("base_failed", F.col("few_words") | F.col("repeats"))


def host_rates(checked: DataFrame) -> DataFrame:
    """Per host: rows, and each rule's failure rate shrunk by the beta prior of all hosts."""
    hosts = (
        checked.withColumn("host", host_of(F.col("source")))
        .where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(
            F.count("*").alias("n_rows"),
            *[F.sum(F.col(r).cast("long")).alias(r) for r in _RULES],
        )
    )
    n = F.col("n_rows")
    total, number = F.sum(n), F.count("*")
    moments = hosts.agg(
        total.alias("total"),
        number.alias("number"),
        *[(F.sum(r) / total).alias(f"mean_{r}") for r in _RULES],
        *[(F.sum(F.col(r) * F.col(r) / n) / total).alias(f"square_{r}") for r in _RULES],
    ).first()
    rates = []
    for rule in _RULES:
        mean, strength = _prior(
            moments["total"], moments["number"], moments[f"mean_{rule}"], moments[f"square_{rule}"]
        )
        rates.append(((F.col(rule) + mean * strength) / (n + strength)).alias(f"rate_{rule}"))
    return hosts.select("host", "n_rows", *rates)


def _prior(total: int | None, number: int, mean: float | None, square: float | None):
    """Mean and strength (prior rows) of the beta prior; the variance between hosts is what the
    weighted variance of their rates has beyond chance."""
    if not total:
        return 0.0, 1.0
    chance = mean * (1 - mean)
    between = square - mean * mean - chance * number / total
    if chance <= 0 or between <= 0:
        return mean, 1e6
    return mean, min(max(chance / between - 1, 1.0), 1e6)


def judge(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """Measures, rule failures, ``host_rejected`` and ``kept`` of every text."""
    checked = written(with_failures(measures(docs)), "measures")
    checked = checked.withColumn("host", host_of(F.col("source")))
    bad = F.greatest(*[F.col(f"rate_{r}") for r in _RULES]) > host_limit
    verdicts = host_rates(checked).select("host", bad.alias("host_rejected"))
    known = checked.where(F.col("host").isNotNull()).join(verdicts, "host", "left")
    unknown = checked.where(F.col("host").isNull()).withColumn("host_rejected", F.lit(False))
    return known.unionByName(unknown).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    )
