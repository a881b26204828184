"""Packing of token sequences by patterns.

Texts are tokenised, closed with an end id and, when longer than a sequence, cut into pieces. Only
the histogram of piece lengths is planned over, which has ``capacity`` entries at any size of data:

1. Patterns of two to four lengths that fill a sequence exactly are enumerated from the histogram.
2. Non-negative least squares fits how often each pattern repeats so that their lengths add up to
   the histogram; the repeats are rounded and never use more pieces than there are.
3. The lengths left over are packed by best fit, longest first, many equal sequences at a time.
   Of several shares of the repeats, the one that needs fewest sequences is taken.

The plan says for the n-th piece of a length in which sequence and where it lies, as a few ranges
of n per length. Pieces are numbered within their length in salted groups, so a length that very
many pieces share is numbered in parallel.

Null text counts as empty: one piece, the end id. Rows with a null id are left out; a repeated row
is packed again. Bytes that are not valid UTF-8 are read as U+FFFD. No rows: no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofold.llm.flat import SMALL_PIECE_BYTES
from chronofold.llm.flat import pieces as text_pieces
from chronofold.llm.tables import written
from chronofold.llm.wordpieces import word_coder

#: Pieces that one task numbers within a length.
NUMBERED = 1_000
#: Lengths whose pairs are tried as the larger parts of patterns of three and four.
PATTERN_LENGTHS = 160
FIT_ROUNDS = 400
#: Shares of the fitted repeats that are tried; best fit packs the rest.
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25, 0.1)

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokenised(tokenizer_json: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_coder(tokenizer_json)
        for batch, data, offsets in text_pieces(batches, "text", SMALL_PIECE_BYTES):
            ids, cuts = coder.encode(data, offsets)
            ids = np.insert(ids, cuts[1:], end_id).astype("<u4")
            cuts = cuts + np.arange(len(cuts))
            total = np.diff(cuts)
            count = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = number * capacity
            length = np.minimum(capacity, total[row] - start)
            begin = cuts[row] + start
            raw = ids.tobytes()
            crc = [
                zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin, length, strict=True)
            ]
            names = batch.column("doc_id").to_numpy(zero_copy_only=False)
            columns = [
                pa.array(names[row]),
                pa.array(number.astype(np.int32)),
                pa.array(start.astype(np.int64)),
                pa.array(length.astype(np.int64)),
                pa.array(crc, pa.int64()),
            ]
            labels = [c.split()[0] for c in _PIECES.split(", ")]
            if with_ids:
                edges = np.append(begin, len(ids)).astype(np.int32)
                columns.append(
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int32)))
                )
                labels.append("ids")
            yield pa.RecordBatch.from_arrays(columns, labels)

    return run


def _patterns(histogram: np.ndarray, capacity: int) -> list[tuple[int, ...]]:
    """Patterns of two to four present lengths that fill a sequence exactly."""
    present = np.flatnonzero(histogram)
    have = histogram > 0
    found = {(capacity - a, a) for a in present.tolist() if 2 * a <= capacity and have[capacity - a]}
    # lengths that stand for the histogram's mass, evenly spaced in it
    mass = np.cumsum(histogram[present])
    at = np.searchsorted(mass, np.linspace(0, mass[-1], PATTERN_LENGTHS, endpoint=False), "right")
    usual = np.unique(present[at])
    for i, a in enumerate(usual):
        rest = capacity - a - usual[: i + 1]
        for b, c in zip(usual[: i + 1].tolist(), rest.tolist(), strict=True):
            if c >= 1 and have[c]:
                found.add(tuple(sorted((int(a), b, c), reverse=True)))
            elif c > 1:
                d = int(usual[np.searchsorted(usual, c // 2)]) if c // 2 <= usual[-1] else 0
                if 0 < d < c and have[c - d]:
                    found.add(tuple(sorted((int(a), b, d, c - d), reverse=True)))
    for a, b in zip(usual[::2].tolist(), usual[1::2].tolist(), strict=False):
        for c in usual.tolist():
            d = capacity - a - b - c
            if d >= 1 and have[d]:
                found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(found, reverse=True)


def _fit(patterns: list[tuple[int, ...]], histogram: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 that bring sum(x * pattern) near the histogram: accelerated projected
    gradient on the least-squares error, relative to each length's count."""
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.array([n for p in patterns for n in p], dtype=np.int64)
    scale = 1.0 / np.sqrt(np.maximum(histogram, 1.0))
    value = scale[row]
    target = histogram * scale

    def forward(x):
        return np.bincount(row, weights=value * x[column], minlength=len(histogram))

    def back(r):
        return np.bincount(column, weights=value * r[row], minlength=len(patterns))

    probe = np.ones(len(patterns))
    for _ in range(20):  # power iteration for the largest curvature
        probe = back(forward(probe))
        norm = np.linalg.norm(probe)
        probe /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(FIT_ROUNDS):
        new = np.maximum(0.0, y - back(forward(y) - target) / (1.02 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def _rounded(patterns, repeats: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple, int]]:
    """Whole repeats, most used patterns first, within what the histogram has left."""
    left = histogram.copy()
    plan = []
    for p in np.argsort(-repeats, kind="stable").tolist():
        if repeats[p] < 0.5:
            break
        need = defaultdict(int)
        for n in patterns[p]:
            need[n] += 1
        times = min(int(repeats[p] + 0.5), *(int(left[n]) // k for n, k in need.items()))
        if times > 0:
            plan.append((patterns[p], times))
            for n, k in need.items():
                left[n] -= k * times
    histogram[:] = left
    return plan


def _best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best fit, longest first, over a histogram: equal sequences are handled together."""
    open_: dict[int, list[list]] = defaultdict(list)  # room left -> [lengths, number of them]
    for n in np.flatnonzero(histogram)[::-1].tolist():
        count = int(histogram[n])
        for room in sorted(r for r in open_ if r >= n):
            while count and open_[room]:
                fill = room // n
                lengths, number = open_[room].pop()
                full = min(number, count // fill)
                if full:
                    open_[room - fill * n].append([lengths + (n,) * fill, full])
                    count -= full * fill
                    number -= full
                if number and count:
                    open_[room - count * n].append([lengths + (n,) * count, 1])
                    count, number = 0, number - 1
                if number:
                    open_[room].append([lengths, number])
            if not count:
                break
        fill = capacity // n
        if count // fill:
            open_[capacity - fill * n].append([(n,) * fill, count // fill])
        if count % fill:
            open_[capacity - count % fill * n].append([(n,) * (count % fill), 1])
    return [(tuple(lengths), number) for groups in open_.values() for lengths, number in groups]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """(lengths of a sequence, number of such sequences); ``histogram[n]`` counts length n."""
    left = histogram.astype(np.int64).copy()
    out = []
    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    if left.any():
        out += min(_by_patterns(left, capacity), key=lambda p: sum(times for _, times in p))
    return out


def _by_patterns(histogram: np.ndarray, capacity: int) -> Iterator[list[tuple[tuple, int]]]:
    """Plans that take all, most or half of the fitted repeats before best fit packs the rest."""
    patterns = _patterns(histogram, capacity)
    repeats = _fit(patterns, histogram.astype(float)) if patterns else np.zeros(0)
    for share in SHARES:
        left = histogram.copy()
        taken = _rounded(patterns, share * repeats, left)
        yield taken + _best_fit(left, capacity)


def _ranges(planned: list[tuple[tuple, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first and last number within the length, sequence of the first, offset)."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, times in planned:
        offset = 0
        for n in lengths:
            rows.append((n, used[n], used[n] + times - 1, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return rows


def tokens(
    docs: DataFrame, tokenizer_json: str, capacity: int, end_id: int, with_ids: bool = False
) -> DataFrame:
    """Pieces of every text: their place, length and checksum, and the ids when asked for."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text")
    ).where(F.col("doc_id").isNotNull())
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    return base.mapInArrow(_tokenised(tokenizer_json, capacity, end_id, with_ids), schema)


def _frame(spark: SparkSession, names: list[str], columns: list[np.ndarray]) -> DataFrame:
    """Numbers as a frame. From Arrow the JVM reads them itself; a list of rows would start Python
    workers of another kind beside those that run the texts."""
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names))


#: Ranges a length, on average, up to which the plan is broadcast; a larger one is joined by shuffle.
RANGES = 64


def pack(found: DataFrame, capacity: int, key: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``found`` (with ``length`` from 1 to capacity) with ``sequence_id`` and ``offset``."""
    spark = found.sparkSession
    counts = found.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # capacity rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    histogram[counts["length"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    where = _ranges(plan(histogram, capacity))
    lengths = np.flatnonzero(histogram)
    lanes = _frame(spark, ["length", "_lanes"], [lengths, histogram[lengths] // NUMBERED + 1])
    dealt = found.join(F.broadcast(lanes), "length")  # a row for each length, capacity at most
    dealt = dealt.withColumn("_lane", F.pmod(F.xxhash64(*key), F.col("_lanes")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_lane")) - F.col("n")
    bases = (
        dealt.groupBy("length", "_lane")
        .agg(F.count("*").alias("n"))
        .select("length", "_lane", before.alias("_base"))
    )
    within = Window.partitionBy("length", "_lane").orderBy(*key)
    numbered = (
        dealt.withColumn("_row", F.row_number().over(within) - 1)
        .join(bases, ["length", "_lane"])
        .withColumn("_n", F.col("_base") + F.col("_row"))
    )
    columns = np.array(where, dtype=np.int64).reshape(-1, 5).T
    ranges = _frame(spark, ["length", "_from", "_to", "_sequence", "offset"], list(columns))
    if len(where) <= capacity * RANGES:
        ranges = F.broadcast(ranges)
    return (
        numbered.join(ranges, "length")
        .where(F.col("_n").between(F.col("_from"), F.col("_to")))
        .withColumn("sequence_id", F.col("_sequence") + F.col("_n") - F.col("_from"))
        .select(*found.columns, "sequence_id", "offset")
    )


def packed(
    docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(written(tokens(docs, tokenizer_json, capacity, end_id), "pieces"), capacity)
