"""Texts as flat numpy arrays: words, lines and their 64-bit hashes without a Python object each.

A batch of texts is one UTF-8 buffer and its offsets. A word is a maximal run of bytes other than
0x20 and 0x09 to 0x0D, which is the same as a run of such characters. Every span gets a hash from
prefix sums of a polynomial modulo the prime 2^61 - 1, followed by a mixing step. Two different
spans of n elements agree for at most n of the 2^61 bases, whatever they hold; where a false match
would change an exact result, the spans themselves are compared as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are worked through in pieces of about so many bytes; a longer text is a piece of its own.
PIECE_BYTES = 1_000_000
#: The same for work that takes sixty bytes and more for a byte of text at a time.
SMALL_PIECE_BYTES = 250_000

_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all (finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PRIME = (1 << 61) - 1
_P = np.uint64(_PRIME)
_U = [np.uint64(i) for i in range(65)]
_LOW29, _LOW30 = np.uint64((1 << 29) - 1), np.uint64((1 << 30) - 1)
_LOW31, _LOW32 = np.uint64((1 << 31) - 1), np.uint64((1 << 32) - 1)
#: Sums of a byte value and half a power stay below 2^64 for spans up to this length.
_SPAN = 1 << 22
#: Elements whose terms are held at once, besides the prefix sums.
_BLOCK = 1 << 16


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo 2^61 - 1."""
    x = (x & _P) + (x >> _U[61])
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, for numbers below it."""
    a_high, a_low = a >> _U[31], a & _LOW31
    b_high, b_low = b >> _U[31], b & _LOW31
    middle = a_low * b_high + a_high * b_low
    return reduced(
        ((a_high * b_high) << _U[1])
        + (middle >> _U[30])
        + ((middle & _LOW30) << _U[31])
        + a_low * b_low
    )


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def is_space() -> np.ndarray:
    """For each byte, whether it separates words."""
    return _SPACE.copy()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_row(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = product(out[:more], np.uint64(step))
        have, step = have + more, step * step % _PRIME
    return out


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^61 - 1 for i < n; kept for the next piece unless very long."""
    if base in _POWERS and len(_POWERS[base][0]) >= n:
        return _POWERS[base]
    size = 1 << max(16, (n - 1).bit_length())
    base_ = base % _PRIME
    pair = (_power_row(base_, size), _power_row(pow(base_, -1, _PRIME), size))
    if size <= 4 * PIECE_BYTES:
        _POWERS[base] = pair
    return pair


def span_hasher(
    values: np.ndarray, base: int
) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What gives the hashes of values[start:end] for every span; values are bytes or unsigned
    64-bit numbers. The prefix sums are made once, block by block, for any number of calls."""
    forward, back = _powers(base, len(values) + 1)
    small = values.dtype.itemsize == 1
    lows = np.zeros(len(values) + 1, dtype=np.uint64)
    highs = np.zeros(len(values) + 1, dtype=np.uint64)
    for at in range(0, len(values), _BLOCK):
        part, power = values[at : at + _BLOCK], forward[at : min(at + _BLOCK, len(values))]
        if small:
            part = part.astype(np.uint64) + _U[1]  # a span's length shows in its sum
            terms = part * (power & _LOW32), part * (power >> _U[32])
        else:
            part = product(reduced(part), power)
            terms = part & _LOW32, part >> _U[32]
        for term, total in zip(terms, (lows, highs), strict=True):
            term[0] += total[at]  # may wrap round; differences are right all the same
            np.cumsum(term, out=total[at + 1 : at + 1 + len(term)])

    def sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        upper = reduced(highs[b] - highs[a])
        # 2^32 * upper, as 2^61 is 1
        folded = (upper >> _U[29]) + ((upper & _LOW29) << _U[32])
        return reduced(folded + reduced(lows[b] - lows[a]))

    def hashes(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if small and len(start) and int((end - start).max()) > _SPAN:
            total, at = np.zeros(len(start), dtype=np.uint64), start
            while (at < end).any():
                to = np.minimum(at + _SPAN, end)
                total, at = reduced(total + sums(at, to)), to
        else:
            total = sums(start, end)
        return mix(product(total, back[start]))

    return hashes


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for every span; values are bytes or unsigned 64-bit numbers."""
    return span_hasher(values, base)(start, end)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte by byte."""
    return _LOWER[data]


@dataclass
class Words:
    """Words of several texts: byte spans, and for text i the words first[i] to first[i + 1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    begins = np.flatnonzero(start)
    return Words(begins, np.flatnonzero(end) + 1, np.searchsorted(begins, offsets))


def word_hashes(data: np.ndarray, found: Words) -> np.ndarray:
    return span_hashes(data, found.start, found.end, _BASE)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(data, start, end, _BASE)


def byte_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``byte_hashes`` for several sets of spans of the same bytes."""
    return span_hasher(data, _BASE)


def run_starts(counts: np.ndarray, k: int) -> np.ndarray:
    """Positions where a run of k words begins inside its text, given the words of each text."""
    runs = np.maximum(counts - k + 1, 0)
    total = int(runs.sum())
    first = np.cumsum(counts) - counts
    return np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(total)


def run_hashes(hashes: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each start on."""
    return span_hashes(hashes, start, start + k, _WORD_BASE)


def sequence_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each text's whole word sequence."""
    return span_hashes(hashes, first[:-1], first[1:], _WORD_BASE)


def same_spans(
    a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray
) -> np.ndarray:
    """Whether a[a_start : a_start + length] equals b[b_start : b_start + length], for every span."""
    same = np.ones(len(length), dtype=bool)
    filled = np.flatnonzero(length > 0)
    if len(filled):
        size = length[filled]
        equal = a[ranges(a_start[filled], size)] == b[ranges(b_start[filled], size)]
        same[filled] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return same


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(
    batches: Iterable[pa.RecordBatch], text: str, size: int = PIECE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``size`` bytes of text each, their bytes and offsets."""
    for batch in batches:
        data, offsets = buffer_of(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield (
                batch.slice(at, to - at),
                data[offsets[at] : offsets[to]],
                offsets[at : to + 1] - offsets[at],
            )
            at = to


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for every range, one after the other."""
    length = length.astype(np.int64)
    before = np.cumsum(length) - length
    return np.repeat(start.astype(np.int64) - before, length) + np.arange(int(length.sum()))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
