"""Tokenizer work done once for each distinct piece of text that tokenises by itself.

Both coders here cut texts at places no token can span, encode each distinct segment once, and
put a text's ids together by gathering. Segments are told apart by a 64-bit hash and their length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from chronofold.llm.flat import ranges, same_spans

#: Distinct segments that a task remembers; beyond, it starts over.
REMEMBERED = 3_000_000
#: Elements of remembered segments that a task holds; beyond, it starts over.
STORED = 60_000_000


class SegmentCache:
    """Ids of segments by hash, filled by ``encode(list of segments) -> (flat ids, lengths)``."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)  # ascending
        self.start = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.begin = np.zeros(0, dtype=np.int64)  # where each known segment lies in the store
        self.size = np.zeros(0, dtype=np.int64)
        self.store, self.stored = np.zeros(0, dtype=np.uint8), 0

    def _keep(self, part: np.ndarray) -> None:
        need = self.stored + len(part)
        if need > len(self.store) or self.store.dtype != part.dtype:
            grown = np.zeros(max(need, 2 * len(self.store)), dtype=part.dtype)
            grown[: self.stored] = self.store[: self.stored]
            self.store = grown
        self.store[self.stored : need] = part
        self.stored = need

    def _encoded(self, segments: list) -> tuple[np.ndarray, np.ndarray]:
        ids, length = self.encode(segments)
        start = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        return start, length

    def look_up(
        self,
        keys: np.ndarray,
        data: np.ndarray,
        begin: np.ndarray,
        end: np.ndarray,
        segment: Callable[[np.ndarray], list],
    ) -> tuple[np.ndarray, np.ndarray]:
        """Start and length in ``ids`` of every segment data[begin:end], whose hashes are ``keys``;
        ``segment(rows)`` gives what ``encode`` takes."""
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > REMEMBERED or self.stored > STORED:
            self.forget()
        known = np.zeros(len(distinct), dtype=bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            known = self.keys[at] == distinct
        if not known.all():
            fresh = first[~known]
            start, length = self._encoded(segment(fresh))
            size = end[fresh] - begin[fresh]
            where = np.searchsorted(self.keys, distinct[~known])
            self.keys = np.insert(self.keys, where, distinct[~known])
            self.start = np.insert(self.start, where, start)
            self.length = np.insert(self.length, where, length)
            self.begin = np.insert(self.begin, where, self.stored + np.cumsum(size) - size)
            self.size = np.insert(self.size, where, size)
            self._keep(data[ranges(begin[fresh], size)])
        at = np.searchsorted(self.keys, distinct)[back]
        start, length = self.start[at], self.length[at]
        same = self.size[at] == end - begin
        same[same] = same_spans(
            data, begin[same], self.store, self.begin[at[same]], self.size[at[same]]
        )
        if not same.all():  # another segment has this hash: encoded by itself, not remembered
            other = np.flatnonzero(~same)
            start[other], length[other] = self._encoded(segment(other))
        return start, length

    def gather(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.ids[ranges(start, length)]


def totals(length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Offsets of each text's ids, given its segments first[i] to first[i + 1]."""
    sums = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    return sums[first]
