"""Token ids of whole texts by the tokenizers library, each distinct run of characters once.

The tokenizer drops white space and splits words into runs of letters, single digits and runs of
other characters, so these runs are tokenised by themselves. Words of ASCII and the Latin letters
of U+00C0 to U+00FF are cut into lower-cased runs here; words with an apostrophe (contractions), an
angle bracket (special tokens) or any other character go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from chronofold.llm.flat import byte_hashes, is_space, ranges, words
from chronofold.llm.segments import SegmentCache, totals

_LETTER, _DIGIT, _OTHER, _LEAD, _WHOLE = 1, 2, 3, 4, 5
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[0x27, 0x3C]] = _WHOLE
_KIND[:0x20] = _WHOLE
_KIND[0x7F:] = _WHOLE
_KIND[[*range(0x09, 0x0E)]] = _OTHER  # between words
_KIND[0xC3] = _LEAD
_SPACE = is_space()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _cut(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, starts and ends of the segments, and each text's first segment."""
    found = words(data, offsets)
    if not len(found.start):
        none = np.zeros(0, dtype=np.int64)
        return data, none, none, np.zeros(len(offsets), dtype=np.int64)
    kind = _KIND[data]
    lower = _LOWER[data]
    lead = np.flatnonzero(kind == _LEAD)
    lead = lead[lead + 1 < len(data)]
    second = data[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)
    kind[lead[letter]] = _LETTER
    kind[lead[letter] + 1] = _LETTER
    capital = lead[letter & (second <= 0x9E)] + 1
    lower[capital] += 0x20
    # a lead byte whose second byte is no letter stays _LEAD, which makes its word whole
    odd = np.flatnonzero(kind >= _LEAD)
    whole = np.unique(np.searchsorted(found.start, odd, side="right") - 1)
    change = np.zeros(len(data) + 1, dtype=bool)
    change[1:-1] = kind[1:] != kind[:-1]
    digit = np.flatnonzero(kind == _DIGIT)
    change[digit] = True
    change[found.start] = True
    if len(whole):
        a, b = found.start[whole], found.end[whole]
        body = ranges(a, b - a)
        lower[body] = data[body]
        change[body] = False
        change[a] = True
    blank = np.flatnonzero(_SPACE[data])
    change[blank] = False
    begin = np.flatnonzero(change[:-1])
    # a segment ends where the next begins in its word, or with its word
    end = np.append(begin[1:], len(data))
    last = np.flatnonzero(np.append(np.diff(np.searchsorted(found.start, begin, side="right")), 1))
    end[last] = found.end[: len(last)]
    return lower, begin, end, np.searchsorted(begin, offsets)


class WordCoder:
    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task its core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.cache = SegmentCache(self._encode)

    def _encode(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch(segments, add_special_tokens=False)]
        length = np.array([len(i) for i in ids], dtype=np.int64)
        flat = np.fromiter((x for i in ids for x in i), dtype=np.int32, count=int(length.sum()))
        return flat, length

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the offsets of each text's ids."""
        lower, begin, end, first = _cut(data, offsets)
        raw = lower.tobytes()
        keys = byte_hashes(lower, begin, end)
        start, length = self.cache.look_up(
            keys, lower, begin, end, lambda rows: [raw[begin[r] : end[r]].decode() for r in rows]
        )
        return self.cache.gather(start, length), totals(length, first)


_CODERS: dict[int, WordCoder] = {}


def word_coder(tokenizer_json: str) -> WordCoder:
    """The coder of this tokenizer, kept with its cache for the process's next tasks."""
    key = hash(tokenizer_json)
    if key not in _CODERS:
        _CODERS[key] = WordCoder(tokenizer_json)
    return _CODERS[key]
