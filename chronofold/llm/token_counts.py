"""Token counts of a unigram tokenizer without its tokens.

The tokenizer is a vocabulary of pieces with scores (here that of a public model file): spaces
become marks, one mark stands in front, every mark begins a word, and a word's tokens are the pieces
with the largest sum of scores. An Aho-Corasick automaton lists all pieces in all distinct words of
a batch at once. Dynamic programming then walks over end positions, for all words together, and
carries the best score and its number of pieces only.

The rules of the tokenizer hold exactly: scores add up in double precision from the left, of equal
sums the piece that begins first wins, a character that is no piece by itself may stand as unknown
for the least score less 10, and neighbouring unknowns are one token.

Null text counts as empty: no tokens. Each row is counted by itself, repeated rows and null ids too.
A very long word is counted whole, one step a character. Bytes that are not valid UTF-8 are read as
U+FFFD. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.flat import mix, pieces, span_hashes
from chronofold.llm.segments import SegmentCache, totals

_MARK = 0x2581
_BETWEEN = "\U0010ffff"  # in no piece
_UNKNOWN_PENALTY = 10.0
_BASE = 0x9E3779B97F4A7C15

Vocabulary = list[tuple[str, float]]


def vocabulary_of(model: bytes) -> Vocabulary:
    """The unknown piece and the plain pieces of a SentencePiece model, with their scores."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = [
        i
        for i in range(library.get_piece_size())
        if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))
    ]
    return [("<unk>", 0.0)] + [(library.id_to_piece(i), library.get_score(i)) for i in plain]


class UnigramCounter:
    """Counts of pieces; entry 0 of the vocabulary is the unknown piece."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, (piece, _) in enumerate(vocabulary):
            self.automaton.add_word(piece, number)
        self.automaton.make_automaton()
        self.score = np.array([s for _, s in vocabulary], dtype=np.float64)
        self.length = np.array([len(p) for p, _ in vocabulary], dtype=np.int64)
        self.unknown_score = float(self.score.min()) - _UNKNOWN_PENALTY
        self.cache = SegmentCache(self._encode)

    def _encode(self, segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count_words(segments)
        return counts.astype(np.int32), np.ones(len(counts), dtype=np.int64)

    def count_words(self, segments: list[np.ndarray]) -> np.ndarray:
        """Number of tokens of every word, given as code points."""
        size = np.array([len(s) for s in segments], dtype=np.int64)
        # position 0 of a word is where its first character begins; words are one apart
        begin = np.cumsum(size + 1) - (size + 1)
        text = _BETWEEN.join(
            s.astype("<u4").tobytes().decode("utf-32-le", errors="surrogatepass") for s in segments
        )
        pairs = np.array(list(self.automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        end, number = pairs[:, 0] + 1, pairs[:, 1]
        start, score = end - self.length[number], self.score[number]
        total = len(text) + 1
        single = np.zeros(total, dtype=bool)
        single[start[end - start == 1]] = True
        inside = np.ones(total, dtype=bool)
        inside[begin + size] = False  # the end of a word begins no character
        alone = np.flatnonzero(inside & ~single)
        start = np.concatenate([start, alone])
        end = np.concatenate([end, alone + 1])
        score = np.concatenate([score, np.full(len(alone), self.unknown_score)])
        unknown = np.concatenate([number == 0, np.ones(len(alone), dtype=bool)])

        offset = np.arange(total) - np.repeat(begin, size + 1)
        order = np.lexsort((start, end, offset[end]))
        start, end, score, unknown = start[order], end[order], score[order], unknown[order]
        best = np.zeros(total)
        count = np.zeros(total, dtype=np.int64)
        last = np.zeros(total, dtype=bool)
        levels = np.searchsorted(offset[end], np.arange(1, int(size.max(initial=0)) + 2))
        for lo, hi in zip(levels[:-1].tolist(), levels[1:].tolist(), strict=True):
            if lo == hi:
                continue
            at, to = start[lo:hi], end[lo:hi]
            sums = best[at] + score[lo:hi]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            group = np.cumsum(np.concatenate([[True], to[1:] != to[:-1]])) - 1
            top = np.maximum.reduceat(sums, first)
            winner = np.flatnonzero(sums == top[group])
            winner = winner[np.concatenate([[True], group[winner][1:] != group[winner][:-1]])]
            to, at = to[winner], at[winner]
            lone = unknown[lo:hi][winner]
            best[to] = top
            count[to] = count[at] + 1 - (lone & last[at])
            last[to] = lone
        return count[begin + size]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of every text."""
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        code = np.where(code == 0x20, _MARK, code).astype(np.int64)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        filled = np.diff(chars) > 0
        text = np.flatnonzero(filled)
        if not len(text):
            return np.zeros(len(filled), dtype=np.int64)
        bare = code[chars[:-1][text]] != _MARK  # a text that begins with a mark gets no other
        at = chars[:-1][text][bare]
        whole = np.insert(code, at, _MARK)
        start = chars[:-1][text] + np.cumsum(bare) - bare
        begin = np.flatnonzero(whole == _MARK)
        end = np.append(begin[1:], len(whole))
        code_points = whole.astype(np.uint32)
        key = span_hashes(mix(whole.astype(np.uint64) + np.uint64(1)), begin, end, _BASE)
        place, _ = self.cache.look_up(
            key, code_points, begin, end, lambda rows: [whole[begin[r] : end[r]] for r in rows]
        )
        first = np.searchsorted(begin, np.append(start, len(whole)))
        out = np.zeros(len(filled), dtype=np.int64)
        out[filled] = np.diff(totals(self.cache.ids[place], first))
        return out


_COUNTERS: dict[int, UnigramCounter] = {}


def _counted(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(vocabulary))
        if key not in _COUNTERS:
            _COUNTERS[key] = UnigramCounter(vocabulary)
        counter = _COUNTERS[key]
        for batch, data, offsets in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets)),
                    pa.array(counter.count(data, offsets)),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text"))
    return base.mapInArrow(_counted(vocabulary), "doc_id long, n_bytes long, n_tokens long")
