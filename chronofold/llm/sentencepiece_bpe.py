"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes code points with a space mark in front and for every space. It is cut wherever two
neighbouring characters stand together in no vocabulary piece, which no merge can cross, and the
distinct segments are encoded together: flat arrays of symbols, the smallest pair rank of each
segment, all of its leftmost pairs of that rank merged at once, and the arrays compacted, until no
pair is left. Where a merged piece could form an even better one (``unsafe``), only the leftmost
pair of the segment is merged, which is the library's order step by step.

Characters outside the vocabulary become byte pieces. Decoding puts the pieces' bytes in a row,
spaces for space marks, without the first of them. Null counts as empty; empty has no ids. Each row
is coded by itself and whole, however long; repeated rows and null ids too. Bytes that are not
valid UTF-8 are read as U+FFFD. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.flat import mix, pieces, ranges, span_hashes
from chronofold.llm.segments import SegmentCache, totals

_MARK = 0x2581
_NO_RANK = np.int64(1 << 40)
_SMALL = 1024


class PieceModel:
    """Vocabulary, pair ranks and cut rule of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        normal = [
            i
            for i in range(size)
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))
        ]
        text = {library.id_to_piece(i): i for i in normal}
        self.byte_id = np.array(
            [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32
        )
        by_score = sorted(normal, key=lambda i: (-library.get_score(i), i))
        rank = np.full(size, _NO_RANK)
        rank[by_score] = np.arange(len(by_score))
        self.rank = rank
        chars = sorted({c for piece in text for c in piece})
        # symbols are piece ids, then characters that are no piece themselves
        symbol = dict(text)
        for c in chars:
            symbol.setdefault(c, size + len(symbol))
        self.char_code = np.array([ord(c) for c in chars], dtype=np.int64)
        self.char_symbol = np.array([symbol[c] for c in chars], dtype=np.int64)
        self.unknown = size + len(symbol) + 1
        self.size = size
        left, right, merged = [], [], []
        for piece, number in text.items():
            for cut in range(1, len(piece)):
                a, b = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(number)
        a, b, to = (np.array(x, dtype=np.int64) for x in (left, right, merged))
        key = a * (1 << 32) + b
        order = np.argsort(key)
        self.pair_key, self.pair_to = key[order], to[order]
        better = np.zeros(self.unknown + 1, dtype=bool)
        for part in (a, b):
            is_piece = part < size
            worse = is_piece & (rank[np.minimum(part, size - 1)] > rank[to])
            better[part[worse]] = True
        self.unsafe = better
        joint = {(ord(x), ord(y)) for piece in text for x, y in zip(piece, piece[1:], strict=False)}
        self.joint = np.array(sorted(x * (1 << 21) + y for x, y in joint), dtype=np.int64)
        self.small = np.zeros((_SMALL, _SMALL), dtype=bool)
        for x, y in joint:
            if x < _SMALL and y < _SMALL:
                self.small[x, y] = True
        raw = [
            bytes([self_byte]) if (self_byte := _byte_of(library, i)) is not None
            else b"" if library.is_control(i)
            else library.id_to_piece(i).replace("▁", " ").encode()
            for i in range(size)
        ]
        self.raw_length = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def cuts(self, code: np.ndarray) -> np.ndarray:
        """Whether a segment ends before each character but the first."""
        x, y = code[:-1], code[1:]
        together = self.small[np.minimum(x, _SMALL - 1), np.minimum(y, _SMALL - 1)]
        large = np.flatnonzero((x >= _SMALL) | (y >= _SMALL))
        if len(large):
            key = x[large] * (1 << 21) + y[large]
            at = np.minimum(np.searchsorted(self.joint, key), len(self.joint) - 1)
            together[large] = self.joint[at] == key
        return ~together

    def symbols(self, code: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.char_code, code), len(self.char_code) - 1)
        return np.where(self.char_code[at] == code, self.char_symbol[at], self.unknown)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of neighbours, and the piece it makes."""
        key = a * (1 << 32) + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[at] == key
        to = np.where(hit, self.pair_to[at], 0)
        return np.where(hit, self.rank[to], _NO_RANK), to

    def merge(self, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments in a row and their numbers; ``code`` has the segments' characters."""
        count = len(length)
        owner = np.repeat(np.arange(count), length)
        symbol = self.symbols(code)
        place = np.arange(len(code))  # first character of each symbol
        done_owner, done_symbol, done_place = [], [], []
        while len(symbol) > 1:
            rank, to = self.pairs(symbol[:-1], symbol[1:])
            rank[owner[1:] != owner[:-1]] = _NO_RANK
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            least = np.minimum.reduceat(np.append(rank, _NO_RANK), first)
            open_ = np.repeat(least < _NO_RANK, np.diff(np.append(first, len(symbol))))
            best = np.repeat(least, np.diff(np.append(first, len(symbol))))
            chosen = np.flatnonzero((rank == best[:-1]) & open_[:-1])
            if not len(chosen):
                break
            # one of two that overlap: every second of a chain of neighbours, from its left end
            chain = np.concatenate([[True], np.diff(chosen) > 1])
            head = np.maximum.accumulate(np.where(chain, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - head) % 2 == 0]
            lone = self.unsafe[to[chosen]]
            if lone.any():
                again = np.concatenate([[False], owner[chosen][1:] == owner[chosen][:-1]])
                chosen = chosen[~(lone & again)]
            symbol[chosen] = to[chosen]
            keep = np.ones(len(symbol), dtype=bool)
            keep[chosen + 1] = False
            done = keep & ~open_
            done_owner.append(owner[done])
            done_symbol.append(symbol[done])
            done_place.append(place[done])
            keep &= open_
            owner, symbol, place = owner[keep], symbol[keep], place[keep]
        owner = np.concatenate([*done_owner, owner])
        symbol = np.concatenate([*done_symbol, symbol])
        place = np.concatenate([*done_place, place])
        order = np.argsort(place, kind="stable")
        return self._ids(symbol[order], owner[order], code[place[order]], count)

    def _ids(self, symbol, owner, code, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids; bytes for symbols that are no piece."""
        foreign = np.flatnonzero(symbol >= self.size)
        if not len(foreign):
            return symbol.astype(np.int32), np.bincount(owner, minlength=count)
        values, back = np.unique(code[foreign], return_inverse=True)
        encoded = [np.frombuffer(chr(v).encode(), dtype=np.uint8) for v in values]
        width = np.ones(len(symbol), dtype=np.int64)
        width[foreign] = np.array([len(e) for e in encoded])[back]
        start = np.cumsum(width) - width
        out = np.zeros(int(width.sum()), dtype=np.int32)
        plain = np.ones(len(symbol), dtype=bool)
        plain[foreign] = False
        out[start[plain]] = symbol[plain]
        table = np.concatenate(encoded)
        sizes = np.array([len(e) for e in encoded], dtype=np.int64)
        begin = np.cumsum(sizes) - sizes
        out[ranges(start[foreign], width[foreign])] = self.byte_id[
            table[ranges(begin[back], sizes[back])]
        ]
        return out, np.bincount(owner, weights=width, minlength=count).astype(np.int64)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' bytes in a row, and how many each piece has."""
        length = self.raw_length[ids]
        return self.raw[ranges(self.raw_start[ids], length)], length


def _byte_of(library, number: int) -> int | None:
    return int(library.id_to_piece(number)[3:-1], 16) if library.is_byte(number) else None


_MODELS: dict[int, PieceModel] = {}


def loaded(model: bytes) -> PieceModel:
    """The model of these bytes, built once in a process."""
    key = hash(model)
    if key not in _MODELS:
        _MODELS[key] = PieceModel(model)
    return _MODELS[key]


class Coder:
    def __init__(self, model: bytes) -> None:
        self.model = loaded(model)
        self.cache = SegmentCache(self._encode)

    def _encode(self, segments: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(s) for s in segments], dtype=np.int64)
        return self.model.merge(np.concatenate(segments).astype(np.int64), length)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the offsets of each text's ids."""
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        filled = np.diff(chars) > 0
        text = np.flatnonzero(filled)
        # one mark in front of every text that is not empty
        start = chars[:-1][text] + np.arange(len(text))
        whole = np.empty(len(code) + len(text), dtype=np.int64)
        front = np.zeros(len(whole), dtype=bool)
        front[start] = True
        whole[front] = _MARK
        whole[~front] = code
        whole[whole == 0x20] = _MARK
        if not len(whole):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        cut = np.concatenate([[True], self.model.cuts(whole)]) | front
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(whole))
        code_points = whole.astype(np.uint32)
        key = span_hashes(mix(whole.astype(np.uint64) + np.uint64(1)), begin, end, 0x9E3779B97F4A7C15)
        at, length = self.cache.look_up(
            key, code_points, begin, end, lambda rows: [whole[begin[r] : end[r]] for r in rows]
        )
        first = np.searchsorted(begin, np.append(start, len(whole)))
        own = np.zeros(len(offsets), dtype=np.int64)
        own[1:][filled] = np.diff(totals(length, first))
        return self.cache.gather(at, length), np.cumsum(own)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        raw, length = self.model.bytes_of(ids)
        ends = np.concatenate([[0], np.cumsum(length)])[offsets]
        texts = [raw[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [t[1:] if t[:1] == b" " else t for t in texts]


def _digests(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model)
        for batch, data, offsets in pieces(batches, "text"):
            ids, cuts = coder.encode(data, offsets)
            texts = coder.decode(ids, cuts)
            names = [
                hashlib.sha256(_joined(ids[a:b])).hexdigest()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(cuts)),
                    pa.array(names, pa.string()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _round_trip(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(model)
        for batch, data, offsets in pieces(batches, "text"):
            ids, cuts = coder.encode(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)),
                    pa.array([t.decode(errors="replace") for t in coder.decode(ids, cuts)]),
                ],
                ["doc_id", "ids", "decoded"],
            )

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8("text").alias("text"))


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id, ids, decoded`` of every row."""
    return _texts(docs).mapInArrow(
        _round_trip(model), "doc_id long, ids array<int>, decoded string"
    )


def digests(docs: DataFrame, model: bytes) -> DataFrame:
    """Number of ids and hashes of ids and decoded text, made in the tasks."""
    return _texts(docs).mapInArrow(
        _digests(model), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
