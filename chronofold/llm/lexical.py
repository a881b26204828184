"""Ranked lexical search by dense blocked matrix products.

Terms are the runs of letters, digits and all characters beyond ASCII, A-Z lower-cased. Items are
taken in blocks. A block's distinct terms are its compact vocabulary, numbered from 0, and its items
are a matrix of term weights times repeats. For each document the vocabulary terms that it holds
give integer impacts; a tile of documents (rows) by vocabulary terms that occur in them (columns) is
multiplied with a tile of items in float64. Every product of a tile is an integer and the columns are
cut so that no sum of theirs can reach 2^53, so the products are exact; the sums of the cuts are
added in 64-bit integers. Each tile keeps, for each item, its best scores with ties by id, and the
best of all tiles are ranked in the end.

Weights and impacts are integers: w = floor(1000 * ln((2N + 2) / (2df + 1))) and
(10^9 * tf) div (1000 * tf + 8 * m) with m = 100 - 75 + ((75 * n * N) div L).

What is shared by all tasks is one block's vocabulary and items, at most BLOCK_TERMS different terms
(one item with more is a block of its own) and BLOCK_ITEMS items; more items are more passes over the
documents' terms, never more memory. A task keeps ``top`` rows for each item of the block.

Null text, or one without terms, is no document: it counts for nothing and is never found. Rows that
share a doc_id are documents of their own; a null id is ranked after all others of its score. An item
without terms finds nothing; items that share an item_id are ranked one by one, and so are equal
ones. No documents or no items: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.flat import byte_hashes, lowered, pieces, same_spans
from chronofold.llm.tables import written

#: Different terms and items that one pass over the documents handles.
BLOCK_TERMS, BLOCK_ITEMS = 50_000, 2_000
#: Documents, vocabulary terms and items of one dense product.
TILE_DOCS, TILE_TERMS, TILE_ITEMS = 256, 4096, 256
#: Integers below it are exact in float64.
_EXACT = 1 << 53
#: No impact is larger: (10^9 * tf) div (1000 * tf + 8 * m) with m >= 0.
_IMPACT = 1_000_000

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where terms begin and end, and for text i the terms first[i] to first[i + 1]."""
    solid = _TERM[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    begins = np.flatnonzero(start)
    return begins, np.flatnonzero(end) + 1, np.searchsorted(begins, offsets)


def _strings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
    return np.frombuffer(b"".join(raw), dtype=np.uint8), offsets


class Vocabulary:
    """Terms numbered from 0; found by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]) -> None:
        self.data, offsets = _strings(terms)
        self.start, self.size = offsets[:-1], np.diff(offsets)
        keys = byte_hashes(self.data, self.start, offsets[1:])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each span, -1 for those that are no term of the vocabulary."""
        out = np.full(len(start), -1, dtype=np.int64)
        if not len(self.keys) or not len(start):
            return out
        keys, size = byte_hashes(data, start, end), end - start
        at = np.searchsorted(self.keys, keys)
        while True:  # once, unless terms share a hash
            near = np.minimum(at, len(self.keys) - 1)
            open_ = np.flatnonzero((out < 0) & (at < len(self.keys)) & (self.keys[near] == keys))
            if not len(open_):
                return out
            number = self.order[near[open_]]
            same = self.size[number] == size[open_]
            same[same] = same_spans(
                data, start[open_[same]], self.data, self.start[number[same]], size[open_[same]]
            )
            out[open_[same]] = number[same]
            at[open_] += 1


def _document_terms(vocabulary: list[str]):
    """``n`` terms of every document with any; those of the vocabulary and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(vocabulary)
        for batch, data, offsets in pieces(batches, "text"):
            data = lowered(data)
            start, end, first = _spans(data, offsets)
            counts = np.diff(first)
            number = known.numbers(data, start, end)
            owner = np.repeat(np.arange(len(counts)), counts)[number >= 0]
            key = owner * len(vocabulary) + number[number >= 0]
            key, times = np.unique(key, return_counts=True)
            per = np.bincount(key // max(len(vocabulary), 1), minlength=len(counts))
            cuts = pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32))
            terms = pa.array((key % max(len(vocabulary), 1)).astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(cuts, terms),
                    pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
                ],
                ["doc_id", "n", "terms", "times"],
            )
            yield out.filter(pa.array(counts > 0))

    return run


@dataclass
class Block:
    """Items with their terms: entry i says that item ``item[i]`` has ``term[i]`` ``times[i]`` times."""

    names: list
    vocabulary: list[str]
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


def _blocks(items: DataFrame) -> Iterator[Block]:
    """The items, in blocks of a bounded number of items and different terms."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()
    names: list = []
    vocabulary: dict[str, int] = {}
    entries: list[tuple[int, int, int]] = []

    def block() -> Block:
        item, term, times = np.array(entries, dtype=np.int64).reshape(-1, 3).T
        return Block(names, list(vocabulary), item, term, times)

    for row in rows:
        data, offsets = _strings([row["text"] or ""])
        data = lowered(data)
        start, end, _ = _spans(data, offsets)
        own: dict[str, int] = {}
        for a, b in zip(start.tolist(), end.tolist(), strict=True):
            term = data[a:b].tobytes().decode()
            own[term] = own.get(term, 0) + 1
        if not own:
            continue
        fresh = sum(t not in vocabulary for t in own)
        if names and (len(names) >= BLOCK_ITEMS or len(vocabulary) + fresh > BLOCK_TERMS):
            yield block()
            names, vocabulary, entries = [], {}, []
        for term, times in own.items():
            entries.append((len(names), vocabulary.setdefault(term, len(vocabulary)), times))
        names.append(row["item_id"])
    if names:
        yield block()


def _split(term: np.ndarray, item: np.ndarray, weight: np.ndarray, times: np.ndarray):
    """Entries whose products stay below 2^53: very frequent repeats are cut into several rounds."""
    most = np.maximum((_EXACT - 1) // (_IMPACT * np.maximum(weight, 1)), 1)
    rounds = []
    while len(times):
        now = np.minimum(times, most)
        rounds.append((term, item, weight * now))
        left = times > now
        term, item, weight, most = term[left], item[left], weight[left], most[left]
        times = (times - now)[left]
    return rounds


def _column_cuts(matrix: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows of a (terms x items) matrix whose products cannot sum to 2^53 in any column."""
    size = len(matrix)
    if (matrix.sum(axis=0) * _IMPACT < _EXACT).all():
        return [(at, min(at + TILE_TERMS, size)) for at in range(0, size, TILE_TERMS)]
    cuts, at = [], 0
    sums = np.cumsum(matrix, axis=0)
    while at < len(matrix):
        before = sums[at - 1] if at else np.zeros(matrix.shape[1])
        within = ((sums[at:] - before) * _IMPACT < _EXACT).all(axis=1)
        to = at + max(int(within.argmin()) if not within.all() else len(within), 1)
        cuts.append((at, min(to, at + TILE_TERMS)))
        at = cuts[-1][1]
    return cuts


class _Best:
    """For every item the ``top`` best scores so far, ties by id."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.rows = [np.zeros((3, 0), dtype=np.int64)] * items

    def offer(self, item: int, score: np.ndarray, lost: np.ndarray, doc: np.ndarray) -> None:
        """Scores above 0 with their ids; ``lost`` marks null ids."""
        rows = self.rows[item]
        if rows.shape[1] >= self.top:
            may = score >= rows[0, -1]
            score, lost, doc = score[may], lost[may], doc[may]
        if not len(score):
            return
        if len(score) > self.top:
            # all that reach the top-th score, so that ties are decided by id below
            may = score >= np.partition(score, -self.top)[-self.top]
            score, lost, doc = score[may], lost[may], doc[may]
        rows = np.hstack([rows, np.stack([score, lost, doc])])
        order = np.lexsort((rows[2], rows[1], -rows[0]))[: self.top]
        self.rows[item] = rows[:, order]


def scores(impact: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Integer scores of a tile: documents x terms times terms x items, exact however large."""
    total = np.zeros((impact.shape[0], weights[0].shape[1]), dtype=np.int64)
    for matrix in weights:
        for lo, hi in _column_cuts(matrix):
            total += np.rint(impact[:, lo:hi] @ matrix[lo:hi]).astype(np.int64)
    return total


def _ranked(block: Block, weight: np.ndarray, count: int, length: int, top: int):
    """The best documents of a task for every item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(block.names), top)
        rounds = _split(block.term, block.item, weight[block.term], block.times)
        for batch in batches:
            lists = batch.column("terms")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id")
            lost = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            # 75 * n * N may leave 64 bits in a very large corpus, Python's integers do not
            m = np.array([25 + 75 * x * count // length for x in n.tolist()], dtype=np.int64)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[owner])
            for at in range(0, len(sizes), TILE_DOCS):
                to = min(at + TILE_DOCS, len(sizes))
                here = slice(begin[at], begin[to])
                columns, place = np.unique(terms[here], return_inverse=True)
                if not len(columns):
                    continue
                tile = np.zeros((to - at, len(columns)))
                tile[owner[here] - at, place] = impact[here]
                for low in range(0, len(block.names), TILE_ITEMS):
                    high = min(low + TILE_ITEMS, len(block.names))
                    weights = _tiles(rounds, columns, low, high)
                    total = scores(tile, weights)
                    for item in np.flatnonzero(total.any(axis=0)):
                        found = np.flatnonzero(total[:, item] > 0)
                        best.offer(
                            low + item, total[found, item], lost[at:to][found], doc[at:to][found]
                        )
        for item, rows in enumerate(best.rows):
            if rows.shape[1]:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows.shape[1], item, dtype=np.int32)),
                        pa.array(rows[2], mask=rows[1] > 0),
                        pa.array(rows[0]),
                    ],
                    ["item", "doc_id", "score"],
                )

    return run


def _tiles(rounds, columns: np.ndarray, low: int, high: int) -> list[np.ndarray]:
    """(terms x items) weights of the chosen terms and of items low to high, one for each round."""
    out = []
    for term, item, weight in rounds:
        at = np.minimum(np.searchsorted(columns, term), len(columns) - 1)
        mine = (columns[at] == term) & (item >= low) & (item < high)
        matrix = np.zeros((len(columns), high - low))
        matrix[at[mine], item[mine] - low] = weight[mine]
        out.append(matrix)
    return out


def _weights(df: np.ndarray, count: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) of every term."""
    return np.array(
        [math.floor(1000 * math.log((2 * count + 2) / (2 * x + 1))) for x in df.tolist()],
        dtype=np.int64,
    )


def _first(best: DataFrame, top: int, *parts: str) -> DataFrame:
    """The ``top`` rows of every item (and part), with their rank."""
    order = Window.partitionBy("item", *parts).orderBy(
        F.desc("score"), F.asc_nulls_last("doc_id")
    )
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


_RANKED = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents with a score above 0."""
    spark = docs.sparkSession
    base = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    found = spark.createDataFrame([], _RANKED)
    for block in _blocks(items):
        terms = written(
            base.mapInArrow(
                _document_terms(block.vocabulary),
                "doc_id long, n long, terms array<int>, times array<int>",
            ),
            "terms",
        )
        size = terms.agg(F.count("*").alias("count"), F.sum("n").alias("length")).first()
        if not size["count"]:
            break
        held = terms.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        df = np.zeros(len(block.vocabulary), dtype=np.int64)  # a row a term of the block
        for row in held:
            df[row["term"]] = row["count"]
        weight = _weights(df, size["count"])
        best = terms.mapInArrow(
            _ranked(block, weight, size["count"], size["length"], top),
            "item int, doc_id long, score long",
        )
        best = _first(best.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))), top, "part")
        names = spark.createDataFrame(
            list(enumerate(block.names)), "item int, item_id long"
        )  # BLOCK_ITEMS rows
        ranked = (
            _first(best, top)
            .join(F.broadcast(names), "item")
            .select("item_id", "rank", "doc_id", "score")
        )
        found = found.unionAll(written(ranked, "ranked"))
    return found
