"""Substring dedup with automata over recurring passages.

Words are runs of characters other than 0x20 and 0x09 to 0x0D, kept as they stand. A window is
``width`` consecutive words of one text. A word goes when some window over it also starts in a
text with a smaller id; windows are judged on the input, not on what is left.

1. *Anchors.* Every window has one anchor: the smallest hash of its runs of ANCHOR_WORDS words.
   Equal windows have equal anchors, so a window can recur only where its anchor recurs. Anchors
   are about 2/43 of the words.
2. *Confirmation.* Windows over recurring anchors are grouped by hash; those in two texts or more
   recur, and the smallest id is their first text. In that text, runs of recurring windows are
   the passages.
3. *Automata.* A passage belongs to the shard of its anchor's first text. Each shard compiles the
   half-window blocks of its passages to one Aho-Corasick automaton over word numbers. Every text
   is streamed through the automata of the shards that its anchors name; a window over a located
   block is looked up among the shard's confirmed windows.
4. *Removal.* The windows found for a text are united and their words removed.

A shard with many passages or texts is split by both, so no task holds more than a bounded part
of a passage shared by very many texts. Null text: no words. Shorter texts than a window keep all.
Rows with a null id are left out. Rows that share an id are judged one by one and remove nothing from
each other; equal ones lose the same words. Of equal texts the one with the smallest id stays. Bytes
that are not valid UTF-8 are read as U+FFFD. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.flat import (
    Words,
    pieces,
    ranges,
    run_hashes,
    run_starts,
    same_spans,
    signed,
    word_hashes,
    words,
)
from chronofold.llm.tables import written

ANCHOR_WORDS = 8
#: Passage words and text bytes that one part of a shard takes.
SHARD_WORDS = 200_000
SHARD_BYTES = 32_000_000



def _window_anchors(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Smallest hash of ANCHOR_WORDS words inside the window at each position."""
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    runs = run_hashes(hashes, np.arange(len(hashes) - ANCHOR_WORDS + 1), ANCHOR_WORDS)
    span, have = width - ANCHOR_WORDS + 1, 1
    while have < span:
        step = min(have, span - have)
        runs = np.minimum(runs[: len(runs) - step], runs[step:])
        have += step
    return runs[at]


def _windows(batches: Iterable[pa.RecordBatch], width: int):
    """For each piece: batch, bytes, words, their hashes, window positions and window owners."""
    for batch, data, offsets in pieces(batches, "text"):
        found = words(data, offsets)
        hashes = word_hashes(data, found)
        at = run_starts(found.counts, width)
        owner = np.repeat(np.arange(batch.num_rows), np.maximum(found.counts - width + 1, 0))
        yield batch, data, found, hashes, at, owner


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def _anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, hashes, at, owner in _windows(batches, width):
            anchor = _window_anchors(hashes, at, width)
            change = np.ones(len(anchor), dtype=bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            anchor, owner = anchor[change], owner[change]
            order = np.lexsort((anchor, owner))
            anchor, owner = anchor[order], owner[order]
            keep = np.ones(len(anchor), dtype=bool)
            keep[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(_ids(batch)[owner[keep]]), pa.array(signed(anchor[keep]))],
                ["doc_id", "anchor"],
            )

    return run


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls, and how many each row has."""
    column = batch.column(name)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), sizes.astype(np.int64)


def _member(
    owner: np.ndarray, value: np.ndarray, rows: np.ndarray, known: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Whether (owner, value) is among (rows, known), and where; known is distinct in a row."""
    if not len(known):
        return np.zeros(len(value), dtype=bool), np.zeros(len(value), dtype=np.int64)
    order = np.lexsort((known, rows))
    keys = np.empty(len(known), dtype=[("r", np.int64), ("v", np.int64)])
    keys["r"], keys["v"] = rows[order], known[order]
    first = np.searchsorted(keys["r"], np.arange(owner.max(initial=-1) + 2))
    place = np.zeros(len(value), dtype=np.int64)
    low, high = first[owner], first[owner + 1]
    stop = high.copy()
    while True:  # one binary search for all at once, each in its row's part
        open_ = low < high
        if not open_.any():
            break
        middle = (low + high) // 2
        less = open_ & (keys["v"][np.minimum(middle, len(known) - 1)] < value)
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    inside = low < stop
    at = np.minimum(low, len(known) - 1)
    hit = inside & (keys["v"][at] == value)
    place[hit] = order[at[hit]]
    return hit, place


def _candidates(width: int):
    """Windows over recurring anchors: hash, text, first text of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, hashes, at, owner in _windows(batches, width):
            known, sizes = _lists(batch, "anchors")
            firsts, _ = _lists(batch, "firsts")
            anchor = signed(_window_anchors(hashes, at, width))
            hit, place = _member(owner, anchor, np.repeat(np.arange(len(sizes)), sizes), known)
            window = signed(run_hashes(hashes, at[hit], width))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(window),
                    pa.array(_ids(batch)[owner[hit]]),
                    pa.array(firsts[place[hit]]),
                ],
                ["win", "doc_id", "home"],
            )

    return run


def _passages(width: int):
    """Runs of a text's recurring windows with one home, as word sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, found, hashes, at, owner in _windows(batches, width):
            known, sizes = _lists(batch, "wins")
            homes, _ = _lists(batch, "homes")
            window = signed(run_hashes(hashes, at, width))
            hit, place = _member(owner, window, np.repeat(np.arange(len(sizes)), sizes), known)
            at, owner, home = at[hit], owner[hit], homes[place[hit]]
            if not len(at):
                continue
            new = np.ones(len(at), dtype=bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (home[1:] != home[:-1]) | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(at)) - 1
            text = [
                data[found.start[a] : found.end[b]].tobytes().decode()
                for a, b in zip(at[begin], at[last] + width - 1, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(home[begin]),
                    pa.array(_ids(batch)[owner[begin]]),
                    pa.array(text, pa.string()),
                    pa.array((last - begin + width).astype(np.int64)),
                ],
                ["home", "doc_id", "text", "n_words"],
            )

    return run


class _Shard:
    """Automaton over the blocks of a shard's passages, and its confirmed windows."""

    def __init__(self, width: int) -> None:
        self.width, self.block = width, width // 2
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, batch: pa.RecordBatch) -> None:
        for part, data, offsets in pieces([batch], "text"):
            found = words(data, offsets)
            ids = _ids(part)
            self.parts.append((word_hashes(data, found), found.counts, ids))

    def compile(self) -> None:
        import ahocorasick

        hashes = np.concatenate([p[0] for p in self.parts])
        counts = np.concatenate([p[1] for p in self.parts])
        ids = np.concatenate([p[2] for p in self.parts])
        self.vocabulary = np.unique(hashes)
        at = run_starts(counts, self.width)
        window = run_hashes(hashes, at, self.width)
        first = np.repeat(ids, np.maximum(counts - self.width + 1, 0))
        order = np.lexsort((first, window))
        window, first = window[order], first[order]
        keep = np.ones(len(window), dtype=bool)
        keep[1:] = window[1:] != window[:-1]
        self.window, self.first = window[keep], first[keep]
        self.hashes, self.place = hashes, at[order][keep]
        begins = np.cumsum(counts) - counts
        blocks = counts // self.block
        start = np.repeat(begins, blocks) + self.block * ranges(np.zeros_like(blocks), blocks)
        _, distinct = np.unique(run_hashes(hashes, start, self.block), return_index=True)
        numbers = np.searchsorted(self.vocabulary, hashes) + 1
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for s in start[distinct]:
            automaton.add_word(tuple(numbers[s : s + self.block].tolist()))
        automaton.make_automaton()
        self.automaton = automaton
        self.parts = []

    def scan(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Starts of windows that a text with a smaller id has too."""
        for part, data, offsets in pieces([batch], "text"):
            found = words(data, offsets)
            hashes = word_hashes(data, found)
            place = np.minimum(
                np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1
            )
            numbers = np.where(self.vocabulary[place] == hashes, place + 1, 0)
            ids, rows, which, starts = _ids(part), [], [], []
            marks = part.column("mark").to_numpy(zero_copy_only=False)
            for i in range(part.num_rows):
                lo, hi = int(found.first[i]), int(found.first[i + 1])
                if hi - lo < self.width:
                    continue
                own = numbers[lo:hi]
                ends = np.fromiter(
                    (end for end, _ in self.automaton.iter(tuple(own.tolist()))), np.int64
                )
                if not len(ends):
                    continue
                mark = np.zeros(hi - lo + 1, dtype=np.int64)
                # a window over the block that ends here starts at end-width+1 .. end-block+1
                np.add.at(mark, np.maximum(ends - self.width + 1, 0), 1)
                np.add.at(mark, ends - self.block + 2, -1)
                window = np.flatnonzero(np.cumsum(mark)[: hi - lo - self.width + 1] > 0)
                value = run_hashes(hashes[lo:hi], window, self.width)
                spot = np.minimum(np.searchsorted(self.window, value), len(self.window) - 1)
                hit = (self.window[spot] == value) & (self.first[spot] < ids[i])
                hit[hit] = self._same(hashes, lo + window[hit], spot[hit])
                if hit.any():
                    rows.append(ids[i])
                    which.append(marks[i])
                    starts.append(window[hit])
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, pa.int64()),
                        pa.array(which, pa.int64()),
                        pa.array(starts, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "mark", "starts"],
                )

    def _same(self, hashes: np.ndarray, at: np.ndarray, spot: np.ndarray) -> np.ndarray:
        """Whether windows agree word by word with the confirmed ones of the same hash."""
        width = np.full(len(at), self.width)
        return same_spans(hashes, at, self.hashes, self.place[spot], width)


def _locate(width: int):
    """Rows come by shard, its passages before its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, ready = None, _Shard(width), False
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in _KEY + ("kind",)]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                here = tuple(int(c[lo]) for c in columns[:-1])
                if here != key:
                    key, shard, ready = here, _Shard(width), False
                part = batch.slice(lo, hi - lo)
                if columns[-1][lo] == 0:
                    shard.add(part)
                elif shard.parts or ready:
                    if not ready:
                        shard.compile()
                        ready = True
                    yield from shard.scan(part)

    return run


_KEY = ("shard", "by_passage", "by_text")


def _mark() -> Column:
    """Tells texts that share an id apart."""
    return F.xxhash64("text").alias("mark")


def _below(count: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)


def _routed(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages and texts of every shard part, sorted so that each part's passages come first."""
    spark = texts.sparkSession
    total = passages.agg(F.sum("n_words")).first()[0] or 0
    shards = 1 + int(total) // SHARD_WORDS
    shard = F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int").alias("shard")
    own = passages.select(shard, "doc_id", "text", "n_words")
    went = (
        texts.select("doc_id", F.length("text").alias("size"), F.explode("firsts").alias("home"))
        .select("doc_id", "size", shard)
        .distinct()
    )
    loads = (
        own.groupBy("shard")
        .agg(F.sum("n_words").alias("w"))
        .join(went.groupBy("shard").agg(F.sum("size").alias("b")), "shard")
        .select(
            "shard",
            F.ceil(F.col("w") / SHARD_WORDS / 4).cast("long").alias("ways"),
            F.ceil(F.col("b") / SHARD_BYTES).cast("long").alias("lanes"),
        )
    )
    loads = written(loads, "loads")  # one row for each shard
    salt = F.pmod(F.xxhash64("doc_id", "text"), F.col("ways"))
    own = (
        own.join(loads, "shard")
        .withColumn("by_passage", salt)
        .withColumn("by_text", F.explode(_below("lanes")))
        .select(*_KEY, F.lit(0).alias("kind"), "doc_id", _mark(), "text")
    )
    targets = (
        went.join(loads, "shard")
        .withColumn("by_text", F.pmod(F.xxhash64("doc_id"), F.col("lanes")))
        .withColumn("by_passage", F.explode(_below("ways")))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct(*_KEY)).alias("to"))  # once, also for texts that share an id
    )
    theirs = (
        texts.select("doc_id", "text")
        .join(targets, "doc_id")
        .select("doc_id", "text", F.explode("to").alias("to"))
        .select(*[F.col(f"to.{k}") for k in _KEY], F.lit(1).alias("kind"), "doc_id", _mark(), "text")
    )
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        own.unionByName(theirs)
        .repartition(max(count, shards), *_KEY)
        .sortWithinPartitions(*_KEY, "kind")
        .select(*_KEY, "kind", "doc_id", "mark", "text")
    )


def _removed(width: int, rejoin: bool):
    """Texts without the words of the windows named in ``starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            found = words(data, offsets)
            kept, gone = [], []
            lists, before = batch.column("starts"), batch.column("text")
            for i in range(batch.num_rows):
                lo, hi = int(found.first[i]), int(found.first[i + 1])
                drop = np.zeros(hi - lo + 1, dtype=np.int64)
                if lists[i].is_valid:
                    for part in lists[i].values:
                        at = part.values.to_numpy()
                        np.add.at(drop, at, 1)
                        np.add.at(drop, at + width, -1)
                gone_here = np.cumsum(drop)[: hi - lo] > 0
                gone.append(int(gone_here.sum()))
                if gone[-1] or rejoin:
                    kept.append(_joined(data, found, lo + np.flatnonzero(~gone_here)))
                else:
                    kept.append(before[i].as_py())
            columns = {
                "row": batch.column("row"),
                "doc_id": batch.column("doc_id"),
                "text": pa.array(kept, pa.string()),
                "n_words": pa.array(found.counts.astype(np.int64)),
                "n_removed": pa.array(gone, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _joined(data: np.ndarray, found: Words, which: np.ndarray) -> str:
    """The words joined by one space."""
    if not len(which):
        return ""
    length = found.end[which] - found.start[which] + 1
    source = ranges(found.start[which], length)
    out = data[np.minimum(source, len(data) - 1)]
    out[np.cumsum(length) - 1] = 0x20
    return out[:-1].tobytes().decode()


def remove_repeats(docs: DataFrame, width: int = 50, rejoin: bool = True) -> DataFrame:
    """Per text: ``row`` (its other columns as a struct), ``doc_id, text, n_words, n_removed``.

    The text is its kept words joined by one space; without ``rejoin`` a text that loses no word
    stays as it was.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.where(F.col("doc_id").isNotNull()).select(
        F.struct(F.lit(0).alias("_"), *rest).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.make_valid_utf8("text").alias("text"),
    )
    base = whole.select("doc_id", "text")
    anchors = written(
        base.mapInArrow(_anchors(width), "doc_id long, anchor long"), "anchors"
    )
    recurring = (
        anchors.groupBy("anchor")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where(F.col("first") < F.col("last"))
        .select("anchor", "first")
    )
    recurring = written(recurring, "recurring")
    lists = (
        anchors.join(recurring, "anchor")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("anchor", "first")).alias("own"))
        .select("doc_id", F.col("own.anchor").alias("anchors"), F.col("own.first").alias("firsts"))
    )
    texts = written(base.join(lists, "doc_id"), "candidates")
    confirmed = (
        texts.mapInArrow(_candidates(width), "win long, doc_id long, home long")
        .groupBy("win")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.max("doc_id").alias("last"),
            F.min("home").alias("home"),
        )
        .where(F.col("doc_id") < F.col("last"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("win", "home")).alias("own"))
        .select("doc_id", F.col("own.win").alias("wins"), F.col("own.home").alias("homes"))
    )
    passages = written(
        texts.select("doc_id", "text")
        .join(confirmed, "doc_id")
        .mapInArrow(_passages(width), "home long, doc_id long, text string, n_words long"),
        "passages",
    )
    located = _routed(texts, passages).mapInArrow(
        _locate(width), "doc_id long, mark long, starts array<long>"
    )
    spans = located.groupBy("doc_id", "mark").agg(F.collect_list("starts").alias("starts"))
    schema = T.StructType(
        [
            whole.schema["row"],
            *[whole.schema[c] for c in ("doc_id", "text")],
            *[T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")],
        ]
    )
    joined = whole.withColumn("mark", _mark()).join(
        written(spans, "spans"), ["doc_id", "mark"], "left"
    )
    return joined.mapInArrow(_removed(width, rejoin), schema)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
