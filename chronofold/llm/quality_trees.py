"""Quality of documents by histogram gradient-boosted trees over statistics of the whole text.

Statistics are rates that do not depend on the language: symbols, capitals, exclamation marks, words
that repeat at once or all over, repeated five-word runs and lines, the share of the commonest word,
word and line lengths. Values are put into at most BINS bins by quantiles of the training rows. Each
round sums gradients and curvatures of the logistic loss in a histogram for each (node, feature, bin)
and splits every node of a level at the bin with the largest gain; a part of the training rows chosen
by hash decides how many rounds are kept. The trees are flattened to arrays (feature, threshold, left
child, value), and a batch of texts walks all trees at once, level by level, in numpy.

At most ``sample`` labelled rows are learnt from, those with the smallest hash of their id; they are
fitted in one task. Scoring has no bound. Labels that are null are not used; several labels of one id
count as the largest. Without training rows of both labels there is nothing to learn: every score is
the share of label 1 among them (0 without any).

Null text counts as empty; a text without words has statistics of zero and is scored like any other.
Each row is scored by itself: repeated rows get equal scores, a null id is scored too and counts as held
out. Very long texts are scored whole. No documents: no rows. Columns named like anything here pass
through in ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.llm.flat import byte_hashes, lowered, mix, pieces, run_hashes, run_starts, words
from chronofold.llm.tables import written

SAMPLE = 20_000
BINS, DEPTH, ROUNDS, STEP = 64, 4, 200, 0.1
#: Least curvature in a child, weight of the penalty on leaf values, rounds without progress at the end.
LEAST, PENALTY, PATIENCE = 3.0, 1.0, 20

STATISTICS = (
    "log_words word_length long_words capitals capital_words exclamations questions symbols bars "
    "digits punctuation brackets beyond_ascii repeated_at_once distinct_words commonest_word "
    "repeated_runs words_a_line repeated_lines line_ends words_with_symbols sentence_length"
).split()


def _marks(characters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(characters))


_UPPER = _marks(bytes(range(65, 91)))
_LETTER = _UPPER | _marks(bytes(range(97, 123))) | (np.arange(256) >= 0x80)
_DIGIT = _marks(bytes(range(48, 58)))
_SYMBOL = _marks(b"#*$%&|<>@^~_=+\\/")
_PUNCTUATION = _marks(b".,;:!?\"'()-")
_BRACKET = _marks(b"{}[]<>")
_END = _marks(b".!?\"':;")


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 0 by 5."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(rest == 0, F.lit(True))


def _again(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every (owner, value): how often it occurs, and whether it repeats another one."""
    key = mix(value ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[order][1:] == key[order][:-1]
    group = np.cumsum(~same) - 1
    count, later = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=bool)
    count[order] = np.bincount(group, minlength=1)[group] if len(key) else 0
    later[order] = same
    return count, later


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for every text."""
    found = words(data, offsets)
    start, end, first = found.start, found.end, found.first
    texts, owner = len(offsets) - 1, found.owner()

    def sums(flag: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(flag), cuts)).astype(float)

    n = np.maximum(found.counts, 1).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    letters = np.maximum(sums(_LETTER[data], offsets), 1.0)
    folded = lowered(data)
    hashes = byte_hashes(folded, start, end)
    at_once = np.zeros(len(start), dtype=bool)
    at_once[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    count, later = _again(owner, hashes)
    commonest = np.zeros(texts)
    spoken = np.flatnonzero(found.counts)
    if len(spoken):
        commonest[spoken] = np.maximum.reduceat(count, first[spoken])
    runs = run_starts(found.counts, 5)
    run_owner = np.repeat(np.arange(texts), np.maximum(found.counts - 4, 0))
    _, run_later = _again(run_owner, run_hashes(hashes, runs, 5))

    line_end = np.zeros(len(data) + 1, dtype=bool)
    line_end[np.flatnonzero(data == 0x0A)] = True
    line_end[offsets[1:]] = True
    line_stop = np.flatnonzero(line_end)
    # lines are compared from their first word to their last one
    line_start = np.concatenate([[0], line_stop[:-1]]).astype(np.int64)
    first_word, past_word = np.searchsorted(start, line_start), np.searchsorted(start, line_stop)
    filled = past_word > first_word
    line_start, line_stop = start[first_word[filled]], end[past_word[filled] - 1]
    line_owner = owner[first_word[filled]]
    lines = np.maximum(np.bincount(line_owner, minlength=texts), 1).astype(float)
    _, line_later = _again(line_owner, byte_hashes(folded, line_start, line_stop))
    closed = _END[data[line_stop - 1]]

    def inside(flag: np.ndarray) -> np.ndarray:
        """How many bytes of each word are marked."""
        at = np.flatnonzero(flag)
        return np.searchsorted(at, end) - np.searchsorted(at, start)

    capital = inside(_UPPER[data])
    shouted = (capital > 1) & (5 * capital >= 3 * inside(_LETTER[data]))
    sentence = np.isin(data, list(b".!?"))
    columns = [
        np.log1p(found.counts.astype(float)),
        sums(_LETTER[data], offsets) / n,
        sums(end - start > 24, first) / n,
        sums(_UPPER[data], offsets) / letters,
        sums(shouted, first) / n,
        sums(data == 0x21, offsets) / n,
        sums(data == 0x3F, offsets) / n,
        sums(_SYMBOL[data], offsets) / size,
        sums(data == 0x7C, offsets) / n,
        sums(_DIGIT[data], offsets) / size,
        sums(_PUNCTUATION[data], offsets) / size,
        sums(_BRACKET[data], offsets) / size,
        sums(data >= 0x80, offsets) / size,
        sums(at_once, first) / n,
        sums(~later, first) / n,
        commonest / n,
        np.bincount(run_owner[run_later], minlength=texts) / n,
        found.counts / lines,
        np.bincount(line_owner[line_later], minlength=texts) / lines,
        np.bincount(line_owner[closed], minlength=texts) / lines,
        sums(inside(_SYMBOL[data]) > 0, first) / n,
        n / np.maximum(sums(sentence, offsets), 1.0),
    ]
    return np.column_stack(columns)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in pieces(batches, "text"):
        flat = statistics(data, offsets)
        cuts = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)
        values = pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), values], ["doc_id", "label", "values"]
        )


@dataclass
class Trees:
    """Boosted trees as arrays; a leaf is its own left child and has no larger value to go right."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def raw(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        for lo in range(0, len(rows), 4096):
            part = rows[lo : lo + 4096]
            node = np.tile(self.root, (len(part), 1))
            line = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                right = part[line, self.feature[node]] > self.threshold[node]
                node = self.left[node] + right
            out[lo : lo + 4096] += self.value[node].sum(axis=1)
        return out

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(rows)))


def _edges(values: np.ndarray) -> np.ndarray:
    """Upper ends of the bins but the last, between different values."""
    distinct = np.unique(values)
    if len(distinct) > BINS:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:], method="lower"))
    return distinct[:-1]


def _grow(
    binned: np.ndarray, gradient: np.ndarray, curvature: np.ndarray, edges: list[np.ndarray]
) -> tuple[list, np.ndarray]:
    """One tree as nodes (feature, threshold, left child, value), and the leaf of every row."""
    features = binned.shape[1]
    nodes: list[list] = [[0, np.inf, 0, 0.0]]
    node_of = np.zeros(len(binned), dtype=np.int64)
    level = [0]
    for depth in range(DEPTH + 1):
        slot = np.full(len(nodes), -1)
        slot[level] = np.arange(len(level))
        here = slot[node_of]
        live = here >= 0
        keys = (here[live, None] * features + np.arange(features)) * BINS + binned[live]
        shape = (len(level), features, BINS)
        g, h = (
            np.bincount(keys.ravel(), np.repeat(x[live], features), np.prod(shape)).reshape(shape)
            for x in (gradient, curvature)
        )
        total_g, total_h = g[:, :1].sum(axis=2), h[:, :1].sum(axis=2)
        for i, number in enumerate(level):
            nodes[number][2] = number
            nodes[number][3] = -STEP * total_g[i, 0] / (total_h[i, 0] + PENALTY)
        if depth == DEPTH:
            break
        left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
        right_g, right_h = total_g[..., None] - left_g, total_h[..., None] - left_h
        gain = (
            left_g**2 / (left_h + PENALTY)
            + right_g**2 / (right_h + PENALTY)
            - (total_g**2 / (total_h + PENALTY))[..., None]
        )
        gain[(left_h < LEAST) | (right_h < LEAST)] = -np.inf
        best = gain.reshape(len(level), -1).argmax(axis=1)
        following = []
        for i, number in enumerate(level):
            feature, cut = divmod(int(best[i]), BINS)
            if gain[i, feature, cut] <= 1e-6 or cut >= len(edges[feature]):
                continue
            nodes[number][:3] = [feature, edges[feature][cut], len(nodes)]
            rows = node_of == number
            node_of[rows] = len(nodes) + (binned[rows, feature] > cut)
            following += [len(nodes), len(nodes) + 1]
            nodes += [[0, np.inf, 0, 0.0], [0, np.inf, 0, 0.0]]
        if not following:
            break
        level = following
    return nodes, node_of


def train(rows: np.ndarray, label: np.ndarray, judge: np.ndarray) -> Trees:
    """Trees fitted to the rows but those of ``judge``, which choose the number of rounds."""
    edges = [_edges(rows[~judge, f]) for f in range(rows.shape[1])]
    binned = np.column_stack([np.searchsorted(e, rows[:, f]) for f, e in enumerate(edges)])
    fit = ~judge
    share = np.clip(label[fit].mean(), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    raw = np.full(len(rows), start)
    trees, losses = [], []
    for _ in range(ROUNDS):
        chance = 1.0 / (1.0 + np.exp(-raw))
        nodes, leaf = _grow(
            binned[fit], (chance - label)[fit], (chance * (1 - chance))[fit], edges
        )
        trees.append(nodes)
        single = _flat([nodes], start=0.0)
        raw += single.raw(rows)
        seen = judge if judge.any() else fit
        losses.append(np.logaddexp(0, np.where(label[seen] > 0, -raw[seen], raw[seen])).mean())
        if len(losses) - int(np.argmin(losses)) > PATIENCE:
            break
    return _flat(trees[: int(np.argmin(losses)) + 1], start)


def _flat(trees: list[list], start: float) -> Trees:
    sizes = np.array([len(t) for t in trees])
    root = np.cumsum(sizes) - sizes
    every = [n for t in trees for n in t]
    feature, threshold, left, value = zip(*every, strict=True)
    return Trees(
        root,
        np.array(feature, dtype=np.int64),
        np.array(threshold, dtype=float),
        np.array(left, dtype=np.int64) + np.repeat(root, sizes),
        np.array(value, dtype=float),
        DEPTH,
        start,
    )


def _train_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the flattened trees, or none when a label is missing."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    label = table.column("label").to_numpy().astype(float)
    values = table.column("values").combine_chunks()
    rows = values.flatten().to_numpy(zero_copy_only=False).reshape(len(label), -1)
    judge = table.column("judge").to_numpy().astype(bool)
    if len(np.unique(label[~judge])) < 2:
        judge[:] = False
    if len(np.unique(label)) < 2:
        return
    trees = train(rows, label, judge)
    arrays = (trees.root, trees.feature, trees.threshold, trees.left, trees.value)
    yield pa.RecordBatch.from_arrays(
        [pa.array([a.tolist()]) for a in arrays] + [pa.array([trees.start])],
        ["root", "feature", "threshold", "left", "value", "start"],
    )


_TREES = (
    "root array<long>, feature array<long>, threshold array<double>, left array<long>, "
    "value array<double>, start double"
)


def _scored(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            score = trees.scores(statistics(data, offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(score)], ["row", "score"]
            )

    return run


@dataclass
class Model:
    trees: Trees | None
    base_rate: float

    def score(self, docs: DataFrame) -> DataFrame:
        """``row``, the input row as a struct, and its ``score``."""
        base = docs.select(F.struct("*").alias("row"), "text")
        if self.trees is None:
            return base.select("row", F.lit(self.base_rate).alias("score"))
        schema = T.StructType([base.schema["row"], T.StructField("score", T.DoubleType())])
        return base.mapInArrow(_scored(self.trees), schema)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Callable[[Column], Column] | None = None,
    sample: int = SAMPLE,
) -> Model:
    """Learn from at most ``sample`` labelled rows that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("label")
    )
    if held_out is not None:
        known = known.where(~held_out(F.col("doc_id")))
    order = F.xxhash64("doc_id")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.orderBy(order, "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learnt = texts.join(F.broadcast(known), "doc_id")  # ``sample`` ids at most
    # texts that share an id are one training row, the first by its hash
    learnt = learnt.groupBy("doc_id", "label").agg(
        F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text")
    )
    found = written(
        learnt.mapInArrow(_described, "doc_id long, label int, values array<double>"), "statistics"
    )
    rate = float(found.agg(F.avg("label")).first()[0] or 0.0)
    judge = (F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(5)) == 0).alias("judge")
    fitted = (
        found.select("doc_id", "label", "values", judge)
        .repartition(1)  # ``sample`` rows of numbers at most
        .sortWithinPartitions("doc_id")
        .mapInArrow(_train_in_task, _TREES)
        .collect()  # the trees
    )
    if not fitted:
        return Model(None, rate)
    row = fitted[0]
    arrays = [np.array(row[c]) for c in ("root", "feature", "threshold", "left", "value")]
    return Model(Trees(*arrays, DEPTH, row["start"]), rate)
