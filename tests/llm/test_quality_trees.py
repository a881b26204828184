"""Boosted trees: histograms and traversal against plain loops, held-out labels, odd rows."""

import numpy as np
import pytest

from chronofold.llm import quality_trees
from chronofold.llm.tables import table


def _slow_scores(trees, rows):
    out = []
    for row in rows:
        total = trees.start
        for node in trees.root.tolist():
            while trees.left[node] != node:
                node = trees.left[node] + int(row[trees.feature[node]] > trees.threshold[node])
            total += trees.value[node]
        out.append(1 / (1 + np.exp(-total)))
    return np.array(out)


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    rows = np.column_stack([rng.random((1500, 3)), rng.integers(0, 3, 1500), np.zeros(1500)])
    label = ((rows[:, 0] > 0.6) ^ (rows[:, 3] == 1)).astype(float)
    return rows, label


def test_flat_arrays_give_what_walking_each_tree_gives(sample):
    rows, label = sample
    trees = quality_trees.train(rows, label, np.arange(1500) % 5 == 0)
    scores = trees.scores(rows)
    assert np.allclose(scores, _slow_scores(trees, rows))
    assert ((scores > 0.5) == (label > 0)).mean() > 0.98


def test_first_split_is_the_best_of_all_splits(sample):
    rows, label = sample
    edges = [quality_trees._edges(rows[:, f]) for f in range(5)]
    assert len(edges[4]) == 0 and len(edges[3]) == 2 and len(edges[0]) < quality_trees.BINS
    binned = np.column_stack([np.searchsorted(e, rows[:, f]) for f, e in enumerate(edges)])
    share = label.mean()
    gradient, curvature = share - label, np.full(1500, share * (1 - share))
    nodes, leaf = quality_trees._grow(binned, gradient, curvature, edges)

    def worth(mask):
        return gradient[mask].sum() ** 2 / (curvature[mask].sum() + quality_trees.PENALTY)

    every = {(f, e): worth(rows[:, f] <= e) + worth(rows[:, f] > e) for f in range(5) for e in edges[f]}
    assert every[nodes[0][0], nodes[0][1]] == pytest.approx(max(every.values()))
    for number in np.unique(leaf):
        mine = leaf == number
        want = -quality_trees.STEP * gradient[mine].sum() / (curvature[mine].sum() + quality_trees.PENALTY)
        assert nodes[number][3] == pytest.approx(want)


def _slow(text):
    def low(word):
        return "".join(c.lower() if c.isascii() else c for c in word)

    words = text.split()
    lines = [x for x in text.split("\n") if x.split()]
    return {
        "log_words": np.log1p(len(words)),
        "bars": text.count("|") / max(len(words), 1),
        "repeated_at_once": sum(low(a) == low(b) for a, b in zip(words, words[1:])) / max(len(words), 1),
        "distinct_words": len({low(w) for w in words}) / max(len(words), 1),
        "commonest_word": max((sum(low(x) == low(w) for x in words) for w in words), default=0) / max(len(words), 1),
        "words_a_line": len(words) / max(len(lines), 1),
        "repeated_lines": (len(lines) - len({low(x).strip() for x in lines})) / max(len(lines), 1),
        "capitals": sum("A" <= c <= "Z" for c in text)
        / max(sum(len(c.encode()) for c in text if c.isascii() and c.isalpha() or not c.isascii()), 1),
        "word_length": sum(len(c.encode()) for c in text if c.isascii() and c.isalpha() or not c.isascii()) / max(len(words), 1),
    }


def test_statistics_against_plain_python():
    texts = ["", "Ab ab AB cd", "one\n\ntwo | three\nONE\nlast line.", "\n\n", "é é É x", "a " * 300, "NO!! no!! yes", "\nstart\n"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    rows = quality_trees.statistics(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    assert rows.shape == (len(texts), len(quality_trees.STATISTICS)) and np.isfinite(rows).all()
    for text, row in zip(texts, rows, strict=True):
        for name, value in _slow(text).items():
            assert row[quality_trees.STATISTICS.index(name)] == pytest.approx(value), (text, name)
    alone = [
        quality_trees.statistics(np.frombuffer(r, dtype=np.uint8), np.array([0, len(r)]))[0] for r in raw
    ]
    assert np.allclose(rows, alone)  # a text's statistics do not depend on its neighbours


def test_held_out_labels_are_met(spark, documents):
    documents("")
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality_trees.fit(docs, labels, quality_trees.held_out)
    scored = model.score(docs).selectExpr("row.doc_id as doc_id", "score")
    rows = scored.join(labels, "doc_id").where(quality_trees.held_out(scored.doc_id)).collect()
    right = [(r.score >= 0.3) == (r.quality == 1) for r in rows]
    assert len(rows) > 50 and sum(right) / len(right) >= 0.95


def test_odd_rows_and_missing_labels(spark, documents):
    names = "doc_id long, quality int, toxic int"
    good, bad = "Some plain text that reads on. And more of it.", "bad bad bad bad ### bad | bad |"
    rows = [(i, (good if i % 2 else bad) + f" w{i}") for i in range(100)]
    frame = documents(*rows, (None, good + " w5"), (200, None), (201, ""), (201, bad), (202, "x" * 300_000))
    frame = frame.withColumnRenamed("lang", "score").withColumnRenamed("source", "label")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(200, None, 0), (None, 1, 0), (1, 0, 1)], names)
    model = quality_trees.fit(frame, labels)
    got = model.score(frame).select("row.doc_id", "row.score", "score").collect()
    assert len(got) == 105 and all(0 <= r[2] <= 1 for r in got) and {r[1] for r in got} == {"en"}
    by_id = {r[0]: r[2] for r in got}
    assert by_id[None] > 0.5 > by_id[0]
    for some, rate in (("quality = 1", 1.0), ("false", 0.0)):
        flat = quality_trees.fit(frame, labels.where(some))
        assert {r.score for r in flat.score(frame).select("score").collect()} == {rate}
    assert model.score(frame.where("false")).collect() == []
