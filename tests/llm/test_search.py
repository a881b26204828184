"""Ranked search against brute force; exact sums, ties and odd rows."""

import math
import random
import re

import numpy as np
import pytest

from chronofold.llm import lexical

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def brute(docs, items, top=10):
    held = [(i, _terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    count, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for name, text in items:
        found = []
        for i, t in held:
            m = 100 - 75 + (75 * len(t) * count) // length
            score = 0
            for x in _terms(text):
                tf = t.count(x)
                if tf:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda r: r[:3])
        out += [(name, k + 1, r[3], -r[0]) for k, r in enumerate(found[:top])]
    return out


@pytest.fixture
def items(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), "item_id long, text string")

    return make


def _got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_ranks_are_those_of_all_scores(documents, items):
    rng = random.Random(11)
    word = [f"w{i}" for i in range(60)] + ["été", "ÉTÉ", "naïve", "x1", "日本"]
    docs = [(i, " ".join(rng.choices(word, k=rng.randrange(1, 60)))) for i in range(300)]
    docs += [(400, docs[3][1]), (401, docs[3][1].upper()), (401, docs[3][1]), (500, None), (501, "")]
    docs += [(502, " .,;"), (503, "w1 " * 5000), (None, docs[3][1]), (None, "w1 w2"), (-7, docs[3][1])]
    asked = [(n, " ".join(rng.choices(word, k=rng.randrange(1, 12)))) for n in range(25)]
    asked += [(30, docs[3][1]), (31, None), (32, ""), (33, "unheard of"), (0, "w1 w1 w1"), (34, "W1,w2")]
    asked += [(None, "w5"), (35, "w7 " * 300)]
    got = _got(lexical.search(documents(*docs), items(*asked)))
    assert got == sorted(brute(docs, asked), key=repr)


def test_blocks_of_items_give_what_one_block_gives(documents, items, monkeypatch):
    rng = random.Random(2)
    word = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(word, k=20))) for i in range(60)]
    asked = [(n, " ".join(rng.choices(word, k=6))) for n in range(9)]
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 10)  # more than one item of most has
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    assert len(list(lexical._blocks(items(*asked)))) > 3
    got = _got(lexical.search(documents(*docs), items(*asked), top=4))
    assert got == sorted(brute(docs, asked, top=4), key=repr)


@pytest.mark.parametrize("docs,asked", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")])])
def test_nothing_to_find(spark, documents, items, docs, asked):
    frame = documents(*docs) if docs else documents("").where("false")
    asked = items(*asked) if asked else items((1, "")).where("false")
    found = lexical.search(frame, asked)
    assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.collect() == []


def test_sums_beyond_double_precision_are_exact():
    """Weights so large that a plain float64 product would round."""
    rng = np.random.default_rng(0)
    terms, items, docs = 40, 5, 7
    impact = rng.integers(0, 1_000_001, (docs, terms))
    weight = rng.integers(1, 30_000, terms)
    times = rng.integers(1, 400_000, (terms, items))
    term, item = (x.ravel() for x in np.indices((terms, items)))
    rounds = lexical._split(term, item, weight[term], times.ravel())
    assert len(rounds) > 1
    tiles = lexical._tiles(rounds, np.arange(terms), 0, items)
    for matrix in tiles:
        for lo, hi in lexical._column_cuts(matrix):
            assert (matrix[lo:hi].sum(axis=0) * lexical._IMPACT < 2**53).all()
    want = impact.astype(object) @ (weight[:, None].astype(object) * times.astype(object))
    assert lexical.scores(impact.astype(float), tiles).tolist() == want.tolist()
    assert max(want.ravel()) > 2**53


def test_best_keeps_ties_by_id_over_tiles():
    rng = np.random.default_rng(5)
    best, rows = lexical._Best(1, 10), []
    for _ in range(30):
        score = rng.integers(1, 4, 50)
        doc, lost = rng.integers(0, 10**6, 50), (rng.random(50) < 0.1).astype(np.int64)
        best.offer(0, score, lost, doc)
        rows += list(zip((-score).tolist(), lost.tolist(), doc.tolist(), strict=True))
    kept = best.rows[0]
    assert sorted(rows)[:10] == list(zip((-kept[0]).tolist(), kept[1].tolist(), kept[2].tolist(), strict=True))


def test_terms_that_share_a_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(lexical, "byte_hashes", lambda data, a, b: np.full(len(a), 7, dtype=np.uint64))
    known = lexical.Vocabulary(["ab", "cd", "abc"])
    data = np.frombuffer(b"abcdabcxx", dtype=np.uint8)
    start, end = np.array([0, 2, 4, 7]), np.array([2, 4, 7, 9])
    assert known.numbers(data, start, end).tolist() == [0, 1, 2, -1]


def test_other_columns_are_ignored(documents, items):
    frame = documents((1, "a b"), (2, "b")).withColumnRenamed("lang", "score").withColumnRenamed("source", "terms")
    asked = items((1, "b")).selectExpr("item_id", "text", "1 as doc_id", "2 as rank")
    assert _got(lexical.search(frame, asked)) == brute([(1, "a b"), (2, "b")], [(1, "b")])
