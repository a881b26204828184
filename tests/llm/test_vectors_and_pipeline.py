"""Near-duplicate vectors, the pipeline and the registered queries."""

import re

import numpy as np
import pytest
from brute import Union
from brute import repeats as brute_repeats
from brute import similar as brute_similar
from pyspark.sql import types as T

import corpus_pipeline
from chronofold.llm import near_vectors, pii, queries, toxicity

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    rows = [base[i % 60] + rng.standard_normal(64) * 0.08 * (i % 4) for i in range(300)]
    rows += [rows[0]] * 5 + [rows[7] * 3.0, np.ones(64) * 1e20, np.ones(64) * 1e-20]
    out = [(i, r.astype(np.float32).tolist(), i % 2) for i, r in enumerate(rows)]
    n = len(out)
    out += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 64, 1), (n + 3, rows[1].tolist(), None)]
    out += [(n + 4, [float("nan")] + [1.0] * 63, 0), (n + 5, [None] + [1.0] * 63, 0)]
    out += [(n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.001], 0), (n + 8, [1.0, -2.0], 0)]
    return out


def expected(rows):
    good = {}
    for i, v, label in rows:
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, dtype=np.float32).astype(np.float64)
        good[i] = (label, x / np.linalg.norm(x))
    union, links = Union([r[0] for r in rows]), dict.fromkeys([r[0] for r in rows], 0)
    for i, (a, x) in good.items():
        for j, (b, y) in good.items():
            if i != j and a == b and len(x) == len(y) and float(x @ y) >= 0.98:
                links[i] += 1
                union.join(i, j)
    return {i: (links[i], union.find(i)) for i in links}


@pytest.mark.parametrize("small", [False, True])
def test_vectors_against_all_pairs(spark, vectors, monkeypatch, small):
    if small:  # buckets in blocks and lanes of their own
        monkeypatch.setattr(near_vectors, "BLOCK", 3)
        monkeypatch.setattr(near_vectors, "LANE", 4)
        monkeypatch.setattr(near_vectors, "SHARED", 2)
    queries.ship(spark)
    frame = spark.createDataFrame(vectors, VECTORS).selectExpr("*", "1 unit", "2 code", "3 bucket")
    got = {r.vec_id: r for r in near_vectors.near_duplicates(frame).collect()}
    want = expected(vectors)
    assert len(got) == len(vectors)
    found = sum(r.n_links for r in got.values())
    total = sum(n for n, _ in want.values())
    assert 0.9 * total <= found <= total
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    same = sum(got[i].component_id == root for i, (_, root) in want.items())
    assert same >= 0.97 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert near_vectors.near_duplicates(frame.limit(0)).count() == 0


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    """Labels of another type; three vectors of id 1, two of them near, and a copy."""
    queries.ship(spark)
    near, far = [1.0, 0.0, 0.01], [0.0, 1.0, 0.0]
    rows = [(1, [1.0, 0.0, 0.0], "x"), (1, near, "x"), (1, far, "x"), (2, far, "x"), (3, far, "y"), (4, near, None), (1, None, "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors.near_duplicates(frame).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    large = spark.createDataFrame([(1, near, 5 * 10**9), (2, near, 5 * 10**9)], "vec_id long, embedding array<float>, label long")
    assert sorted(r.component_id for r in near_vectors.near_duplicates(large).collect()) == [1, 1]


def test_pipeline_matches_its_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    queries.ship(spark)
    model = toxicity.fit(docs, labels, toxicity.held_out)
    scores = {r.doc_id: r.score for r in model.score(docs).select("row.doc_id", "score").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if scores[r.doc_id] < 0.7}
    groups = brute_similar(texts, k=5, percent=80)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    removed = brute_repeats(texts)
    rows = {}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        step = stage(spark, step, sf_dir)
        assert step.columns == docs.columns
        rows[name] = {r.doc_id: r.text for r in step.collect()}
    assert rows["near_duplicates"] == texts
    before, after = rows["near_duplicates"], rows["substring_dedup"]
    assert {i: after[i] == before[i] for i in before} == {i: removed[i][1] == 0 for i in before}
    clean = rows["pseudonyms"]
    for i, text in after.items():
        if not re.search(r"[0-9@]", text):
            assert clean[i] == text
    frame = spark.createDataFrame(list(after.items()), "doc_id long, text string")
    assert clean == {r.doc_id: r.text for r in pii.pseudonymise(frame, queries.pii_key(spark)).collect()}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == set(clean)
    ends = {}
    for r in packed:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert max(ends.values()) <= 4096 and sum(ends.values()) == sum(r.length for r in packed)


def test_stages_take_odd_rows(spark, documents, sf_dir):
    odd = documents((None, "a b c"), (1, None), (2, ""), (2, ""), (3, "x " * 20_000), (4, "a b"), (5, "a b"))
    odd = odd.selectExpr("*", "1 row", "2 score")
    empty = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, empty, sf_dir).count() == 0
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns
        kept = sorted(str(r.doc_id) for r in out.collect())
        assert kept[:3] == ["1", "2", "2"] and "None" in kept
    last = corpus_pipeline.STAGES[4][1]
    assert last(spark, empty, sf_dir).count() == 0
    assert {r.doc_id for r in last(spark, odd, sf_dir).collect()} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("texts", [["", None, ""], [" ", "\n\t", None], ["", "a", " "]])
def test_tables_without_words(spark, documents, texts, tmp_path):
    """Every operator on texts of nothing or hardly anything."""
    documents(*texts).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    turns = spark.createDataFrame([(n, 0, "user", t) for n, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    items = spark.createDataFrame([(0, "a"), (1, None), (2, "")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = {"op11_search": sum(t == "a" for t in texts)}
    for name, run in queries.queries().items():
        if name == "op12_prefix_trie":
            assert run(spark, str(tmp_path)).where("depth = 0 and n_convs = 3").count() == 1
        elif name != "op8_near_vectors":
            assert run(spark, str(tmp_path)).count() == counts.get(name, 3)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 2


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_registered_queries_run(spark, sf_dir, name):
    frame = queries.queries()[name](spark, sf_dir)
    if name in ("op4_packing", "op11_search", "op12_prefix_trie"):  # rows of pieces, ranks and nodes
        assert frame.count() > 0
    else:
        assert frame.count() == {"op8_near_vectors": 500}.get(name, 200)
