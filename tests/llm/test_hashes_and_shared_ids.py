"""Spans that a polynomial modulo 2^64 cannot tell apart, false hits, rows that share an id."""

import numpy as np
import pyarrow as pa
import pytest
from brute import similar as brute_similar
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronofold.llm import flat, jaccard, repeats, sentencepiece_bpe, token_counts
from chronofold.llm.files import tokenizer_bytes
from chronofold.llm.segments import SegmentCache


def _thue_morse(a, b, n=1024):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join(a if x == 0 else b for x in bits)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**61 - 2), st.integers(0, 2**61 - 2), st.integers(0, 2**64 - 1))
def test_arithmetic_is_that_of_the_prime(a, b, c):
    one = np.array([a], dtype=np.uint64), np.array([b], dtype=np.uint64)
    assert int(flat.product(*one)[0]) == a * b % (2**61 - 1)
    assert int(flat.reduced(np.array([c], dtype=np.uint64))[0]) == c % (2**61 - 1)


def test_a_long_span_is_summed_in_parts(monkeypatch):
    data = np.frombuffer(b"abcdefgh" * 50, dtype=np.uint8)
    spans = np.array([0, 8, 3, 5, 5]), np.array([300, 308, 303, 5, 400])
    whole = flat.byte_hashes(data, *spans)
    monkeypatch.setattr(flat, "_SPAN", 7)
    assert (flat.byte_hashes(data, *spans) == whole).all()
    assert whole[0] == whole[1] and len(set(whole.tolist())) == 4


def test_thue_morse_words_differ():
    one, other = _thue_morse("a", "b"), _thue_morse("b", "a")
    data = np.frombuffer((one + other).encode(), dtype=np.uint8)
    found = flat.byte_hashes(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert found[0] != found[1]


def test_coders_tell_thue_morse_words_apart(documents):
    import sentencepiece

    texts = [_thue_morse("t", "h"), _thue_morse("h", "t"), "x " + _thue_morse("h", "t")]
    model = tokenizer_bytes("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r.doc_id: r for r in sentencepiece_bpe.encoded(documents(*texts), model).collect()}
    assert [got[i].ids for i in range(3)] == [library.encode(t) for t in texts]
    vocabulary = token_counts.vocabulary_of(model)
    together = token_counts.token_counts(documents(*texts), vocabulary).collect()
    for row in together:
        alone = token_counts.token_counts(documents((row.doc_id, texts[row.doc_id])), vocabulary)
        assert alone.first().n_tokens == row.n_tokens
    apart = jaccard.similar(documents(*texts)).collect()
    assert {r.doc_id: r.component_id for r in apart} == {0: 0, 1: 1, 2: 2}


def test_a_segment_never_gets_the_ids_of_another_with_its_hash():
    def encode(segments):
        return np.concatenate([s.astype(np.int32) for s in segments]), np.array([len(s) for s in segments])

    cache = SegmentCache(encode)
    data = np.array([1, 2, 3, 4, 5, 6, 1, 2], dtype=np.uint32)
    begin, end = np.array([0, 2, 4, 6]), np.array([2, 4, 6, 8])
    for _ in range(2):  # all four have one hash: two known at once, then by what is remembered
        start, length = cache.look_up(
            np.full(4, 7, dtype=np.uint64), data, begin, end, lambda rows: [data[begin[r] : end[r]] for r in rows]
        )
        assert cache.gather(start, length).tolist() == data.tolist()


def _windows_gone(rows, width):
    """n_removed of every row: windows that start in a row with a smaller id."""
    words = [(i, (t or "").split()) for i, t in rows]
    out = []
    for i, own in words:
        gone = set()
        for at in range(len(own) - width + 1):
            window = own[at : at + width]
            if any(
                j < i and any(other[k : k + width] == window for k in range(len(other) - width + 1))
                for j, other in words
            ):
                gone.update(range(at, at + width))
        out.append((i, len(own), len(gone)))
    return sorted(out)


def test_rows_that_share_an_id_are_judged_one_by_one(documents):
    passage = [f"p{i}" for i in range(60)]
    rows = [
        (1, " ".join(passage)),
        (2, " ".join(["a", *passage, "b"])),
        (2, " ".join([f"q{i}" for i in range(120)])),
        (2, " ".join(["c", "d", *passage[:55], *[f"r{i}" for i in range(200)]])),
        (2, " ".join(["a", *passage, "b"])),
        (3, None),
        (3, ""),
    ]
    got = repeats.remove_repeats(documents(*rows), width=50).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == _windows_gone(rows, 50)


def test_bytes_that_are_no_utf8_are_read_as_replacement(spark, documents):
    documents("")
    words = " ".join(f"w{i}" for i in range(60))
    frame = spark.createDataFrame([(1, words), (2, words)], "doc_id long, text string")
    broken = F.concat(F.encode("text", "utf-8"), F.unhex(F.lit("20ff41"))).cast("string")
    frame = frame.withColumn("text", F.when(F.col("doc_id") == 2, broken).otherwise(F.col("text")))
    got = {r.doc_id: r for r in repeats.remove_repeats(frame, width=50).collect()}
    assert (got[2].n_removed, got[2].text) == (60, "�A")
    model = tokenizer_bytes("piece_bpe_32k.model")
    assert {r.doc_id: r.decoded for r in sentencepiece_bpe.encoded(frame, model).collect()}[2] == words + " �A"
    counts = token_counts.token_counts(frame, token_counts.vocabulary_of(model)).collect()
    assert len(counts) == 2


def test_stragglers_of_near_copies_link_through_their_group(documents):
    """Near copies far from the leaders link with each other; links may be in one block or two."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        copy = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 6)):
            copy[at] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    far = list(base)
    for at in range(0, 120, 12):
        far[at] = f"y{at}"
    for n in range(12):  # these link with each other, not with the others
        texts.append(" ".join([*far, *[f"z{n}{i}" for i in range(n % 4)]]))
    want = brute_similar(dict(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(documents(*texts)).collect()}
    assert got == want


def test_a_block_answers_with_a_forest():
    lists = [[1, 2, 3, 4], [1, 2, 3, 4, 5], [9, 10]]

    def table(first, parts):
        return pa.table(
            {
                "cls": pa.array(range(first, first + 3), pa.int64()),
                "part": pa.array(parts, pa.int64()),
                "tokens": pa.array(lists, pa.list_(pa.int64())),
            }
        )

    found = jaccard._open(80)(table(10, [10, 11, 12]), table(20, [20, 20, 22])).to_pydict()
    assert len(found["a"]) == 3  # {10, 11, 20, 21} and {12, 22}
    same = jaccard._open(80)(table(10, [1, 1, 2]), table(20, [1, 1, 2])).to_pydict()
    assert same["a"] == []


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b"), (None, None)]])
def test_no_usable_rows(documents, spark, rows):
    frame = documents(*rows) if rows else documents("").where("false")
    assert len(repeats.remove_repeats(frame).collect()) == sum(i is not None for i, _ in rows)
    assert len(jaccard.similar(frame).collect()) == sum(i is not None for i, _ in rows)
