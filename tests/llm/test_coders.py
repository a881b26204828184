"""Tokenizer operators against the libraries they stand for."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from chronofold.llm import packing, sentencepiece_bpe, token_counts
from chronofold.llm.files import tokenizer_bytes


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    odd = [None, "", " ", "  a  b ", "It's don't x'sand !!'s", "ÀÉÎ×÷ß ÿŸ ΣΣ. straße", "a\u0000b\n\n\tc"]
    odd += ["<|endoftext|>a <|startoftext|> <unk><s></s> <0x0A>", "▁x ▁▁ ▁", "日本語テキスト", "😀😀 x😀"]
    odd += ["é àb ́", "a" * 500, "internationalization" * 60, "abc123def4.5,6", " x\x85y"]
    alphabet = "abcdeÀéñ' .12\n<|>,!×▁"
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(150))) for _ in range(200)]
    wide = [*range(32, 127), *range(0xA0, 0x250), *range(0x3040, 0x30FF), *range(0x300, 0x320)]
    odd += ["".join(chr(rng.choice(wide)) for _ in range(120)) for _ in range(60)]
    odd += [" ".join(rng.choice(["the", "Going", "ther", "tion,"]) for _ in range(9000)), odd[20]]
    return odd


def test_sentencepiece_ids_and_decoding(documents, texts):
    model = tokenizer_bytes("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r.doc_id: r for r in sentencepiece_bpe.encoded(documents(*texts), model).collect()}
    short = {r.doc_id: r for r in sentencepiece_bpe.digests(documents(*texts), model).collect()}
    for number, text in enumerate(texts):
        ids = library.encode(text or "")
        assert list(got[number].ids) == ids
        assert got[number].decoded == library.decode(ids)
        assert short[number].n_tokens == len(ids)
        joined = ",".join(map(str, ids)).encode()
        assert short[number].ids_sha256 == hashlib.sha256(joined).hexdigest()
        decoded = library.decode(ids).encode()
        assert short[number].decoded_sha256 == hashlib.sha256(decoded).hexdigest()


def test_unigram_counts(documents, texts):
    vocabulary = token_counts.vocabulary_of(tokenizer_bytes("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram(vocabulary, 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(
        replacement="▁", prepend_scheme="always", split=True
    )
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(*texts), vocabulary).collect()}
    assert got == {i: len(library.encode(t or "").ids) for i, t in enumerate(texts)}


def test_unigram_ties_and_unknowns(documents):
    vocabulary = [("<unk>", 0.0), ("▁", -1.5), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("▁a", -2.5)]
    library = Tokenizer(models.Unigram(vocabulary, 0, False))
    library.pre_tokenizer = pre_tokenizers.Metaspace(
        replacement="▁", prepend_scheme="always", split=True
    )
    texts = ["ab", "aba", "abab bab", "axxb", "xx", "aaa bbb ccc abcab", "a" * 99]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(*texts), vocabulary).collect()}
    assert got == {i: len(library.encode(t).ids) for i, t in enumerate(texts)}


def test_packing_is_whole_and_gapless(documents, texts):
    tokenizer = tokenizer_bytes("word_bpe_49k.json").decode()
    library = Tokenizer.from_str(tokenizer)
    capacity = 256
    rows = packing.packed(documents(*texts), tokenizer, capacity).collect()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    seen = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == capacity * r.piece and len(part) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes())
        seen.setdefault(r.doc_id, []).append(r.length)
    assert {i: sum(x) for i, x in seen.items()} == {i: len(x) for i, x in ids.items()}
    placed = {}
    for r in rows:
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    histogram = np.bincount([r.length for r in rows], minlength=capacity + 1)
    best_fit = sum(t for _, t in packing._best_fit(histogram, capacity))
    assert len(placed) <= best_fit + 1


@pytest.mark.parametrize("seed", range(4))
def test_plans_cover_any_histogram(seed):
    rng = np.random.default_rng(seed)
    capacity = 512
    lengths = {
        0: rng.integers(1, 513, 20_000),
        1: np.minimum(512, rng.lognormal(4, 1, 50_000).astype(int) + 1),
        2: np.array([512, 1]),
        3: np.full(30_001, 300),
    }[seed]
    histogram = np.bincount(lengths, minlength=capacity + 1)
    plan = packing.plan(histogram, capacity)
    used = np.zeros_like(histogram)
    for parts, times in plan:
        assert sum(parts) <= capacity and times > 0
        for n in parts:
            used[n] += times
    assert (used == histogram).all()
    best_fit = sum(t for _, t in packing._best_fit(histogram.copy(), capacity))
    assert sum(t for _, t in plan) <= 1.01 * best_fit + 1


def test_hot_length_is_numbered_in_lanes(spark, documents, monkeypatch):
    monkeypatch.setattr(packing, "NUMBERED", 7)
    pieces = spark.range(200).selectExpr("id doc_id", "0 piece", "if(id % 3 = 0, 5, 3) length")
    rows = packing.pack(pieces.withColumn("length", pieces.length.cast("long")), 8).collect()
    assert len(rows) == 200
    assert len({(r.sequence_id, r.offset) for r in rows}) == 200
    assert {r.offset + r.length for r in rows} <= {3, 5, 6, 8}


def test_no_documents(documents, texts):
    empty = documents(*texts).limit(0)
    tokenizer = tokenizer_bytes("word_bpe_49k.json").decode()
    model = tokenizer_bytes("piece_bpe_32k.model")
    assert packing.packed(empty, tokenizer).count() == 0
    assert sentencepiece_bpe.digests(empty, model).count() == 0
    assert token_counts.token_counts(empty, [("<unk>", 0.0)]).count() == 0
