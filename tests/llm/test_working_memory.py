"""What a task holds beside its texts: the pipeline's executors share their memory with it."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from chronofold.llm import packing, toxicity
from chronofold.llm.files import tokenizer_bytes
from chronofold.llm.flat import _BASE, _PRIME, mix, span_hashes


def _batch(texts: int, copies: int) -> pa.RecordBatch:
    text = "You are such an idi0t, said the old loser to NOBODY in the street. " * copies
    ids = pa.array(range(texts), pa.int64())
    row = pa.StructArray.from_arrays([ids], ["doc_id"])
    return pa.RecordBatch.from_arrays([row, ids, pa.array([text] * texts)], ["row", "doc_id", "text"])


def _toxicity():
    return toxicity._features(("loser", "^stre"))


def _packing():
    return packing._tokenised(tokenizer_bytes("word_bpe_49k.json").decode(), 4096, 1, False)


@pytest.mark.parametrize("made", [_toxicity, _packing])
def test_a_batch_of_texts_takes_little_more_than_a_piece(made):
    run, batch = made(), _batch(1000, 60)  # four megabytes
    assert sum(out.num_rows for out in run(iter([_batch(1, 1)]))) == 1  # loads what is kept
    tracemalloc.start()
    try:
        assert sum(out.num_rows for out in run(iter([batch]))) == 1000
        assert tracemalloc.get_traced_memory()[1] < 45e6
    finally:
        tracemalloc.stop()


def test_hashes_are_polynomials_across_blocks():
    values = np.random.default_rng(5).integers(0, 256, 150_000, dtype=np.uint8)
    start, end = np.array([0, 65_530, 131_071, 7]), np.array([150_000, 65_545, 131_073, 7])
    expected = []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        total = 0
        for value in values[a:b][::-1].tolist():
            total = (total * _BASE + value + 1) % _PRIME
        expected.append(total)
    found = span_hashes(values, start, end, _BASE)
    assert found.tolist() == mix(np.array(expected, dtype=np.uint64)).tolist()


def test_a_plan_of_sequences_needs_no_python_workers(spark):
    found = spark.range(500).selectExpr(
        "id as doc_id", "0 as piece", "id % 40 + 1 as length"
    )
    packed = packing.pack(found, 64)
    assert packed.count() == 500
    assert "ExistingRDD" not in packed._jdf.queryExecution().executedPlan().toString()
