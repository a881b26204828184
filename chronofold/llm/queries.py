"""One registered query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import (
    jaccard,
    lexical,
    licences,
    near_vectors,
    packing,
    pii,
    prefix_trie,
    quality,
    quality_trees,
    repeats,
    sentencepiece_bpe,
    token_counts,
    toxicity,
    twins,
)
from chronofold.llm.files import tokenizer_bytes
from chronofold.llm.ship import ship
from chronofold.llm.tables import table

Runner = Callable[[SparkSession, str], DataFrame]


#: Tests and checks run with this key; a real job names its own in ``chronofold.pii.key``.
_PII_KEY = "not-a-secret"


def pii_key(spark: SparkSession) -> str:
    """The session's key. Without one, pseudonyms are made for tests only, and a warning says so."""
    key = spark.conf.get("chronofold.pii.key", None)
    if key is None:
        warnings.warn(
            "chronofold.pii.key is not set: these pseudonyms are for tests, anyone can reverse them",
            stacklevel=2,
        )
    return key or _PII_KEY


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii_key(spark))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.families(licences.scan(docs, licences.fit(docs)))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents"), width=50))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokenizer_bytes("word_bpe_49k.json").decode()
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer, capacity=4096, end_id=1)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_bytes("piece_bpe_32k.model")
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents"), model)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, held_out=toxicity.held_out)
    return model.score(docs.select("doc_id", "text")).select(
        "row.doc_id",
        toxicity.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"), k=4, percent=85)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.vocabulary_of(tokenizer_bytes("piece_bpe_32k.model"))
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "host_rejected",
    )


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), family=20, heads=4)


def op13_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_trees.fit(docs, labels, held_out=quality_trees.held_out)
    return model.score(docs.select("doc_id", "text")).select(
        "row.doc_id",
        quality_trees.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


_RUNNERS: dict[str, Runner] = {
    "op1_pii": op1_pii,
    "op2_licences": op2_licences,
    "op3_repeats": op3_repeats,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard": op6_jaccard,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_near_vectors": op8_near_vectors,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_search": op11_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality_trees": op13_quality_trees,
}

#: What DuckDB can run over the whole tables; the others are tested against brute force.
_TWINS: dict[str, str] = {
    "op3_repeats": twins.REPEATS,
    "op6_jaccard": twins.JACCARD,
    "op10_quality": twins.QUALITY,
    "op11_search": twins.SEARCH,
    "op12_prefix_trie": twins.PREFIX_TRIE,
}


def _shipped(run: Runner) -> Runner:
    def start(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return start


def queries() -> dict[str, Runner]:
    return {name: _shipped(run) for name, run in _RUNNERS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_TWINS)
