"""Documents to training sequences: the stages in order, each on all that the one before kept.

All stages but the last return the columns of ``documents``. Rows with a null id cannot be compared
or packed: the stages up to the fourth pass them on, the packing leaves them out. Rows that share an
id stay or go together. Empty documents give empty stages and no sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import jaccard, packing, pii, repeats
from chronofold.llm import toxicity as toxic
from chronofold.llm.files import tokenizer_bytes
from chronofold.llm.queries import pii_key
from chronofold.llm.ship import ship
from chronofold.llm.tables import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC_FROM = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score TOXIC_FROM or more; learnt from ``labels``."""
    ship(spark)
    model = toxic.fit(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), toxic.held_out
    )
    return model.score(docs).where(F.col("score") < TOXIC_FROM).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links at 0.8 on five-word shingles."""
    ship(spark)
    found = jaccard.similar(docs, k=5, percent=80)
    lost = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that a document with a smaller id has."""
    ship(spark)
    short = repeats.remove_repeats(docs, width=50, rejoin=False)
    short = short.select("row.*", "doc_id", "text").select(*docs.columns)
    return _counted(short.unionByName(docs.where(F.col("doc_id").isNull())))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of the same format."""
    return _counted(pii.pseudonymise(docs, pii_key(spark)).select(*docs.columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    ship(spark)
    return packing.packed(docs, tokenizer_bytes("word_bpe_49k.json").decode(), 4096, end_id=1)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("pseudonyms", pseudonyms),
    ("packing", sequences),
]

#: The first stage is a trained model, which SQL cannot express; a test holds the pipeline against
#: brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
