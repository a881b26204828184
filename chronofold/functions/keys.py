"""Keys derived from business values.

A rerun of a job, or of a task whose executor was lost, gives the same key again; a random
key would not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GUID_LENGTH = 26


#: Keys tried for one set of values in a round; names that find none free go to another round.
GENERATIONS = 64


def _digest(*parts: Column, generation: Column | None = None) -> Column:
    """Each part comes after its length and a missing one is a dash, so no two lists of parts
    read alike. Later generations are other keys for the same parts."""
    texts = []
    for part in parts:
        text = part.cast("string")
        said = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        texts.append(F.coalesce(said, F.lit("-")))
    whole = F.concat_ws("|", *texts)
    if generation is not None:
        tail = F.concat(F.lit("#"), generation.cast("string"))
        whole = F.concat(whole, F.when(generation > 0, tail).otherwise(F.lit("")))
    return F.md5(whole)


def stable_guid(*parts: Column, generation: Column | None = None) -> Column:
    """A 26-character text key."""
    return F.upper(F.substring(_digest(*parts, generation=generation), 1, GUID_LENGTH))


def stable_id(*parts: Column, generation: Column | None = None) -> Column:
    """A 60-bit number key."""
    text = F.substring(_digest(*parts, generation=generation), 1, 15)
    return F.conv(text, 16, 10).cast("long")


def with_free_keys(rows: DataFrame, names: Sequence[str], taken: DataFrame, key: str) -> DataFrame:
    """``rows`` (distinct in ``names``) with ``key`` and ``guid`` that ``taken`` does not hold.

    A name that was given up by a rename has left its first key with the renamed row; the next
    generation that is free is used then. A rerun on the same dimension gives the same keys.
    """
    parts = [F.col(name) for name in names]
    first = rows.select(*names, F.lit(0).alias("_g"))
    held = taken.select(key)

    def clashing(asked: DataFrame) -> DataFrame:
        """Rows of (names, _g) whose key of that generation is held."""
        keyed = asked.withColumn(key, stable_id(*parts, generation=F.col("_g")))
        return keyed.join(held, key, "left_semi").select(*names, "_g")

    def tried(asked: DataFrame) -> DataFrame:
        """The next GENERATIONS generations after each row's."""
        after = F.sequence(F.col("_g") + 1, F.col("_g") + GENERATIONS)
        return asked.withColumn("_g", F.explode(after))

    candidates, waiting = first, clashing(first)
    while True:
        later = tried(waiting)
        candidates = candidates.unionByName(later)
        # every generation of the round is held: the name's last one says where to go on
        full = clashing(later).groupBy(*names).agg(
            F.count("*").alias("_n"), F.max("_g").alias("_g")
        )
        waiting = full.where(F.col("_n") == GENERATIONS).select(*names, "_g")
        if waiting.isEmpty():
            break
    free = candidates.withColumn(key, stable_id(*parts, generation=F.col("_g"))).join(
        held, key, "left_anti"
    )
    chosen = free.groupBy(*names).agg(F.min("_g").alias("_g"))
    generation = F.col("_g")
    return chosen.select(
        stable_id(*parts, generation=generation).alias(key),
        *names,
        stable_guid(*parts, generation=generation).alias("guid"),
    )
