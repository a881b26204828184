"""Connected components of a link table, with joins and groupings only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.tables import written


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def components(edges: DataFrame, purpose: str = "links") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: the smallest node that links lead to.

    Rounds of large-star and small-star: each node hands its neighbours to the smallest of them,
    until every node hangs from its root. A round's links are never more than the round before
    had, and the minimum per node is combined before the shuffle, so a node with very many links
    costs no more than its links. Null ends and links to oneself are left out.
    """
    links = (
        edges.select(*_ordered(F.col("a"), F.col("b"))).where(F.col("a") > F.col("b")).distinct()
    )
    links = written(links, purpose)
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.where(F.col("b") > F.col("a"))
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .select(F.explode(F.array("a", "b")).alias("a"), "m")
            .where(F.col("a") > F.col("m"))
            .select("a", F.col("m").alias("b"))
            .distinct()
        )
        after = written(small, purpose)
        if _same(links, after):
            break
        links = after
    roots = after.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _same(before: DataFrame, after: DataFrame) -> bool:
    """Whether both hold the same links: their number and a sum of hashes are equal."""

    def digest(links: DataFrame) -> tuple:
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        return tuple(links.agg(F.count("*"), total).first())

    return digest(before) == digest(after)
