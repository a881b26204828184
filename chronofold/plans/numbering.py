"""Row numbers without bringing all rows, or all rows of a large key, to one task.

Rows are range-partitioned by key and order, so a key with very many rows lies in several
partitions. Within a sorted partition the running id says where a row lies; partitions and keys
then only need their counts, one row for each key of a partition, to know what comes before.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.sources.session import scratch_dir

_ROWS = 33  # a running id holds the row of a partition in its lower bits, the partition above


def _placed(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column], by_part: bool = False
) -> DataFrame:
    """The rows with ``_part`` and ``_at``, written once so that both stay what they are."""
    by = [*[F.col(k) for k in keys], *order]
    placed = (
        frame.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_id", F.monotonically_increasing_id())
        .select(
            *frame.columns,
            F.col("_id").bitwiseAND(F.lit((1 << _ROWS) - 1)).alias("_at"),
            F.shiftright("_id", _ROWS).alias("_part"),
        )
    )
    path = scratch_dir(frame.sparkSession, "numbered")
    writer = placed.write.partitionBy("_part") if by_part else placed.write
    writer.parquet(path)
    return frame.sparkSession.read.schema(placed.schema).parquet(path)


def numbered(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "number"
) -> DataFrame:
    """``frame`` with a number from 0 within ``keys``, by ``order``.

    Equal rows are numbered in any order among themselves. Null keys are left out.
    """
    for key in keys:
        frame = frame.where(F.col(key).isNotNull())
    placed = _placed(frame, keys, order)
    runs = placed.groupBy("_part", *keys).agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = Window.orderBy("_part") if not keys else Window.partitionBy(*keys).orderBy("_part")
    runs = runs.withColumn("_before", F.sum("_rows").over(earlier) - F.col("_rows"))
    return placed.join(runs, ["_part", *keys]).select(
        *frame.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name)
    )


@dataclass(frozen=True)
class Ranked:
    """Rows in their order, cut into ranges of known size, one folder each."""

    rows: DataFrame
    columns: tuple[str, ...]
    #: Rows of each range, in order: as many numbers as there are shuffle partitions.
    sizes: tuple[int, ...]

    @property
    def count(self) -> int:
        return sum(self.sizes)

    def pages(self, size: int) -> int:
        return -(-self.count // size)

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` (from 1): opens the ranges that the page lies in, one as a rule, and of
        these only the row groups with its places."""
        if number < 1 or size < 1:
            raise ValueError("page number and size start at 1")
        first, last, begin = (number - 1) * size, number * size, 0
        wanted = F.lit(False)
        for part, rows in enumerate(self.sizes):
            low, high = max(first - begin, 0), min(last - begin, rows)
            if low < high:
                inside = F.col("_at").between(low, high - 1)
                wanted = wanted | ((F.col("_part") == part) & inside)
            begin += rows
        return self.rows.where(wanted).orderBy("_part", "_at").select(*self.columns)


def rank(frame: DataFrame, order: Sequence[Column]) -> Ranked:
    """Rank all rows by ``order`` once. Rows that it leaves equal come in any order."""
    placed = _placed(frame, (), order, by_part=True)
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    sizes = tuple(counts.get(part, 0) for part in range(max(counts, default=-1) + 1))
    return Ranked(placed, tuple(frame.columns), sizes)
