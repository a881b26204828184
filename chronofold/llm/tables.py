"""Input tables, written intermediate tables and unused column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.sources.session import scratch_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder, so that nothing before it runs again.

    The files outlive a lost executor. They lie under ``spark.checkpoint.dir``, whose owner clears it.
    What the write shuffled is read by no later step, so its files go when the write is done, not
    when the driver next collects garbage.
    """
    spark = frame.sparkSession
    path = scratch_dir(spark, f"llm-{purpose}")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)
