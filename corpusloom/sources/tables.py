"""Readers of the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows cost much more to work on than to move.
TEXTS = ("documents", "pages")
#: Bytes of an Arrow batch.
BATCH = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what Python workers hold at once: Arrow batches of ``BATCH`` bytes, unless the session has its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default
        spark.conf.set(key, BATCH)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores where fewer tasks than these would read it, as with one file of one row group; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXTS:
        bounded_batches(spark)
    return spread(df) if name in TEXTS else df
