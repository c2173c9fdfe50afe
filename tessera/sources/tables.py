"""Parquet tables, and small ones in few files spread over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch at most (a single row may be larger).
BATCH_ROWS, BATCH_BYTES = 512, "4m"

#: Bytes of input that a core is worth; and under how many nothing is spread.
PER_CORE, LEAST = 16 << 20, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that what a worker holds does not follow the length of its texts."""
    own = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(own, BATCH_ROWS) if own > 0 else BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt over the cores: a file of one row group is one task
    whatever the split size. Larger tables, whose files already keep the cluster busy, stay as they are, so this never
    moves more than PER_CORE bytes a core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if LEAST <= size < PER_CORE * cores and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
