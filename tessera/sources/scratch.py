"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder as the session names it. Where none is named a local session gets one of its own; a cluster, whose machines
    would each see another one, an error."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if spark.sparkContext.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        return spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder; Spark removes the files when the frame is no longer referenced."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


#: The tables that this process has written and not discarded, in order.
MADE: list[str] = []


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back. It stays until discard()."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Takes away tables that nothing reads any more."""
    for path in paths:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)
        if path in MADE:
            MADE.remove(path)
