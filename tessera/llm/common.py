"""What the operators of this subpackage share: reading tables, the shared scratch folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import checkpointed, scratch, written
from tessera.sources.tables import read

__all__ = ["by_batch", "checkpointed", "dealt", "prepare", "row_key", "scratch", "table", "texts_of", "utf8", "written"]

#: Rows and bytes of one Arrow batch at most (a single row may be larger).
BATCH_ROWS, BATCH_BYTES = 512, "4m"
#: Rows of a key that one task may have, and the most keys that can have more than a task's share of all rows.
HOT, MOST_HOT = 1000, 100_000


def prepare(spark: SparkSession) -> SparkSession:
    """Sets what every operator here relies on: small Arrow batches, so that long texts stay within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(prepare(spark), sf_dir, name)


def row_key(*columns: str) -> tuple[Column, Column]:
    """128 bits that name a row by the given columns, nulls included; rows that agree in them share the key."""
    marked = [c for name in columns for c in (F.col(name).isNull(), F.col(name))]
    return F.xxhash64(*marked), F.xxhash64(F.lit(17), *reversed(marked))


def dealt(rows: DataFrame, marks: DataFrame, on: list[str], by: list[str], hot: int = HOT, how: str = "inner") -> DataFrame:
    """rows joined with marks: one row a key, with n, how many rows have it, which goes. A task's share of a key is `hot` rows,
    or a 100 000th of all marked ones where that is more; a key that more rows have is dealt over as many tasks as it has
    shares, by a hash of the columns `by`. So at most 100 000 keys are told apart, whatever the input.
    how: inner, or left where rows without a mark stay."""
    total = marks.agg(F.sum("n")).first()[0] or 0
    share = max(hot, total // MOST_HOT)
    many = marks.where(F.col("n") > share).select(*on, F.ceil(F.col("n") / share).cast("int").alias("__salts"))
    salted = rows.join(F.broadcast(many), on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    all_salts = F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)
    spread = marks.drop("n").join(F.broadcast(many), on, "left").withColumn("__salt", F.explode(all_salts)).drop("__salts")
    return salted.join(spread, [*on, "__salt"], how).drop("__salt")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's rows, one after another, and where each row starts (with the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    starts = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[starts[0] : starts[-1]], starts - starts[0]


def texts_of(column: pa.Array) -> list[bytes]:
    """A string column's rows as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def by_batch(make, schema: pa.Schema):
    """A function for mapInArrow: make(batch) gives a dict of columns for each batch that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x for x, f in zip(make(batch), schema, strict=True)], schema=schema)

    return run
