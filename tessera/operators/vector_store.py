"""Vectors on disk: one a chunk and model, kept up to date by parts, and kept in memory while nothing changes."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import sync
from tessera.operators.cell_store import CellStore
from tessera.operators.vectors import batch_top_k, top_k
from tessera.sources.scratch import written
from tessera.sources.store import Table

SCHEMA = "chunk_id long, model string, message_pk long, embedding array<float>, updated_at timestamp"
KEY = ["chunk_id", "model"]
PARTS = 64


class VectorStore:
    """Exact search over a table of vectors. What a search reads stays in the executors' memory (or on their disks, if it is
    too much) until the table's next version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Table(spark, path, SCHEMA)
        self._held: tuple[dict, DataFrame] | None = None

    @staticmethod
    def part() -> Column:
        return F.lpad(F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)).cast("string"), 2, "0")

    def rows(self) -> DataFrame:
        version = self.table.parts()
        if self._held is None or self._held[0] != version:
            if self._held is not None:
                self._held[1].unpersist()
            self._held = version, self.table.read().persist(StorageLevel.MEMORY_AND_DISK)
        return self._held[1]

    def _change(self, rows: DataFrame, change) -> None:
        own = written(rows.withColumn("part", self.part()), "vectors")
        touched = [r["part"] for r in own.select("part").distinct().collect()]
        if touched:
            self.table.write(written(change(self.table.read(touched, part=True), own).withColumn("part", self.part()), "vectors-after"), touched)

    def upsert(self, rows: DataFrame) -> None:
        """rows: chunk_id, model, message_pk, embedding; the newest counts."""
        fresh = rows.select("chunk_id", "model", "message_pk", "embedding").withColumn("updated_at", F.current_timestamp())
        self._change(fresh, lambda before, own: sync.upsert(before.drop("part"), own.drop("part"), KEY, revive=None))

    def delete(self, ids: DataFrame) -> None:
        """The vectors of chunks, of all models."""
        self._change(ids.select("chunk_id").distinct(), lambda before, own: before.drop("part").join(own.select("chunk_id"), "chunk_id", "left_anti"))

    def reset(self) -> None:
        self.table.write(self.table.read(part=True).where("false"))

    def count(self, model: str | None = None) -> int:
        return (self.rows() if model is None else self.rows().where(F.col("model") == model)).count()

    def query(self, vector: list[float], k: int, model: str | None = None, where: Column | None = None) -> DataFrame:
        """chunk_id, score of the k nearest; conditions hold before the cut."""
        tests = [t for t in (None if model is None else F.col("model") == model, where) if t is not None]
        return top_k(self.rows(), vector, k, "chunk_id", where=tests[0] & tests[1] if len(tests) == 2 else tests[0] if tests else None)

    def queries(self, own: DataFrame, k: int) -> DataFrame:
        """query_id, chunk_id, score, rank for many queries."""
        return batch_top_k(self.rows(), own, k, "chunk_id")


#: Stores by name: the exact one, and one of cells, which reads only those near a query. `auto` takes the first one that has
#: been registered besides and can be made, the exact one at last.
OWN = ("exact", "cells")
BACKENDS = {"exact": VectorStore, "cells": CellStore}


def register(name: str, make) -> None:
    BACKENDS[name] = make


def vector_store(spark: SparkSession, path: str, name: str = "auto") -> VectorStore:
    """A store by name; auto takes the first registered one that can be made, the exact one at last."""
    for key in [name] if name != "auto" else [*(k for k in BACKENDS if k not in OWN), "exact"]:
        try:
            return BACKENDS[key](spark, path)
        except (ImportError, OSError):
            if name != "auto":
                raise
    raise LookupError("no vector store")
