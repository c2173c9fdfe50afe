"""Approximate vector search: an inverted file of k-means cells on disk, of which a search reads those nearest to its query."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.vectors import MOST_QUERY_BYTES, MOST_SCORES, Tops, batch_top_k, matrix_of, top_k
from tessera.sources.scratch import checkpointed, written
from tessera.sources.store import Table

ROWS = "chunk_id long, model string, message_pk long, embedding array<float>, updated_at timestamp"
CENTRES = "cell int, centre array<double>, probes int"
KEY = ["chunk_id", "model"]
#: Cells at most, and the vectors of the sample that they are fitted on, for each cell.
MOST_CELLS, SAMPLE = 4096, 256
#: Queries (a sample of what is stored), hits of each, and the share of these that the cells which a search reads must have.
TUNED_ON, TUNED_TOP, RECALL = 256, 20, 0.93


def cells_for(n: int) -> int:
    """As many cells as rows in a cell, as far as centres stay small enough to be sent to every task."""
    return max(1, min(MOST_CELLS, round(math.sqrt(n))))


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The cell of each vector: that of the centre at the least distance, ties to the lower number."""
    half = (centres**2).sum(1) / 2
    step = max(1, MOST_SCORES // len(centres))
    return np.concatenate([np.argmax(vectors[i : i + step] @ centres.T - half, axis=1) for i in range(0, len(vectors), step)] or [np.zeros(0, np.int64)])


def probed(vectors: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The cells of the centres with the largest products, for each query."""
    step = max(1, MOST_SCORES // len(centres))
    if probes >= len(centres):
        return np.tile(np.arange(len(centres)), (len(vectors), 1))
    return np.concatenate([np.argpartition(-(vectors[i : i + step] @ centres.T), probes - 1, axis=1)[:, :probes] for i in range(0, len(vectors), step)] or [np.zeros((0, probes), np.int64)])


class CellStore:
    """Vectors by chunk and model in a table whose parts are cells, and the cells' centres. A change writes the cells that it
    touches; a search reads the folders of the cells that it probes and no others, and gives what an exact search over these
    cells gives. Where too few rows pass its conditions, it goes on with more cells, to all of them at last. Rows without a
    vector are not kept; vectors of unequal length are compared as far as both go."""

    def __init__(self, spark: SparkSession, path: str, cells: int | None = None):
        self.spark, self.cells = spark, cells
        self.table, self.centre_table = Table(spark, f"{path}/rows", ROWS), Table(spark, f"{path}/centres", CENTRES)
        self._held: tuple[dict, np.ndarray, int] | None = None

    # cells

    def centres(self) -> np.ndarray:
        """A row a cell; no more than MOST_CELLS."""
        version = self.centre_table.parts()
        if self._held is None or self._held[0] != version:
            rows = sorted(self.centre_table.read().collect(), key=lambda r: r["cell"])
            self._held = version, np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0)), rows[0]["probes"] if rows else 0
        return self._held[1]

    @staticmethod
    def name(cell: int) -> str:
        return f"{cell:05d}"

    def fit(self, rows: DataFrame) -> np.ndarray:
        """Centres of rows' vectors: k-means over a sample that is picked by a hash of the key, SAMPLE rows a cell."""
        own = rows.where(F.col("embedding").isNotNull())
        n, dim = own.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
        k = min(self.cells or cells_for(n), max(1, n))
        share = int(min(1.0, k * SAMPLE / max(1, n)) * (1 << 30))
        padded = F.slice(F.concat(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), dim)), 1, dim)
        sample = own.where(F.pmod(F.xxhash64(*KEY), F.lit(1 << 30)) < share).select(array_to_vector(padded).alias("features"))
        if k == 1 or sample.isEmpty():
            return np.zeros((1, dim))
        return np.array(KMeans(k=k, seed=7, maxIter=8, initSteps=2).fit(checkpointed(sample)).clusterCenters())

    def train(self, rows: DataFrame | None = None) -> int:
        """Fits the cells anew, on what is stored or on given rows, deals what is stored out to them, and finds out how many a
        search has to read. Returns how many there are."""
        own = self.table.read()
        centres = self.fit(own if rows is None else rows)
        self.table.write(written(self.dealt(own, centres), "cells"))
        self._put(centres, self._needed(self.dealt(own if rows is None else rows, centres), centres))
        return len(centres)

    def _put(self, centres: np.ndarray, probes: int) -> None:
        self.centre_table.write(self.spark.createDataFrame([(i, c.tolist(), probes, "all") for i, c in enumerate(centres)], f"{CENTRES}, part string"))

    def tune(self, target: float = RECALL) -> int:
        """The number of cells that searches read from now on: the least that has the target share of the best hits of a sample
        of what is stored. It depends on the vectors: few cells where they lie in groups, many where they lie evenly."""
        n = self._needed(self.table.read(part=True), self.centres(), target)
        self._put(self.centres(), n)
        return n

    def _needed(self, rows: DataFrame, centres: np.ndarray, target: float = RECALL) -> int:
        own = written(rows.select("chunk_id", "embedding", "part"), "cell-tuning")
        n = own.count()
        share = max(1, int(min(1.0, TUNED_ON / max(1, n)) * (1 << 30)))
        sample = written(own.where(F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(1 << 30)) < share).select(F.col("chunk_id").alias("query_id"), "embedding"), "cell-sample")
        hits = batch_top_k(own, sample, TUNED_TOP + 1, "chunk_id").where("query_id != chunk_id").select("query_id", "chunk_id")
        placed = own.select("chunk_id", F.col("part").cast("int").alias("cell")).join(F.broadcast(hits), "chunk_id")  # TUNED_TOP rows a query of the sample
        found = placed.groupBy("query_id").agg(F.collect_list("cell").alias("cells")).join(sample, "query_id").select("embedding", "cells").toArrow().combine_chunks()
        if not found.num_rows:
            return len(centres)
        order = np.argsort(np.argsort(-(matrix_of(found.column(0).combine_chunks(), centres.shape[1]) @ centres.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.concatenate([order[i][cells.as_py()] for i, cells in enumerate(found.column(1))]))
        return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1

    def dealt(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """rows with the part that they belong to."""
        shared = self.spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for b in batches:
                parts = [CellStore.name(i) for i in nearest(matrix_of(b.column("embedding"), c.shape[1]), c)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.string())], names=[*b.schema.names, "part"])

        return rows.where(F.col("embedding").isNotNull()).select(*self.table.columns).mapInArrow(run, f"{ROWS}, part string")

    def sizes(self) -> DataFrame:
        """cell, n: rows of each cell."""
        return self.table.read(part=True).groupBy(F.col("part").cast("int").alias("cell")).agg(F.count("*").alias("n"))

    # changes

    def _change(self, keys: DataFrame, on: list[str], fresh: DataFrame | None) -> None:
        """Rows with the keys go, fresh ones come: of all rows only the keys are read, and only their cells written."""
        before = self.table.read(part=True).select(*on, "part").join(keys, on, "left_semi").select("part")
        touched = [r["part"] for r in (before if fresh is None else before.union(fresh.select("part"))).distinct().collect()]  # cells
        if touched:
            kept = self.table.read(touched, part=True).join(keys, on, "left_anti").select(*self.table.columns, "part")
            self.table.write(written(kept if fresh is None else kept.union(fresh.select(*self.table.columns, "part")), "cells-after"), touched)

    def upsert(self, rows: DataFrame) -> None:
        """rows: chunk_id, model, message_pk, embedding, one a chunk and model. The first rows fit the cells."""
        own = rows.select("chunk_id", "model", "message_pk", "embedding").withColumn("updated_at", F.current_timestamp())
        if not len(self.centres()):
            self.train(own)
        fresh = written(self.dealt(own, self.centres()), "cells-fresh")
        self._change(rows.select(*KEY).distinct(), KEY, fresh)

    def delete(self, ids: DataFrame) -> None:
        """The vectors of chunks, of all models."""
        self._change(ids.select("chunk_id").distinct(), ["chunk_id"], None)

    def reset(self) -> None:
        """No rows and no cells; the next rows fit them anew."""
        self.table.write(self.table.read(part=True).where("false"))
        self.centre_table.write(self.centre_table.read(part=True).where("false"))

    def count(self, model: str | None = None) -> int:
        own = self.table.read()
        return (own if model is None else own.where(F.col("model") == model)).count()

    # searches

    def probes(self, asked: int | None = None) -> int:
        n = len(self.centres())
        return max(1, min(n, self._held[2] if asked is None else asked)) if n else 0

    def query(self, vector: list[float], k: int, model: str | None = None, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """chunk_id, score of the k nearest in the probed cells; conditions hold before the cut."""
        n, tests = self.probes(probes), [t for t in (None if model is None else F.col("model") == model, where) if t is not None]
        order = np.argsort(-(self.centres() @ matrix_of(pa.array([vector], pa.list_(pa.float64())), self.centres().shape[1])[0]), kind="stable") if n else []
        while True:
            own = self.table.read([self.name(c) for c in order[:n]])
            for t in tests:
                own = own.where(t)
            if n >= len(order) or own.limit(k).count() == k:
                return top_k(own, vector, k, "chunk_id")
            n = min(len(order), 2 * n)

    def queries(self, own: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank for many queries (query_id, embedding), each over the cells that it probes. Vectors
        do not move: tasks read the cells, multiply each with the queries that probe it, and keep one top; queries with their
        cells go out in blocks of a checked size. Queries with fewer than k hits are asked again over all cells."""
        n, centres = self.probes(probes), self.centres()
        if not n:
            return self.spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
        dim = centres.shape[1]
        shared = self.spark.sparkContext.broadcast(centres)

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = probed(matrix_of(b.column(1), dim), shared.value, n)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(cells), pa.list_(pa.int32()))], names=["query_id", "embedding", "cells"])

        asked = written(own.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(choose, "query_id long, embedding array<double>, cells array<int>"), "cell-queries")
        blocks = max(1, -(-asked.count() * (dim * 8 + n * 8) // MOST_QUERY_BYTES))
        tops = [self._block(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i), k, dim) for i in range(blocks)]
        best = tops[0]
        for t in tops[1:]:
            best = best.union(t)
        if n == len(centres):
            return best
        found = written(best, "cell-tops")
        short = asked.join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id", "embedding")
        short = written(short, "cell-short")
        if short.isEmpty():
            return found
        return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(batch_top_k(self.table.read(), short, k, "chunk_id"))

    def _block(self, asked: DataFrame, k: int, dim: int) -> DataFrame:
        rows = asked.toArrow().combine_chunks()
        if not rows.num_rows:
            return self.spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
        ids, matrix = np.asarray(rows.column(0).combine_chunks()), matrix_of(rows.column(1).combine_chunks(), dim)
        lists = rows.column(2).combine_chunks()
        cells, who = np.asarray(lists.flatten()), np.repeat(np.arange(len(ids)), np.diff(np.asarray(lists.offsets)))
        order = np.argsort(cells, kind="stable")
        starts = dict(zip(*np.unique(cells[order], return_index=True), strict=True))
        by_cell = {int(c): part for c, part in zip(starts, np.split(who[order], list(starts.values())[1:]), strict=True)}
        shared = self.spark.sparkContext.broadcast((ids, matrix, by_cell))
        schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, by_cell = shared.value
            tops = Tops(matrix, k)
            for b in batches:
                part = np.asarray(b.column(2))
                for cell in np.unique(part):
                    own = b.filter(pa.array(part == cell))
                    step = max(1, MOST_SCORES // len(by_cell[int(cell)]))
                    for i in range(0, own.num_rows, step):
                        few = own.slice(i, step)
                        tops.offer(np.asarray(few.column(0)), matrix_of(few.column(1), dim), by_cell[int(cell)])
            yield pa.RecordBatch.from_arrays([pa.array(ids[tops.rows]), pa.array(tops.keys), pa.array(tops.scores)], schema=schema)

        cells = self.table.read([self.name(c) for c in by_cell], part=True).select("chunk_id", "embedding", F.col("part").cast("int").alias("cell"))
        window = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        return cells.mapInArrow(search, "query_id long, chunk_id long, score double").withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)

    def recall(self, own: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, found, there: how many of the k that an exact search gives the probed cells have, and how many it gives."""
        exact = batch_top_k(self.table.read(), own, k, "chunk_id").select("query_id", "chunk_id")
        some = self.queries(own, k, probes).select("query_id", "chunk_id", F.lit(1).alias("__hit"))
        return exact.join(some, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("__hit").alias("found"), F.count("*").alias("there"))
