"""Vector retrieval: exact inner products, filters before the top, thresholds, many queries at once, calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.embedding import dot
from tessera.sources.scratch import written

#: Bytes of query vectors that are sent to every task at most; more go in blocks.
MOST_QUERY_BYTES = 32 << 20
#: Scores that a task makes at once.
MOST_SCORES = 1 << 23


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """key, score: the k rows nearest to one query; conditions hold before the cut. No shuffle but the tops'."""
    own = vectors if where is None else vectors.where(where)
    literal = F.array(*[F.lit(float(x)) for x in query])
    return own.select(F.col(key), dot(vector, literal).alias("score")).orderBy(F.desc("score"), key).limit(k)


def threshold(hits: DataFrame, least: float = 0.0, margin: float = 0.0, score: str = "score") -> DataFrame:
    """Hits not under `least`, nor further than `margin` under the best; zero turns either off."""
    out = hits if least <= 0 else hits.where(F.col(score) >= least)
    if margin <= 0:
        return out
    best = hits.agg(F.max(score).alias("__best"))
    return out.join(F.broadcast(best)).where(F.col(score) >= F.col("__best") - margin).drop("__best")


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones go on with zeros, longer ones are cut, as a product over the common length
    has it."""
    lengths = np.asarray(pc.list_value_length(column))
    flat = np.asarray(column.flatten(), np.float64)
    if (lengths == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), max(dim, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = flat
    return out[:, :dim]


class Tops:
    """The best k rows of each query of a block so far, ties to the smaller key."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.rows, self.keys, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(len(queries), -np.inf)

    def offer(self, keys: np.ndarray, vectors: np.ndarray, who: np.ndarray | slice = slice(None)) -> None:
        """who: the queries that these rows are for."""
        scores = self.queries[who] @ vectors.T
        at = scores.shape[1] - min(self.k, scores.shape[1])
        floor = np.maximum(self.least[who], np.partition(scores, at, axis=1)[:, at])
        rows, columns = np.nonzero(scores >= floor[:, None])
        rows, keys, scores = (np.concatenate(x) for x in ((self.rows, np.arange(len(self.queries))[who][rows]), (self.keys, keys[columns]), (self.scores, scores[rows, columns])))
        order = np.lexsort((keys, -scores, rows))
        rows, keys, scores = rows[order], keys[order], scores[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < self.k
        self.rows, self.keys, self.scores = rows[kept], keys[kept], scores[kept]
        full = np.bincount(self.rows, minlength=len(self.queries)) >= self.k
        last = np.searchsorted(self.rows, np.arange(len(self.queries)), "right") - 1
        self.least[full] = self.scores[last[full]]


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """query_key, key, score, rank for many queries: each task multiplies its vectors with a block of queries and keeps its
    own k best over all its batches, so only these move. Queries go out in blocks of a checked size."""
    spark = vectors.sparkSession
    window = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    size = queries.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    dim = max(1, size[1])
    blocks = max(1, -(-size[0] * dim * 8 // MOST_QUERY_BYTES))
    out = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b).select(query_key, vector).where(F.col(vector).isNotNull()).toArrow().combine_chunks()
        own = (np.asarray(rows.column(0).combine_chunks()), matrix_of(rows.column(1).combine_chunks(), dim)) if rows.num_rows else (np.zeros(0, np.int64), np.zeros((0, dim)))
        shared = spark.sparkContext.broadcast(own)
        schema = pa.schema([(query_key, pa.int64()), (key, pa.int64()), ("score", pa.float64())])

        def search(batches, shared=shared, schema=schema):
            ids, matrix = shared.value
            if not len(ids):
                return
            tops, step = Tops(matrix, k), max(1, MOST_SCORES // len(ids))
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    tops.offer(np.asarray(part.column(0)), matrix_of(part.column(1), dim))
            yield pa.RecordBatch.from_arrays([pa.array(ids[tops.rows]), pa.array(tops.keys), pa.array(tops.scores)], schema=schema)

        found = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), vector).mapInArrow(search, f"{query_key} long, {key} long, score double")
        best = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
        if blocks > 1:  # one block is out at a time
            best = written(best, "top-k")
            shared.unpersist()
        out = best if out is None else out.union(best)
    return out


def calibration(tops: DataFrame, kind: str = "kind", score: str = "score") -> DataFrame:
    """One row: least, median and largest top score of relevant and irrelevant queries, whether they part, and the
    thresholds to choose: the middle if they part; else the median of the relevant, or one just outside either end."""
    def of(name: str, f) -> Column:
        return f(F.when(F.col(kind) == name, F.col(score)))

    half = lambda c: F.percentile(c, F.lit(0.5))
    facts = tops.agg(*[of(n, f).alias(f"{n}_{label}") for n in ("relevant", "irrelevant") for label, f in (("min", F.min), ("median", half), ("max", F.max))])
    parts = F.col("relevant_min") > F.col("irrelevant_max")
    return facts.withColumns({"separable": parts, "suggested": F.when(parts, (F.col("relevant_min") + F.col("irrelevant_max")) / 2).otherwise(F.col("relevant_median")), "lenient": F.col("relevant_min") - 0.02, "severe": F.col("irrelevant_max") + 0.02})
