"""Exact top-k by inner product: bounds from segment means and deviations, coarse to fine, then exact survivors.

Vectors are turned into the basis of their principal directions, the largest first, which changes no inner product. A level
cuts the coordinates into segments: leading ones of width one, and RESTS wider ones behind them. With a segment's mean and
deviation, <a, b> <= sum over segments of width * (mean * mean + deviation * deviation), and a finer level only adds leading
segments. As |a - b|^2 = |a|^2 + |b|^2 - 2 <a, b>, an upper bound of the product is a lower bound of the distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare, written

SCALE = 64
#: Shares of the coordinates that are segments of their own at each level, coarse to fine, and wider segments behind them.
LEVELS, RESTS = (0.0, 0.25, 0.5, 0.75, 0.875), 4
#: Query vectors broadcast at once; pairs bounded at once, and scored at once.
QUERY_BLOCK, BOUNDED, SCORED = 16384, 1 << 23, 1 << 15
#: Rows, in the order of a hash of the id, whose scores give every query a first threshold; the basis is fitted on them.
SEED = 4096


class Levels:
    """The statistics of vectors at every level, in a given basis."""

    def __init__(self, basis: np.ndarray):
        dim = len(basis)
        self.basis = basis
        self.singles = sorted({int(s * dim) for s in LEVELS})
        self.rests = [[p for p in np.array_split(np.arange(t, dim), RESTS) if len(p)] for t in self.singles]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The turned vectors, and for each level the means and deviations of the wider segments, each times the root of
        the width."""
        z = x.astype(self.basis.dtype) @ self.basis
        out = []
        for parts in self.rests:
            stats = np.empty((len(z), 2 * len(parts)), z.dtype)
            for i, p in enumerate(parts):
                own = z[:, p]
                stats[:, 2 * i] = own.mean(1) * np.sqrt(len(p))
                stats[:, 2 * i + 1] = own.std(1) * np.sqrt(len(p))
            out.append(stats)
        return z, out


def levels_of(sample: np.ndarray, dim: int, most: float) -> Levels:
    """Levels in the basis of the sample's principal directions."""
    x = sample.astype(float)
    _, directions = np.linalg.eigh(x.T @ x) if len(x) else (None, np.eye(dim))
    return Levels(directions[:, ::-1].astype(np.float32 if most < 1e9 else np.float64))


def number_type(dim: int, most: float) -> type:
    """The smallest type in which products of integer vectors up to this size are exact."""
    return np.float32 if dim * most * most < 2**24 else np.float64 if dim * most * most < 2**53 else np.int64


class Block:
    """A block of queries and the best k of each so far, none of them below the query's threshold."""

    def __init__(self, vectors: np.ndarray, k: int, levels: Levels, least: np.ndarray | None = None):
        self.vectors, self.k, self.levels = vectors, k, levels
        self.z, self.stats = levels.of(vectors)
        self.norms = np.sqrt((self.z.astype(float) ** 2).sum(1))
        self.rows, self.found, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(len(vectors), -np.inf) if least is None else least.copy()
        self.seen = self.exact = 0

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Only pairs whose bounds reach the query's k-th score at all levels are scored."""
        step = max(1, BOUNDED // max(1, len(self.vectors)))
        for i in range(0, len(ids), step):
            self._offer(ids[i : i + step], vectors[i : i + step])

    def _survivors(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z, stats = self.levels.of(vectors)
        norm = float(np.sqrt((z.astype(float) ** 2).sum(1)).max())
        eps = 1e-5 + 4 * z.shape[1] * float(np.finfo(z.dtype).eps)  # bounds are rounded, scores are not
        slack = (self.least - eps * self.norms * norm - 1e-3).astype(z.dtype)
        q, c = np.arange(len(self.vectors)), np.arange(len(z))
        known, done, alive = np.zeros((len(q), len(c)), z.dtype), 0, None
        for single, mine, theirs in zip(self.levels.singles, self.stats, stats, strict=True):
            if single > done:
                known += self.z[q, done:single] @ z[c, done:single].T
                done = single
            now = known + mine[q] @ theirs[c].T >= slack[q][:, None]
            alive = now if alive is None else alive & now
            live_q, live_c = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if len(live_q) < 0.8 * len(q) or len(live_c) < 0.8 * len(c):
                q, c, part = q[live_q], c[live_c], np.ix_(live_q, live_c)
                known, alive = known[part], alive[part]
        rows, cols = np.nonzero(alive)
        return q[rows], c[cols]

    def _offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(self.vectors):
            return
        rows, cols = self._survivors(vectors)
        self.seen += len(ids) * len(self.vectors)
        self.exact += len(rows)
        scores = np.empty(len(rows), np.int64)
        for i in range(0, len(rows), SCORED):
            part = slice(i, i + SCORED)
            scores[part] = np.einsum("ij,ij->i", self.vectors[rows[part]], vectors[cols[part]])
        stays = scores >= self.least[rows]
        self._merge(rows[stays], ids[cols[stays]], scores[stays])

    def _merge(self, rows: np.ndarray, found: np.ndarray, scores: np.ndarray) -> None:
        rows, found, scores = (np.concatenate(x) for x in ((self.rows, rows), (self.found, found), (self.scores, scores)))
        order = np.lexsort((found, -scores, rows))
        rows, found, scores = rows[order], found[order], scores[order]
        first = np.searchsorted(rows, rows, "left")
        keep = np.arange(len(rows)) - first < self.k
        self.rows, self.found, self.scores = rows[keep], found[keep], scores[keep]
        full = np.bincount(self.rows, minlength=len(self.vectors)) >= self.k
        ends = np.searchsorted(self.rows, np.arange(len(self.vectors)), "right") - 1
        self.least[full] = np.maximum(self.least[full], self.scores[ends[full]])


def first_thresholds(queries: np.ndarray, k: int, levels: Levels, seed_ids: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """For each query the k-th best score among the seed rows; rows are offered in growing parts, so that few pairs are
    scored before there is a threshold."""
    block, at, step = Block(queries, k, levels), 0, 2 * k
    while at < len(seed):
        block.offer(seed_ids[at : at + step], seed[at : at + step])
        at, step = at + step, 2 * step
    return block.least


RESULT = pa.schema([("q", pa.int32()), ("query_id", pa.int64()), ("own", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("seen", pa.int64()), ("exact", pa.int64())])
RESULT_DDL = "q int, query_id long, own long, vec_id long, score long, seen long, exact long"


def _matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    lengths = np.asarray(pc.list_value_length(column))
    out = np.zeros((len(column), dim), kind)
    out[np.arange(dim)[None, :] < lengths[:, None]] = np.asarray(column.flatten())
    return out


def _local(df: DataFrame, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    rows = df.select("vec_id", "v").toArrow().combine_chunks()
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, dim), kind)
    return np.asarray(rows.column("vec_id").combine_chunks()), _matrix(rows.column("v").combine_chunks(), dim, kind)


def searched(candidates: DataFrame, queries: tuple[np.ndarray, np.ndarray], least: np.ndarray, levels: Levels, k: int) -> DataFrame:
    """RESULT: of each task over the candidates, every query's k best at or above its threshold, and one row more a task
    (q is null) with the pairs that it saw and those that it scored."""
    ids, matrix = queries
    dim, kind = matrix.shape[1], matrix.dtype.type
    shared = candidates.sparkSession.sparkContext.broadcast((ids, matrix, least, levels))

    def search(batches):
        ids, matrix, least, levels = shared.value
        block = Block(matrix, k, levels, least)
        for batch in batches:
            if batch.num_rows:
                block.offer(np.asarray(batch.column(0)), _matrix(batch.column(1), dim, kind))
        own = np.einsum("ij,ij->i", matrix, matrix).astype(np.int64)
        n = len(block.rows)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(block.rows.astype(np.int32)), pa.array(ids[block.rows]), pa.array(own[block.rows]), pa.array(block.found), pa.array(block.scores), none, none], schema=RESULT)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(RESULT)[:5]), pa.array([block.seen]), pa.array([block.exact])], schema=RESULT)

    return candidates.select("vec_id", "v").mapInArrow(search, RESULT_DDL)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k + 1 best rows without its own row: the one of its id and its product
    with itself, where that is among them."""
    by_query = Window.partitionBy("q")
    ranked = found.where("q is not null").withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k + 1)
    itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("rank"))).over(by_query)
    others = ranked.withColumn("itself", F.coalesce(itself, F.lit(k + 1))).where("rank != itself")
    return others.select("query_id", F.when(F.col("rank") > F.col("itself"), F.col("rank") - 1).otherwise(F.col("rank")).cast("int").alias("rank"), "vec_id", "score")


def _passes(vectors: DataFrame, is_query, k: int, id_col: str, vector_col: str, scale: int, query_block: int, seed_rows: int) -> Iterator[tuple[DataFrame, bool]]:
    """What searched() finds for each block of queries, and whether it is the only one."""
    prepare(vectors.sparkSession)
    fits = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fits)
    cast = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = whole.select(F.col(id_col).cast("long").alias("vec_id"), cast.alias("v"))
    facts = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))), F.count(F.when(is_query(F.col("vec_id")), 1))).first()
    dim, most, n = int(facts[0] or 1) or 1, float(facts[1] or 0), int(facts[2])
    kind, blocks = number_type(dim, most), max(1, -(-n // query_block))
    if blocks > 1:  # dealt by a number of the row itself, which repeated rows do not share
        rows = written(rows.withColumn("deal", F.monotonically_increasing_id()), "vectors")
    seed_ids, seed = _local(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(seed_rows), dim, kind)
    levels = levels_of(seed, dim, most)
    for b in range(blocks):
        own = rows.where(is_query(F.col("vec_id")))
        queries = _local(own if blocks == 1 else own.where(F.pmod("deal", F.lit(blocks)) == b), dim, kind)
        least = first_thresholds(queries[1], k + 1, levels, seed_ids, seed)
        yield searched(rows, queries, least, levels, k + 1), blocks == 1


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK, seed_rows: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query (a condition on id_col) holds for, its k highest
    integer inner products over all other rows (all, if fewer), ties to the smaller vec_id. Components are
    floor(scale * x). Rows with a null id or vector, or a null or non-finite component, take no part; a shorter vector goes
    on with zeros; ties at the k-th place follow the id. Rows that repeat a vec_id are rows like any other: each is a query
    with ranks of its own, and a candidate of all others. Empty table or no query: no rows. Other columns are not read.
    Queries go out in blocks of query_block; seed_rows rows give the basis and each query's first threshold."""
    found = [best_of(x, k) if only else written(best_of(x, k), "top-k") for x, only in _passes(vectors, is_query, k, id_col, vector_col, scale, query_block, seed_rows)]
    return reduce(DataFrame.union, found)


def pairs_scored(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, query_block: int = QUERY_BLOCK, seed_rows: int = SEED) -> tuple[int, int]:
    """Pairs of a query and a row that top_k bounds, and those of them that it scores."""
    sums = [x.agg(F.sum("seen"), F.sum("exact")).first() for x, _ in _passes(vectors, is_query, k, id_col, vector_col, scale, query_block, seed_rows)]
    return sum(r[0] or 0 for r in sums), sum(r[1] or 0 for r in sums)
