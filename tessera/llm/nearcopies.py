"""Near copies by the similarity of their shingle sets: min-hash buckets name candidates, exact Jaccard decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_batch, prepare, texts_of, written
from tessera.llm.components import connected_components
from tessera.llm.simhash import SEED, shingle_hashes

SHINGLE = 5
#: The least Jaccard similarity of two shingle sets that makes a link, as a fraction.
ALIKE = (4, 5)
#: Buckets a text, and min-hashes that must agree for one: two texts at 0.8 share none with a chance of (1 - 0.8^4)^32, 5e-8.
BANDS, ROWS = 32, 4
PIECE = 1 << 12
#: Bits that mark the texts to look at again, in blocks; and sets in a bucket from which on it is a crowd.
MARKS, _BLOCK, CROWD = 1 << 27, 1 << 15, 4
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, dtype=np.uint64, size=(BANDS * ROWS, 1)) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The different shingles' hashes, sorted; no words: none."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def buckets(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit name a band; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), PIECE):
        x = hashes[None, a : a + PIECE] * _FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, x.min(1), out=least)
    names = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(names, np.uint64).view(np.int64).tolist()


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _signatures(docs: DataFrame, key: list[str]) -> DataFrame:
    """The key, node (names the shingle set in 64 bits), size, buckets."""
    schema = pa.schema([(k, pa.int64()) for k in key] + [("node", pa.int64()), ("size", pa.int32()), ("buckets", pa.list_(pa.int64()))])

    def make(batch: pa.RecordBatch):
        sets = [shingle_set(x) for x in texts_of(batch.column(len(key)))]
        return *batch.columns[: len(key)], [_node(x) for x in sets], [len(x) for x in sets], [buckets(x) for x in sets]

    return docs.mapInArrow(by_batch(make, schema), ", ".join(f"{k} long" for k in key) + ", node long, size int, buckets array<long>")


def _sets(docs: DataFrame, key: list[str], chosen: DataFrame) -> DataFrame:
    """node, hashes of the texts of chosen rows (key), and perhaps of a few others: texts do not move. Which rows are chosen
    is told by one bit for each hash of a key, of MARKS bits in all; beyond as many rows more texts are looked at."""
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(MARKS))
    blocks = chosen.select(place(*key).alias("at")).groupBy(F.expr(f"at div {_BLOCK}").alias("block")).agg(F.bitmap_construct_agg(F.col("at") % _BLOCK).alias("bits"))
    marks = np.zeros((MARKS // _BLOCK, _BLOCK // 8), np.uint8)
    for r in blocks.toLocalIterator():  # MARKS bits at most
        marks[r["block"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks.ravel())
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            at = np.asarray(batch.column(0))
            own = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            if own.num_rows:
                sets = [shingle_set(x) for x in texts_of(own.column(1))]
                yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], schema=schema)

    return docs.select(place(*key).alias("at"), "__text").mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def _alike(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Of pairs u, v those whose sets are alike, by the exact count of what they share."""
    num, den = ALIKE
    pairs = written(pairs, f"{name}-asked")  # often few: the sets need not move then
    a, b = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h_{x}")) for x in ("u", "v"))
    both, one, other = F.size(F.array_intersect("h_u", "h_v")), F.size("h_u"), F.size("h_v")
    return written(pairs.join(a, "u").join(b, "v").where(both * den >= (one + other - both) * num).select("u", "v"), name)


def _linkable(hits: DataFrame, sets: DataFrame) -> DataFrame:
    """hits (bucket, node, size) with alone: of a set's shingles those that none of its neighbours can have, for sets in
    buckets of CROWD or more; 0 for others. Sets that are too much alone go, exactly: if `alone` of a set's `size` shingles
    are its own, and its smallest neighbour in a bucket has `least`, two sets share size - alone at most, and their similarity
    is (size - alone) / (size + max(least, size - alone) - (size - alone)) at most."""
    num, den = ALIKE
    crowds = hits.groupBy("bucket").agg(F.count("*").alias("n"), F.min("size").alias("least"))
    in_crowds = written(hits.join(crowds.where(F.col("n") >= CROWD).select("bucket"), "bucket").select("node").distinct(), "crowds")
    around = hits.join(hits.join(in_crowds, "node").select("bucket").distinct(), "bucket").select("node").distinct()  # and all their neighbours
    one = sets.join(around, "node").select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
    own = in_crowds.join(one.groupBy("node").agg(F.count("*").cast("int").alias("alone")), "node")
    near = hits.join(crowds.select("bucket", "least"), "bucket").groupBy("node", "size").agg(F.min("least").alias("least")).join(own, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    most = F.col("size") - F.col("alone")
    live = near.where(most * den >= (F.col("size") + F.greatest("least", most) - most) * num).select("node", "alone")
    return hits.join(live, "node")


def _could(size_u: str, alone_u: str, size_v: str, alone_v: str) -> Column:
    """Whether two sets of these sizes can be alike: they share no more than either has besides its own."""
    num, den = ALIKE
    most = F.least(F.col(size_u) - F.col(alone_u), F.col(size_v) - F.col(alone_v))
    return most * den >= (F.col(size_u) + F.col(size_v) - most) * num


def _apart(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Of pairs u, v those in different components. placed: node, component."""
    end = lambda x: placed.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    joined = pairs.join(end("u"), "u", "left").join(end("v"), "v", "left")
    return joined.where(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).drop("c_u", "c_v")


def _edges(joined: DataFrame) -> DataFrame:
    """u, v: components as edges, so that what was joined before is not joined again."""
    return joined.select(F.col("node").alias("u"), F.col("component").alias("v"))


def near_copies(docs: DataFrame, key: list[str], text_col: str = "text") -> DataFrame:
    """The key (long columns, null allowed), component: rows with one component are linked through texts whose sets of
    shingles (words lower-cased in A-Z) have a Jaccard similarity of ALIKE or more. One row a row of docs; equal sets are
    one node, that of no words among them. Sets that cannot have a partner go first. In a bucket each set is held against
    the one that has the fewest shingles of its own, first in the bucket kind that it shares most; then only sets that this
    leaves in different components, and that can be alike, are held against each other, so a large group of copies costs no
    square."""
    prepare(docs.sparkSession)
    rows = docs.select(*key, F.col(text_col).alias("__text"))
    signed = written(_signatures(rows, key), "signatures")
    dealt = signed.select("node", "size", F.explode("buckets").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("bucket")
    hits = written(dealt.join(shared, "bucket").distinct(), "shared-buckets")
    named = hits.select("node").distinct()
    chosen = written(signed.select("node", *key).join(named, "node").groupBy("node").agg(F.min(F.struct(*key)).alias("k")).select(*[F.col(f"k.{k}").alias(k) for k in key]), "candidates")
    sets = written(_sets(rows, key, chosen), "sets")
    live = written(_linkable(hits, sets), "linkable")
    pivots = live.groupBy("bucket").agg(F.min(F.struct("alone", "node", "size")).alias("p")).select("bucket", F.col("p.node").alias("u"), F.col("p.size").alias("size_u"), F.col("p.alone").alias("alone_u"))
    stars = live.join(pivots, "bucket").where((F.col("node") != F.col("u")) & _could("size", "alone", "size_u", "alone_u")).groupBy("u", F.col("node").alias("v")).agg(F.count("*").alias("n"))
    stars = written(stars, "stars")
    best = stars.groupBy("v").agg(F.max_by("u", F.struct("n", "u")).alias("u")).select("u", "v")
    first_joined = connected_components(_alike(best, sets, "first-links"))
    joined = connected_components(_edges(first_joined).union(_alike(_apart(stars.select("u", "v"), first_joined), sets, "star-links")))
    every = live.groupBy("node", "size", "alone").agg(F.sort_array(F.collect_list("bucket")).alias("all"))  # BANDS at most
    placed = written(live.select("bucket", "node").join(every, "node").join(joined, "node", "left").select("bucket", "node", "size", "alone", "all", F.coalesce("component", "node").alias("c")), "placed")
    several = placed.groupBy("bucket").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a != b").select("bucket")
    left = placed.join(several, "bucket")
    end = lambda x: left.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "alone", "all", "c")])
    first = F.array_min(F.array_intersect("all_u", "all_v"))  # each pair in one of its buckets
    rest = end("u").join(end("v"), "bucket").where((F.col("c_u") < F.col("c_v")) & _could("size_u", "alone_u", "size_v", "alone_v") & (first == F.col("bucket"))).select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    seen = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = connected_components(_edges(joined).union(_alike(rest.join(seen, ["u", "v"], "left_anti"), sets, "other-links")))
    return signed.select("node", *key).join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("component"))
