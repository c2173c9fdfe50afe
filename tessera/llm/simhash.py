"""SimHash near-duplicates: fingerprints of 3-word shingles, linked by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_batch, prepare, texts_of, written
from tessera.llm.components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: A segment's bits; two segments, and of at most RADIUS differing bits one segment has at most one.
SEGMENT = 32
#: Fingerprints that may share a segment before they are told apart by the halves of their other one, and the most values
#: of segments that more can share.
SHARED, MOST_SHARED = 4096, 200_000


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of a text whose A-Z are lower-cased here, words split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return []
    joined, take = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - take + 1].tolist(), ends[take - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text: a bit is set where over half of the shingles' hashes have it; no words: 0."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text)
        if hashes:
            total = np.zeros(64, np.int64)
            all_h = np.array(hashes, dtype=">u8")
            for a in range(0, len(all_h), 1 << 16):  # a long text's bits are counted piece by piece
                total += np.unpackbits(all_h[a : a + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
            out[i] = int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")
    return out


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp long (the fingerprint's 64 bits). One row a row of docs; null text: no words."""
    return _marked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"])


def _marked(docs: DataFrame, key: list[str]) -> DataFrame:
    """The key (long columns), fp of rows with a text."""
    prepare(docs.sparkSession)
    schema = pa.schema([(k, pa.int64()) for k in [*key, "fp"]])
    made = by_batch(lambda b: (*b.columns[: len(key)], fingerprints(texts_of(b.column(len(key)))).view(np.int64)), schema)
    return docs.select(*key, "text").mapInArrow(made, ", ".join(f"{k} long" for k in [*key, "fp"]))


def grouped(docs: DataFrame, key: list[str]) -> DataFrame:
    """The key (long columns, null allowed), group: rows with one group are linked through fingerprints, as in
    near_duplicates(). One row a row of docs."""
    fps = written(_marked(docs, key), "fingerprints")
    nodes = written(fps.select("fp").distinct(), "nodes")
    found = connected_components(links(nodes.select("fp", F.col("fp").alias("rep"))))
    return fps.join(found, fps.fp == found.node, "left").select(*key, F.coalesce("component", "fp").alias("group"))


def _segments(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, SEGMENT), fp.bitwiseAND(F.lit((1 << SEGMENT) - 1))]


def _ball(value: Column, bits: int) -> Column:
    """A value of so many bits and all that differ from it in one."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    return F.concat(F.array(value), flips)


def _halves(fp: Column, seg: Column) -> list[Column]:
    """Both halves of the segment that is not `seg`."""
    high, low = _segments(fp)
    other, half = F.when(seg == 0, low).otherwise(high), SEGMENT // 2
    return [F.shiftrightunsigned(other, half), other.bitwiseAND(F.lit((1 << half) - 1))]


def links(nodes: DataFrame, shared: int = SHARED) -> DataFrame:
    """nodes: fp long (distinct), rep long. Returns u, v long: reps of fingerprints at RADIUS bits or fewer, each pair once
    a segment at least. Each fingerprint stands in a table twice, once a segment, and looks up the balls of radius one
    around its own segments. Of two segments that differ in one bit only the one with a zero there looks the other up.
    Where over `shared` fingerprints, and over a 200 000th of all, have one value of a segment, their other segment's halves
    go into the key, and balls of radius one around these are looked up: of RADIUS bits at most one half has at most one.
    Both sides are shuffled: Spark takes an explode's size for its input's, and would broadcast what is many times larger."""
    fp = F.col("fp")
    table = nodes.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), s.alias("val")) for i, s in enumerate(_segments(fp))])).alias("k")).select(F.col("k.seg").alias("seg"), F.col("k.val").alias("val"), F.col("fp").alias("fp_t"), F.col("rep").alias("v"))

    def ball(i: int, segment: Column) -> Column:
        flips = F.transform(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda b: segment.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
        return F.transform(F.array_union(F.array(segment), flips), lambda x: F.struct(F.lit(i).alias("seg"), x.alias("val"), (x == segment).alias("same")))

    probes = nodes.select("fp", "rep", F.explode(F.concat(*[ball(i, s) for i, s in enumerate(_segments(fp))])).alias("k")).select(F.col("k.seg").alias("seg"), F.col("k.val").alias("val"), F.col("k.same").alias("same"), F.col("fp").alias("fp_p"), F.col("rep").alias("u"))
    near = (F.bit_count(F.col("fp_t").bitwiseXOR(F.col("fp_p"))) <= RADIUS) & (F.col("fp_t") != F.col("fp_p")) & (~F.col("same") | (F.col("fp_p") < F.col("fp_t")))
    often = written(table.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > shared), "shared-segments")
    many = often.where(F.col("n") > nodes.count() // MOST_SHARED).select("seg", "val", F.lit(True).alias("many"))

    def keyed(rows: DataFrame, name: str, keys) -> DataFrame:
        """With the half's number and value; -1 and 0 where few share the segment."""
        def numbered(i: int, values: Column) -> Column:
            return F.transform(values, lambda x: F.struct(F.lit(i).alias("half"), x.alias("sub")))

        own = [numbered(i, keys(h)) for i, h in enumerate(_halves(F.col(name), F.col("seg")))]
        alone = numbered(-1, F.array(F.lit(0).cast("long")))
        return rows.join(F.broadcast(many), ["seg", "val"], "left").withColumn("h", F.explode(F.when(F.col("many"), F.concat(*own)).otherwise(alone))).select("*", "h.half", "h.sub").drop("many", "h")

    p = keyed(probes, "fp_p", lambda h: _ball(h, SEGMENT // 2)).alias("p")
    t = keyed(table, "fp_t", F.array).alias("t")
    same_key = [F.col(f"p.{c}") == F.col(f"t.{c}") for c in ("seg", "val", "half", "sub")]
    return p.join(t.hint("merge"), same_key[0] & same_key[1] & same_key[2] & same_key[3] & near).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the least doc_id reachable through links, its own
    included). One row a row of docs. Equal fingerprints are one node. Null or empty text: fingerprint zero, linked as any
    other. Null doc_id: a fingerprint, and the component of the rows that it links to where one has an id; it never names
    a component. Repeated rows: each keeps its row. Empty docs: no rows. Other columns are not read."""
    fps = written(with_fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")  # null where only rows without an id have it
    found = connected_components(links(nodes.select("fp", F.col("fp").alias("rep"))))
    member = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    least = member.groupBy("group").agg(F.min("first").alias("component_id"))
    named = member.join(least, "group").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
