"""The corpus pipeline: documents through five operators, each stage over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, linededup, nearcopies, packing, quality, simhash
from tessera.llm.common import prepare, row_key, table, written
from tessera.llm.components import connected_components
from tessera.sources.scratch import MADE, discard

#: Columns by which a stage finds its own rows again.
KEY = ("__row_1", "__row_2")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(dict(zip(KEY, row_key("doc_id", "text"), strict=True)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go. It learns from the labels of documents given here."""
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.held_out_rows("doc_id", 3, 1))
    score = quality.scorer(spark, model)
    return docs.where(score(F.col("text")) >= 0.5)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; n_chars follows. All documents stay."""
    prepare(spark)
    keyed = _keyed(docs)
    rows = keyed.select(F.col(KEY[0]).alias("k1"), F.col(KEY[1]).alias("k2"), "doc_id", "text", F.col("source").cast("string").alias("site"))
    hits = linededup.hits(rows).withColumnsRenamed({"k1": KEY[0], "k2": KEY[1]})
    text = linededup.without(F.col("text"), F.col("gone"))
    out = keyed.join(hits, list(KEY), "left").withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def _either(by_set: DataFrame, by_hash: DataFrame) -> DataFrame:
    """by_set (KEY, doc_id, component) with components that share a group of by_hash (KEY, group) joined into one."""
    ends = by_set.select(*KEY, "component").distinct().join(by_hash.select(*KEY, "group").distinct(), list(KEY)).select("group", "component").distinct()
    spans = ends.groupBy("group").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most")
    edges = ends.join(spans, "group").where("component != least").select(F.col("component").alias("u"), F.col("least").alias("v"))
    joined = connected_components(edges).withColumnRenamed("component", "whole")
    return by_set.join(joined, by_set.component == joined.node, "left").select(*KEY, "doc_id", F.coalesce("whole", "component").alias("component"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, of the least doc_id. Copies are linked by SimHash, fingerprints at 3 bits
    or fewer as op4 has them; a check by exact sets follows, which links edited texts too (five-word shingles, Jaccard
    similarity of 0.8 or more). Links of either kind count, in any number of steps. Rows are told apart by doc_id and text; a
    row without doc_id stays."""
    prepare(spark)
    keyed = _keyed(docs)
    own = F.struct("doc_id", *KEY)
    key = [*KEY, "doc_id"]
    numbered = keyed.withColumn("doc_id", F.col("doc_id").cast("long"))
    by_hash = written(simhash.grouped(numbered, key), "near-hashes")
    by_set = written(nearcopies.near_copies(numbered, key), "near-copies")
    rows = _either(by_set, by_hash).where("doc_id is not null")
    least = rows.groupBy("component").agg(F.min(own).alias("least"))
    stays = own == F.col("least")
    marks = written(rows.join(least, "component").groupBy(*KEY).agg(F.first(stays).alias("__stays"), F.count("*").alias("n")).where("not __stays or n > 1").drop("n"), "near-marks")
    marked = keyed.join(marks, list(KEY), "left")
    return marked.where("__stays is null").union(marked.where("__stays").dropDuplicates(list(KEY))).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("SimHash near-dedup", near_stage), ("benchmark decontamination", benchmark_stage), ("packing", packing_stage)]

#: The classifier, XXH64 and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written in the shared folder and read back as the next one's documents; what a stage has used
    besides is taken away then."""
    docs, last = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        before = len(MADE)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
            used = MADE[before:-1]
            discard(spark, [*used, *last])
            last = [MADE[-1]]
    return docs
