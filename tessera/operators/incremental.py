"""The chunk and vector index kept up to date: what changed is chunked, what is known is reused, only the rest is embedded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.chunking import ChunkPolicy, budgeted, chunks
from tessera.functions.embedding import Backend, embed, embed_missing, embedding_text
from tessera.operators.filters import pending_index
from tessera.operators.sync import replace_children


def pending(messages: DataFrame) -> DataFrame:
    """What is to be indexed; copies of a message in another folder are not."""
    return messages.where(pending_index() & F.col("duplicate_of").isNull())


def chunked(messages: DataFrame, policy: ChunkPolicy = ChunkPolicy(), kept: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of messages with chunk_id, which follows from message and index, and embed_hash, which tells what the
    embedder would see. kept: more columns of the messages."""
    own = messages.select("message_pk", "message_id", "subject", "sender", "date_utc", "folder", *kept, budgeted(F.coalesce("body_text", F.lit(""))).alias("body_text"))
    split = chunks(own, policy=policy)
    return split.withColumns({"chunk_id": F.xxhash64("message_pk", "chunk_index"), "embed_hash": F.sha2(embedding_text("subject", "text"), 256)})


def with_vectors(fresh: DataFrame, vectors: DataFrame, backend: Backend) -> DataFrame:
    """fresh chunks with embedding, model and reused: the vector of the same message, text and model if there is one. Chunks are
    made once, for both kinds."""
    old = vectors.where(F.col("model") == backend.name).select("message_pk", "embed_hash", "embedding").dropDuplicates(["message_pk", "embed_hash"])
    joined = fresh.join(old, ["message_pk", "embed_hash"], "left").withColumn("reused", F.col("embedding").isNotNull())
    text = F.when(~F.col("reused"), embedding_text("subject", "text"))  # what is known is not sent
    made = joined.withColumn("embedding", F.coalesce("embedding", embed_missing(text, "reused", backend)))
    return made.withColumn("model", F.lit(backend.name))


def index(messages: DataFrame, vectors: DataFrame, backend: Backend, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """The index after all pending messages are indexed: their chunks replace their old ones. A message without text has
    none."""
    own = pending(messages)
    fresh = with_vectors(chunked(own, policy), vectors, backend).select(*vectors.columns)
    return replace_children(vectors, fresh, "message_pk", own)


def rebuild(messages: DataFrame, backend: Backend, policy: ChunkPolicy = ChunkPolicy()) -> DataFrame:
    """Chunks and vectors of all live messages that are no copies, nothing reused."""
    own = messages.where(F.col("deleted_at").isNull() & F.col("duplicate_of").isNull())
    return chunked(own, policy).withColumn("embedding", embed(embedding_text("subject", "text"), backend)).withColumns({"model": F.lit(backend.name), "reused": F.lit(False)})


def removed(vectors: DataFrame, messages: DataFrame) -> DataFrame:
    """The index without the chunks of given messages."""
    return vectors.join(messages.select("message_pk"), "message_pk", "left_anti")


def counters(own: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row: messages processed, chunks made, reused, embedded and failed."""
    facts = fresh.agg(F.count("*").alias("chunks"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused") & F.col("embedding").isNotNull()).alias("embedded"), F.count_if(F.col("embedding").isNull()).alias("failed"))
    return own.agg(F.count("*").alias("messages")).join(F.broadcast(facts))
