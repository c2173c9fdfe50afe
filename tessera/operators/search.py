"""Search over messages and their chunks: keyword and vector channels, fusion, field scopes, hits with their texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import snippet
from tessera.operators import match
from tessera.operators.filters import LEAST_TERM, Filters, all_terms, condition, contains
from tessera.operators.keyword_index import KeywordIndex
from tessera.operators.postings import keyword_hits
from tessera.operators.vectors import threshold, top_k

RRF_K, MULTIPLIER, LIMIT = 60, 5, 20
#: The columns of the two indexes, and the index column of a field scope.
MESSAGE_COLUMNS, CHUNK_COLUMNS = ["subject", "sender", "recipients", "body_text"], ["text", "subject", "sender"]
SCOPE_COLUMN = {"subject": "subject", "sender": "sender", "recipient": "recipients"}
SCOPE_LIKE = {"subject": ["subject"], "sender": ["sender", "sender_name"], "recipient": ["recipients"], "cc": ["cc"], "body": ["body_text"]}


@dataclass(frozen=True)
class Indexes:
    """Written keyword indexes over messages, chunks and bodies; without one the texts are scanned."""

    messages: KeywordIndex | None = None
    chunks: KeywordIndex | None = None
    bodies: KeywordIndex | None = None


def _hits(rows: DataFrame, key: str, columns: list[str], plan: list[list[match.Phrase]], index: KeywordIndex | None, column: str | None = None) -> DataFrame:
    return keyword_hits(rows, key, columns, plan, column) if index is None else index.hits(plan, column)


def _ranked(hits: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows with rank; the window over what is left of them only."""
    top = hits.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def keyword_channel(messages: DataFrame, chunks: DataFrame | None, query: str, filters: Filters = Filters(), pool: int = LIMIT * MULTIPLIER, indexes: Indexes = Indexes()) -> DataFrame:
    """granularity (chunk or message), id, message_pk, score, rank. Variants of the query are tried from strict to relaxed,
    each on chunks first and then on messages, and the first that finds anything counts. Index statistics are of all rows;
    filters come before the cut. If nothing is found, terms are looked for as substrings, the newest first, with score 0.
    Over written indexes each step is a pruned search, which reads only postings that may be among the best; else the texts
    are scanned, for all steps in one plan."""
    plan = match.variants(query)
    live = messages.where(condition(filters)).select("message_pk", "date_utc")
    words = [t for t in match.terms(query) if len(t) >= LEAST_TERM]
    if indexes.messages is not None and (chunks is None or indexes.chunks is not None):
        return _first_found(messages, chunks, plan, live, words, filters, pool, indexes)
    by_message = keyword_hits(messages, "message_pk", MESSAGE_COLUMNS, plan).select((F.col("variant") * 2 + 1).alias("step"), F.col("doc_id").alias("id"), F.col("doc_id").alias("message_pk"), "score")
    found = by_message
    if chunks is not None:
        own = _hits(chunks, "chunk_id", CHUNK_COLUMNS, plan, indexes.chunks).join(chunks.select(F.col("chunk_id").alias("doc_id"), "message_pk"), "doc_id")
        found = own.select((F.col("variant") * 2).alias("step"), F.col("doc_id").alias("id"), "message_pk", "score").unionByName(by_message)
    found = found.join(live, "message_pk")
    last = 2 * max(1, len(plan))
    if words:
        found = found.unionByName(_substrings(messages, words, filters).withColumn("step", F.lit(last)))
    own = found.join(F.broadcast(found.agg(F.min("step").alias("first"))), F.col("step") == F.col("first"))
    own = own.withColumn("granularity", F.when(F.col("step") == last, "message").when(F.col("step") % 2 == 0, "chunk").otherwise("message"))
    return _ranked(own, [F.col("score"), F.when(F.col("step") == last, F.col("date_utc")).desc_nulls_last(), F.col("id")], pool).select("granularity", "id", "message_pk", "score", "rank")


def _substrings(messages: DataFrame, words: list[str], filters: Filters) -> DataFrame:
    """message_pk, id, score, date_utc of the messages that hold all words."""
    return messages.where(condition(filters) & all_terms(words, ["subject", "body_text"])).select("message_pk", F.col("message_pk").alias("id"), F.lit(0.0).alias("score"), "date_utc")


def _first_found(messages: DataFrame, chunks: DataFrame | None, plan: list[list[match.Phrase]], live: DataFrame, words: list[str], filters: Filters, pool: int, indexes: Indexes) -> DataFrame:
    """The steps of keyword_channel() one after another over written indexes, to the first that has hits."""
    columns = ("granularity", "id", "message_pk", "score", "rank")
    places = [] if chunks is None else [("chunk", indexes.chunks, chunks.select(F.col("chunk_id").alias("doc_id"), "message_pk"))]
    places.append(("message", indexes.messages, None))
    for phrases in plan:
        for name, index, of in places:
            allowed = live.select(F.col("message_pk").alias("doc_id")) if of is None else of.join(live, "message_pk", "left_semi").select("doc_id")
            hits = index.top(phrases, pool, allowed)
            if not hits.isEmpty():
                own = hits.withColumn("message_pk", F.col("doc_id")) if of is None else hits.join(of, "doc_id")
                return _ranked(own.select(F.lit(name).alias("granularity"), F.col("doc_id").alias("id"), "message_pk", "score"), [F.col("score"), F.col("id")], pool).select(*columns)
    found = _substrings(messages, words, filters) if words else _substrings(messages, [""], filters).where("false")
    return _ranked(found.withColumn("granularity", F.lit("message")), [F.col("score"), F.col("date_utc").desc_nulls_last(), F.col("id")], pool).select(*columns)


def vector_channel(messages: DataFrame, chunks: DataFrame, query_vector: list[float], filters: Filters = Filters(), pool: int = LIMIT * MULTIPLIER, least: float = 0.0, margin: float = 0.0) -> DataFrame:
    """granularity, id, message_pk, score, rank of the chunks nearest to the query among live messages that pass the
    filters, which come before the cut. chunks: chunk_id, message_pk, embedding."""
    allowed = messages.where(condition(filters)).select("message_pk")
    own = chunks.where(F.col("embedding").isNotNull()).join(allowed, "message_pk", "left_semi")
    best = top_k(own, query_vector, pool, "chunk_id").withColumnRenamed("chunk_id", "id")
    kept = threshold(best, least, margin).join(own.select(F.col("chunk_id").alias("id"), "message_pk"), "id")
    return _ranked(kept, [F.desc("score"), F.col("id")], pool).select(F.lit("chunk").alias("granularity"), "id", "message_pk", "score", "rank")


def rrf(rankings: dict[str, DataFrame], keys: list[str], k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """keys, score, and each channel's rank and score: reciprocal rank fusion of frames with rank and score. A channel of
    weight 0 or less is left out; one without a weight has 1."""
    weights = weights or {}
    own = {n: d for n, d in rankings.items() if weights.get(n, 1.0) > 0}
    if not own:
        any_one = next(iter(rankings.values()))
        return any_one.where("false").select(*keys, F.lit(0.0).alias("fused"))
    rows = None
    for n, d in own.items():
        part = d.select(*keys, F.lit(n).alias("channel"), (F.lit(float(weights.get(n, 1.0))) / (k + F.col("rank"))).alias("part"), "rank", "score")
        rows = part if rows is None else rows.unionByName(part)
    per = [f(F.when(F.col("channel") == n, F.col(c))).alias(f"{n}_{c}") for n in own for c, f in (("rank", F.min), ("score", F.min))]
    return rows.groupBy(*keys).agg(F.sum("part").alias("fused"), *per)


def hybrid(messages: DataFrame, chunks: DataFrame, query: str, query_vector: list[float], filters: Filters = Filters(), limit: int = LIMIT, mode: str = "hybrid", k: int = RRF_K, weights: dict[str, float] | None = None, least: float = 0.0, margin: float = 0.0, multiplier: int = MULTIPLIER, indexes: Indexes = Indexes()) -> DataFrame:
    """The best `limit` hits: fused, and how each channel ranks them. Ties: keyword hits first, by rank."""
    pool = max(limit * multiplier, limit)
    channels = {}
    if mode in ("hybrid", "keyword"):
        channels["keyword"] = keyword_channel(messages, chunks, query, filters, pool, indexes)
    if mode in ("hybrid", "vector"):
        channels["vector"] = vector_channel(messages, chunks, query_vector, filters, pool, least, margin)
    if not channels:
        raise ValueError(f"no mode {mode!r}")
    fused = rrf(channels, ["granularity", "id", "message_pk"], k, weights)
    order = [F.desc("fused"), *[F.col(f"{n}_rank").asc_nulls_last() for n in channels if f"{n}_rank" in fused.columns], F.col("id")]
    return fused.orderBy(*order).limit(limit)


def hydrate(hits: DataFrame, messages: DataFrame, chunks: DataFrame, query: str, length: int = 200) -> DataFrame:
    """Hits with their message, the sender as it is shown, the text they are in, and a snippet of it."""
    own = messages.select("message_pk", "message_id", "subject", "sender", "sender_name", "date_utc", "folder", "local_markdown_path", "body_text")
    texts = chunks.select(F.lit("chunk").alias("granularity"), F.col("chunk_id").alias("id"), "chunk_index", F.col("text").alias("chunk_text"))
    joined = own.join(F.broadcast(hits), "message_pk").join(texts, ["granularity", "id"], "left")  # hits are a page at most
    shown = F.when(F.coalesce("sender_name", F.lit("")) != "", F.concat("sender_name", F.lit(" <"), "sender", F.lit(">"))).otherwise(F.col("sender"))
    text = F.coalesce("chunk_text", "body_text")
    return joined.select("message_pk", "message_id", "subject", shown.alias("sender"), "date_utc", "folder", "local_markdown_path", *(c for c in hits.columns if c != "message_pk"), "chunk_index", snippet(text, match.terms(query), length).alias("snippet"))


def field_search(messages: DataFrame, query: str, scope: str, filters: Filters = Filters(), limit: int = LIMIT, indexes: Indexes = Indexes()) -> DataFrame:
    """message_pk, rank, score (1.0): messages with the query within one field. Subject, sender and recipient are looked up
    in the message index, body in the bodies' index, cc as substrings; substrings of the raw terms where that finds none."""
    live = messages.where(condition(filters))
    words = match.terms(query)
    like = live.where(all_terms(words, SCOPE_LIKE[scope]) if words else F.lit(False)).select("message_pk", F.lit(1 << 20).alias("step"), F.lit(0.0).alias("weight"), "date_utc")
    found, index = like, indexes.bodies if scope == "body" else indexes.messages
    if scope != "cc":
        columns, column = (["body_text"], None) if scope == "body" else (MESSAGE_COLUMNS, SCOPE_COLUMN[scope])
        hits = _hits(messages, "message_pk", columns, match.variants(query), index, column)
        found = hits.join(live.select(F.col("message_pk").alias("doc_id"), "date_utc"), "doc_id").select(F.col("doc_id").alias("message_pk"), F.col("variant").alias("step"), F.col("score").alias("weight"), "date_utc")
        if index is None or found.isEmpty():
            found = found.unionByName(like)
    first = found.agg(F.min("step").alias("first"))
    own = found.join(F.broadcast(first), F.col("step") == F.col("first"))
    return _ranked(own, [F.col("weight"), F.desc("date_utc"), F.col("message_pk")], limit).select("message_pk", "rank", F.lit(1.0).alias("score"))


#: Orders of a page of messages; the id settles ties.
ORDERS = {"date_desc": [F.desc, "date_utc", F.desc], "date_asc": [F.asc, "date_utc", F.asc], "subject": [F.asc, "subject", F.asc], "sender": [F.asc, "sender", F.asc]}
LISTED = ["message_pk", "account", "folder", "uid", "message_id", "subject", "sender", "sender_name", "recipients", "cc", "date_utc", "size_bytes", "has_attachments", "local_markdown_path", "indexed_at", "duplicate_of"]


def page(messages: DataFrame, filters: Filters = Filters(), limit: int = 50, offset: int = 0, order: str = "date_desc") -> DataFrame:
    """A page of messages without their bodies. `total` is the number of all that pass."""
    own = messages.where(condition(filters)).select(*[c for c in LISTED if c in messages.columns])
    way, column, tie = ORDERS.get(order, ORDERS["date_desc"])
    total = own.agg(F.count("*").alias("total"))
    return own.orderBy(way(column), tie("message_pk")).offset(offset).limit(limit).join(F.broadcast(total))


def folder_statistics(messages: DataFrame) -> DataFrame:
    return messages.groupBy("account", "folder").agg(F.count("*").alias("total"), F.count_if(F.col("deleted_at").isNull()).alias("live"), F.max("date_utc").alias("latest"))


def resolve(messages: DataFrame, reference: str) -> DataFrame:
    """The one message that a number or a Message-ID (with or without <>) names: numbers are ids first."""
    bare = reference.strip().strip("<>")
    as_id = F.when(F.lit(bare.isdigit()) & (F.col("message_pk") == F.lit(bare if bare.isdigit() else "-1").cast("long")), 0)
    rank = F.coalesce(as_id, F.when(F.col("message_id") == bare, 1), F.when(F.col("message_id") == reference, 2))
    return messages.withColumn("__rank", rank).where("__rank is not null").orderBy("__rank", "message_pk").limit(1).drop("__rank")


def sort_rows(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Texts sort without regard to case."""
    key = F.lower(column) if dict(rows.dtypes)[column] == "string" else F.col(column)
    return rows.orderBy(key.desc() if descending else key.asc())


def like_search(messages: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """Messages with all terms as substrings of subject or body, the newest first."""
    words = [t for t in match.terms(query) if len(t) >= LEAST_TERM]
    own = messages.where(F.col("deleted_at").isNull() & (all_terms(words, ["subject", "body_text"]) if words else F.lit(False)))
    return own.orderBy(F.desc("date_utc"), "message_pk").limit(limit).select("message_pk", "subject", "date_utc", F.lit(0.0).alias("score"))


__all__ = ["contains", "field_search", "folder_statistics", "hybrid", "hydrate", "keyword_channel", "like_search", "page", "resolve", "rrf", "sort_rows", "vector_channel"]
