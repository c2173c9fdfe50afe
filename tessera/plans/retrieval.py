"""Queries of keyword, vector and hybrid retrieval, filters, lists and statistics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions.embedding import hashing, embed
from tessera.functions.text import snippet
from tessera.operators import match, search, table_functions, vectors
from tessera.operators.cell_store import CellStore
from tessera.operators.filters import Filters, all_terms, condition, pending_index
from tessera.operators.match import Phrase
from tessera.operators.paging import SortedPages
from tessera.operators.postings import keyword_hits
from tessera.operators.keyword_index import KeywordIndex
from tessera.plans.views import MESSAGES, QUERY_VECTOR, Catalog, bm25_sql, keyword_index, messages, query_vector, table, tokens_sql
from tessera.plans.views import vectors as vector_table
from tessera.sources.scratch import fresh_path

CATALOG = Catalog()
query = CATALOG.add

TOP = 50


def documents_index(spark, sf_dir):
    return keyword_index(spark, sf_dir, "documents", "doc_id", ["text", "source"], lambda: table(spark, sf_dir, "documents"))


def indexes(spark, sf_dir, chunks=True):
    """The indexes that an archive of these messages keeps; that of chunks where it is asked for."""
    return search.Indexes(
        keyword_index(spark, sf_dir, "messages", "message_pk", search.MESSAGE_COLUMNS, lambda: messages(spark, sf_dir)),
        keyword_index(spark, sf_dir, "chunks", "chunk_id", search.CHUNK_COLUMNS, lambda: _text_chunks(spark, sf_dir)) if chunks else None,
    )


@query("SELECT count(*) AS n, CAST(sum(len(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) + len(regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+'))) AS BIGINT) AS tokens FROM documents")
def keyword_index_build(spark, sf_dir):
    """All indexes that other queries read are written, where this session has not done so yet."""
    indexes(spark, sf_dir)
    n, tokens = documents_index(spark, sf_dir).counts()
    return spark.createDataFrame([(n, tokens)], "n long, tokens long")


def _bm25(plan, column=None, columns=("text", "source")):
    def run(spark, sf_dir):
        hits = documents_index(spark, sf_dir).hits(plan, column)
        return hits.select("doc_id", F.round("score", 6).alias("score"))

    sql = f"WITH {tokens_sql('documents', 'doc_id', list(columns))},\n{bm25_sql(plan, column)}\nSELECT doc_id, round(score, 6) AS score FROM hits"
    return run, sql


def _register(name, plan, **options):
    run, sql = _bm25(plan, **options)
    run.__name__ = name
    query(sql)(run)


_register("bm25_term", [[Phrase(("licensed",), False)]])
_register("bm25_multi_and", [match.strict("license version", prefix=False)])
_register("bm25_prefix", [match.strict("licen")])
_register("bm25_phrase", [[Phrase(("licensed", "under", "the"), False)]])
_register("bm25_phrase_prefix", [[Phrase(("gnu", "gen"), True), Phrase(("this", "work"), False)]])
_register("bm25_column_scope", [[Phrase(("src3",), False)]], column="source")


def _table_function(name, text, prefix, columns=("text", "source")):
    """The same without an index, as a function of a table that SQL calls."""
    plan = match.strict(text, prefix)

    def run(spark, sf_dir):
        table_functions.register(spark)
        table(spark, sf_dir, "documents").createOrReplaceTempView("searched_documents")
        return spark.sql(table_functions.bm25_statement("searched_documents", text, list(columns), prefix)).select("doc_id", F.round("score", 6).alias("score"))

    run.__name__ = name
    query(f"WITH {tokens_sql('documents', 'doc_id', list(columns))},\n{bm25_sql([plan])}\nSELECT doc_id, round(score, 6) AS score FROM hits")(run)


_table_function("bm25_table_and", "license version", False)
_table_function("bm25_table_prefix", "licen wi", True)
_table_function("bm25_table_one_column", "licensed gnu", True, columns=("text",))


def _top(name, text, prefix, n=20):
    """The best rows only, of a term that very many have, of two such, of a beginning of words."""
    plan = match.strict(text, prefix)

    def run(spark, sf_dir):
        hits = documents_index(spark, sf_dir).top(plan, n)
        return hits.select("doc_id", F.round("score", 6).alias("score"))

    run.__name__ = name
    query(f"WITH {tokens_sql('documents', 'doc_id', ['text', 'source'])},\n{bm25_sql([plan])}\nSELECT doc_id, round(score, 6) AS score FROM hits ORDER BY hits.score, doc_id LIMIT {n}")(run)


_top("bm25_top_common", "with", False)
_top("bm25_top_common_and", "this with", False)
_top("bm25_top_prefix", "licen wi", True)

RELAXED = [[Phrase(("licensed", "under", "the", "nowhere"), False)], [Phrase(("licensed", "under", "the"), False)], [Phrase(("licensed", "under"), False)]]


@query(f"WITH {tokens_sql('documents', 'doc_id', ['text'])},\n{bm25_sql(RELAXED)}\nSELECT variant, doc_id, round(score, 6) AS score FROM hits WHERE variant = (SELECT min(variant) FROM hits)")
def relaxed_variants(spark, sf_dir):
    """The first plan that finds anything counts."""
    hits = keyword_hits(table(spark, sf_dir, "documents"), "doc_id", ["text"], RELAXED)
    first = hits.agg(F.min("variant").alias("first"))
    return hits.join(F.broadcast(first), F.col("variant") == F.col("first")).select("variant", "doc_id", F.round("score", 6).alias("score"))


KEYWORD = "licensed gnu"
_PLAN = match.variants(KEYWORD)
_KEYWORD_CTES = f"""{MESSAGES},
{tokens_sql("messages", "message_pk", search.MESSAGE_COLUMNS)},
{bm25_sql(_PLAN)},
keyword AS (
  SELECT message_pk, score, row_number() OVER (ORDER BY score, message_pk) AS rank FROM hits JOIN messages ON message_pk = doc_id
  WHERE deleted_at IS NULL ORDER BY score, message_pk LIMIT 100)"""


@query(f"WITH {_KEYWORD_CTES} SELECT message_pk, round(score, 6) AS score, rank FROM keyword")
def keyword_channel(spark, sf_dir):
    out = search.keyword_channel(messages(spark, sf_dir), None, KEYWORD, indexes=indexes(spark, sf_dir, False))
    return out.select("message_pk", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_KEYWORD_CTES} SELECT message_pk, round(score, 6) AS score, rank FROM keyword")
def keyword_channel_scan(spark, sf_dir):
    """The same without an index: texts are scanned."""
    out = search.keyword_channel(messages(spark, sf_dir), None, KEYWORD)
    return out.select("message_pk", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_KEPT = "own AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || ' licensed' ELSE text END AS text, source FROM documents WHERE doc_id % 7 <> 0)"


@query(f"WITH {_KEPT},\n{tokens_sql('own', 'doc_id', ['text', 'source'])},\n{bm25_sql([match.strict('licensed version', prefix=False), match.strict('src3 licen')])}\nSELECT variant, doc_id, round(score, 6) AS score FROM hits")
def keyword_index_kept_up(spark, sf_dir):
    """An index after three changes: all rows come in, a third of them with a new text, and a seventh goes."""
    own = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    index = KeywordIndex(spark, fresh_path(spark, "index-kept"), "doc_id", ["text", "source"])
    index.add(own)
    index.add(own.where("doc_id % 3 = 0").withColumn("text", F.concat("source", F.lit(" licensed"))))
    index.remove(own.where("doc_id % 7 = 0"))
    return index.hits([match.strict("licensed version", prefix=False), match.strict("src3 licen")]).select("variant", "doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {MESSAGES} SELECT message_pk, subject, date_utc, 0.0 AS score FROM messages WHERE deleted_at IS NULL AND (subject ILIKE '%version%' OR body_text ILIKE '%version%') AND (subject ILIKE '%public%' OR body_text ILIKE '%public%') ORDER BY date_utc DESC, message_pk LIMIT 20")
def like_fallback(spark, sf_dir):
    return search.like_search(messages(spark, sf_dir), "version public").withColumn("score", F.col("score").cast("decimal(2,1)"))


@query("SELECT c_custkey, c_name FROM customer WHERE (c_name ILIKE '%01%' OR c_mktsegment ILIKE '%01%') AND (c_name ILIKE '%build%' OR c_mktsegment ILIKE '%build%')")
def field_like_multi_term(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(all_terms(["01", "build"], ["c_name", "c_mktsegment"])).select("c_custkey", "c_name")


_FIELD_PLAN = [match.strict("src3")]


@query(f"WITH {MESSAGES},\n{tokens_sql('messages', 'message_pk', search.MESSAGE_COLUMNS)},\n{bm25_sql(_FIELD_PLAN, 'sender')}\nSELECT message_pk, row_number() OVER (ORDER BY score, date_utc DESC, message_pk) AS rank, CAST(1 AS DOUBLE) AS score FROM (SELECT message_pk, score, date_utc FROM hits JOIN messages ON message_pk = doc_id WHERE deleted_at IS NULL ORDER BY score, date_utc DESC, message_pk LIMIT 20)")
def field_scope_sender(spark, sf_dir):
    out = search.field_search(messages(spark, sf_dir), "src3", "sender", indexes=indexes(spark, sf_dir, False))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {MESSAGES} SELECT message_pk, row_number() OVER (ORDER BY date_utc DESC, message_pk) AS rank, CAST(1 AS DOUBLE) AS score FROM (SELECT * FROM messages WHERE deleted_at IS NULL AND recipients ILIKE '%example%' AND recipients ILIKE '%org%' ORDER BY date_utc DESC, message_pk LIMIT 20)")
def field_scope_like(spark, sf_dir):
    """A scope whose index finds nothing for the phrase falls back to substrings."""
    own = messages(spark, sf_dir).withColumn("cc", F.col("recipients"))
    out = search.field_search(own, "example org", "cc")
    return out.withColumn("rank", F.col("rank").cast("long"))


_FILTERS = Filters(folder=("src0", "src3"), sender="EXAMPLE.com", subject="the", date_from=datetime(2024, 1, 2), date_to=datetime(2024, 3, 1), has_attachments=True)
_WHERE = "deleted_at IS NULL AND folder IN ('src0', 'src3') AND (sender ILIKE '%EXAMPLE.com%' OR sender_name ILIKE '%EXAMPLE.com%') AND subject ILIKE '%the%' AND date_utc >= TIMESTAMP '2024-01-02' AND date_utc <= TIMESTAMP '2024-03-01' AND has_attachments"


@query(f"WITH {MESSAGES} SELECT message_pk, folder, subject, date_utc, size_bytes FROM messages WHERE {_WHERE}")
def composite_filter(spark, sf_dir):
    return messages(spark, sf_dir).where(condition(_FILTERS)).select("message_pk", "folder", "subject", "date_utc", "size_bytes")


_LISTED = "message_pk, account, folder, uid, message_id, subject, sender, sender_name, recipients, cc, date_utc, size_bytes, has_attachments, local_markdown_path, indexed_at"


def _page(order_sql, **options):
    def run(spark, sf_dir):
        return search.page(messages(spark, sf_dir), limit=25, offset=30, **options).drop("duplicate_of")

    return run, f"WITH {MESSAGES}, own AS (SELECT {_LISTED} FROM messages WHERE deleted_at IS NULL) SELECT *, (SELECT count(*) FROM own) AS total FROM own ORDER BY {order_sql} LIMIT 25 OFFSET 30"


for _name, _order, _sql in (("list_page_date_desc", "date_desc", "date_utc DESC, message_pk DESC"), ("list_page_date_asc", "date_asc", "date_utc, message_pk"), ("list_sorted_by_subject", "subject", "subject, message_pk"), ("list_sorted_by_sender", "sender", "sender, message_pk")):
    _run, _text = _page(_sql, order=_order)
    _run.__name__ = _name
    query(_text)(_run)


@query(f"WITH {MESSAGES} SELECT account, folder, count(*) AS total, count(*) FILTER (deleted_at IS NULL) AS live, max(date_utc) AS latest FROM messages GROUP BY account, folder")
def folder_statistics(spark, sf_dir):
    return search.folder_statistics(messages(spark, sf_dir))


@query(f"WITH {MESSAGES} SELECT count(*) AS messages, count(*) FILTER (deleted_at IS NULL) AS live, (SELECT count(*) FROM embeddings) AS vectors, count(*) FILTER (deleted_at IS NULL AND (indexed_at IS NULL OR indexed_at < updated_at)) AS pending FROM messages")
def corpus_counts(spark, sf_dir):
    own = messages(spark, sf_dir).agg(F.count("*").alias("messages"), F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(pending_index()).alias("pending"))
    return own.join(F.broadcast(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors")))).select("messages", "live", "vectors", "pending")


@query(f"WITH {MESSAGES} SELECT folder, count(*) AS pending FROM messages WHERE deleted_at IS NULL AND (indexed_at IS NULL OR indexed_at < updated_at) GROUP BY folder")
def pending_index_count(spark, sf_dir):
    return messages(spark, sf_dir).where(pending_index()).groupBy("folder").agg(F.count("*").alias("pending"))


@query(f"WITH {MESSAGES}, live AS (SELECT message_pk, subject, folder, date_utc FROM messages WHERE deleted_at IS NULL) SELECT message_pk, subject, folder FROM live WHERE (date_utc, message_pk) < (SELECT (date_utc, message_pk) FROM live ORDER BY date_utc DESC, message_pk DESC LIMIT 1 OFFSET 39) ORDER BY date_utc DESC, message_pk DESC LIMIT 20")
def list_page_keyset(spark, sf_dir):
    """The third page of twenty, each after the last row of the one before, over a sorted copy."""
    own = SortedPages(spark, fresh_path(spark, "pages"))
    own.build(messages(spark, sf_dir).select("message_pk", "subject", "folder", "date_utc", "deleted_at"))
    page = own.page(20, None, F.col("deleted_at").isNull())
    for _ in range(2):
        page = own.page(20, page.next, F.col("deleted_at").isNull())
    return page.rows.select("message_pk", "subject", "folder")


@query(f"WITH {MESSAGES} SELECT message_pk, subject, folder FROM messages WHERE message_pk = 42")
def resolve_reference(spark, sf_dir):
    return search.resolve(messages(spark, sf_dir), "<doc-42@corpus>").select("message_pk", "subject", "folder")


_SCORED = f"{QUERY_VECTOR}, s AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q)"


@query(f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT {TOP}")
def vector_topk(spark, sf_dir):
    out = vectors.top_k(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), TOP)
    return out.select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED} SELECT vec_id, round(score, 6) AS score FROM s WHERE label IN (1, 2) ORDER BY score DESC, vec_id LIMIT {TOP}")
def vector_topk_filtered(spark, sf_dir):
    out = vectors.top_k(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), TOP, where=F.col("label").isin(1, 2))
    return out.select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SCORED}, t AS (SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT {TOP}) SELECT vec_id, round(score, 6) AS score FROM t WHERE score >= greatest(0.1, (SELECT max(score) FROM t) - 0.8)")
def vector_threshold_margin(spark, sf_dir):
    out = vectors.threshold(vectors.top_k(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), TOP), 0.1, 0.8)
    return out.select("vec_id", F.round("score", 6).alias("score"))


@query("""WITH p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def vector_batch_topk(spark, sf_dir):
    """Every stored vector as a query."""
    own = table(spark, sf_dir, "embeddings")
    out = vectors.batch_top_k(own, own.select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return out.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


_CELLS: dict[tuple[str, str], CellStore] = {}


def cell_store(spark, sf_dir):
    """All vectors in cells on disk, made when a session first asks for it."""
    place = spark.sparkContext.applicationId, sf_dir
    if place not in _CELLS:
        own = CellStore(spark, fresh_path(spark, "cells"))
        own.upsert(vector_table(spark, sf_dir).select("chunk_id", F.lit("m").alias("model"), "message_pk", "embedding"))
        _CELLS[place] = own
    return _CELLS[place]


def _asked(spark, sf_dir):
    """Every fiftieth vector as a query."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _asked_sql(rows="embeddings"):
    return f"""WITH p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, {rows} c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 20"""


@query()
def ann_topk(spark, sf_dir):
    """The 20 nearest of each query in the cells that it probes; tests and ann_recall hold it against all rows."""
    out = cell_store(spark, sf_dir).queries(_asked(spark, sf_dir), 20)
    return out.select("query_id", F.col("chunk_id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query(_asked_sql())
def ann_topk_all_cells(spark, sf_dir):
    """With all cells probed it is the exact search."""
    own = cell_store(spark, sf_dir)
    return own.queries(_asked(spark, sf_dir), 20, len(own.centres())).select("query_id", F.col("chunk_id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@query("SELECT count(*) FILTER (vec_id % 50 = 0) AS queries, TRUE AS recalled, TRUE AS skipped FROM embeddings")
def ann_recall(spark, sf_dir):
    """Whether the probed cells have nine tenths of the exact hits, and whether they are fewer than there are."""
    own = cell_store(spark, sf_dir)
    found = own.recall(_asked(spark, sf_dir), 20).agg(F.count("*").alias("queries"), (F.sum("found") >= 0.9 * F.sum("there")).alias("recalled"))
    return found.withColumn("skipped", F.lit(own.probes() < len(own.centres())))


@query(_asked_sql("(SELECT vec_id, CASE WHEN vec_id % 3 = 1 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 7 <> 2)"))
def ann_kept_up(spark, sf_dir):
    """Cells after a change of a third of the vectors, which move to others, and after a seventh goes; all cells probed."""
    rows = vector_table(spark, sf_dir).select("chunk_id", F.lit("m").alias("model"), "message_pk", "embedding")
    own = CellStore(spark, fresh_path(spark, "cells-kept"))
    own.upsert(rows)
    own.upsert(rows.where("chunk_id % 3 = 1").withColumn("embedding", F.reverse("embedding")))
    own.delete(rows.where("chunk_id % 7 = 2").select("chunk_id"))
    return own.queries(_asked(spark, sf_dir), 20, len(own.centres())).select("query_id", F.col("chunk_id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


_VECTOR_CTES = f"""{QUERY_VECTOR},
vector AS (
  SELECT vec_id AS message_pk, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT vec_id, list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q
    WHERE vec_id IN (SELECT message_pk FROM messages WHERE deleted_at IS NULL) ORDER BY score DESC, vec_id LIMIT 100))"""
_FUSED = "SELECT message_pk, sum({w}) AS fused, min(rank) FILTER (c = 'keyword') AS keyword_rank, min(rank) FILTER (c = 'vector') AS vector_rank FROM (SELECT 'keyword' AS c, * FROM keyword UNION ALL SELECT 'vector', * FROM vector) {where} GROUP BY message_pk"


def _channels(spark, sf_dir):
    own = messages(spark, sf_dir)
    keyword = search.keyword_channel(own, None, KEYWORD, indexes=indexes(spark, sf_dir, False))
    vector = search.vector_channel(own, vector_table(spark, sf_dir), query_vector(spark, sf_dir))
    return {"keyword": keyword, "vector": vector}


def _fused(name, weights, w, where=""):
    def run(spark, sf_dir):
        out = search.rrf(_channels(spark, sf_dir), ["message_pk"], weights=weights)
        ranks = [F.col(f"{c}_rank").cast("long").alias(f"{c}_rank") if f"{c}_rank" in out.columns else F.lit(None).cast("long").alias(f"{c}_rank") for c in ("keyword", "vector")]
        return out.select("message_pk", F.round("fused", 6).alias("fused"), *ranks)

    run.__name__ = name
    inner = _FUSED.format(w=w, where=where)
    query(f"WITH {_KEYWORD_CTES}, {_VECTOR_CTES} SELECT message_pk, round(fused, 6) AS fused, keyword_rank, vector_rank FROM ({inner})")(run)


_fused("rrf_fusion", None, "1.0 / (60 + rank)")
_fused("rrf_weighted", {"keyword": 2.0, "vector": 0.5}, "CASE c WHEN 'keyword' THEN 2.0 ELSE 0.5 END / (60 + rank)")
_fused("rrf_zero_weight", {"vector": 0.0}, "1.0 / (60 + rank)", "WHERE c = 'keyword'")


@query(f"WITH {_KEYWORD_CTES}, {_VECTOR_CTES} SELECT message_pk, round(sum(CASE c WHEN 'keyword' THEN 2.0 ELSE 0.5 END / (60 + rank)), 6) AS fused FROM (SELECT 'keyword' AS c, * FROM keyword UNION ALL SELECT 'vector', * FROM vector) GROUP BY message_pk")
def rrf_aggregate(spark, sf_dir):
    """Fusion by the aggregate that SQL can call."""
    table_functions.register(spark)
    for name, rows in _channels(spark, sf_dir).items():
        rows.createOrReplaceTempView(f"ranked_by_{name}")
    return spark.sql("SELECT message_pk, round(rrf(rank, weight), 6) AS fused FROM (SELECT message_pk, rank, 2.0D AS weight FROM ranked_by_keyword UNION ALL SELECT message_pk, rank, 0.5D FROM ranked_by_vector) GROUP BY message_pk")


def _text_chunks(spark, sf_dir):
    """One chunk a message, which has its body and its vector if there is one."""
    own = messages(spark, sf_dir).select("message_pk", "subject", "sender", F.col("body_text").alias("text"))
    return own.join(vector_table(spark, sf_dir), "message_pk", "left").select(F.col("message_pk").alias("chunk_id"), "message_pk", F.lit(0).alias("chunk_index"), "text", "subject", "sender", "embedding")


@query(f"""WITH {MESSAGES},
chunks AS (SELECT message_pk, body_text AS text, subject, sender FROM messages),
{tokens_sql("chunks", "message_pk", search.CHUNK_COLUMNS)},
{bm25_sql(_PLAN)},
keyword AS (
  SELECT message_pk, score, row_number() OVER (ORDER BY score, message_pk) AS rank FROM hits JOIN messages ON message_pk = doc_id
  WHERE deleted_at IS NULL ORDER BY score, message_pk LIMIT 100),
{_VECTOR_CTES},
fused AS ({_FUSED.format(w="1.0 / (60 + rank)", where="")})
SELECT message_pk, folder, subject, round(fused, 6) AS fused, keyword_rank, vector_rank FROM fused JOIN messages USING (message_pk)
ORDER BY fused.fused DESC, keyword_rank NULLS LAST, vector_rank NULLS LAST, message_pk LIMIT 20""")
def hybrid_search(spark, sf_dir):
    """The flagship: keyword and vector channels fused, with their messages."""
    own, chunks = messages(spark, sf_dir), _text_chunks(spark, sf_dir)
    hits = search.hybrid(own, chunks, KEYWORD, query_vector(spark, sf_dir), indexes=indexes(spark, sf_dir))
    return own.select("message_pk", "folder", "subject").join(F.broadcast(hits), "message_pk").select("message_pk", "folder", "subject", F.round("fused", 6).alias("fused"), F.col("keyword_rank").cast("long").alias("keyword_rank"), F.col("vector_rank").cast("long").alias("vector_rank"))


_TERM = "licensed"


@query(f"""WITH {MESSAGES},
f AS (SELECT message_pk, trim(regexp_replace(body_text, '\\s+', ' ', 'g')) AS t FROM messages WHERE body_text IS NOT NULL),
p AS (SELECT *, length(t) AS n, instr(t, '{_TERM}') - 1 AS hit FROM f),
b AS (SELECT *, greatest(0, least(n, greatest(0, hit - 100) + 200) - 200) AS b FROM p)
SELECT message_pk, CASE WHEN n <= 200 THEN t WHEN hit < 0 THEN rtrim(substr(t, 1, 200)) || '…'
  ELSE (CASE WHEN b > 0 THEN '…' ELSE '' END) || trim(substr(t, b + 1, 200)) || (CASE WHEN b + 200 < n THEN '…' ELSE '' END) END AS snippet
FROM b""")
def snippet_centered(spark, sf_dir):
    own = messages(spark, sf_dir).where(F.col("body_text").isNotNull())
    return own.select("message_pk", snippet("body_text", [_TERM]).alias("snippet"))


@query(f"""WITH {MESSAGES}, top AS (
  SELECT message_pk, row_number() OVER (ORDER BY date_utc DESC, message_pk) AS rank FROM messages WHERE deleted_at IS NULL AND body_text ILIKE '%{_TERM}%' ORDER BY date_utc DESC, message_pk LIMIT 20)
SELECT message_pk, message_id, subject, sender_name || ' <' || sender || '>' AS sender, date_utc, folder, local_markdown_path, rank FROM top JOIN messages USING (message_pk)""")
def hydrate_hits(spark, sf_dir):
    own = messages(spark, sf_dir)
    top = search.like_search(own.withColumn("subject", F.lit("")), _TERM).select("message_pk")
    ranked = own.join(F.broadcast(top), "message_pk").select("message_pk", "date_utc")
    hits = search._ranked(ranked, [F.desc("date_utc"), F.col("message_pk")], 20).select(F.lit("message").alias("granularity"), F.col("message_pk").alias("id"), "message_pk", F.col("rank").cast("long").alias("rank"))
    return search.hydrate(hits, own, _text_chunks(spark, sf_dir), _TERM).select("message_pk", "message_id", "subject", "sender", "date_utc", "folder", "local_markdown_path", "rank")


@query("""WITH p AS (
  SELECT q.vec_id, q.label, max(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])) AS score FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id GROUP BY ALL),
k AS (SELECT CASE WHEN label = 0 THEN 'relevant' ELSE 'irrelevant' END AS kind, score FROM p),
f AS (SELECT min(score) FILTER (kind = 'relevant') AS relevant_min, median(score) FILTER (kind = 'relevant') AS relevant_median, max(score) FILTER (kind = 'relevant') AS relevant_max,
  min(score) FILTER (kind = 'irrelevant') AS irrelevant_min, median(score) FILTER (kind = 'irrelevant') AS irrelevant_median, max(score) FILTER (kind = 'irrelevant') AS irrelevant_max FROM k)
SELECT round(relevant_min, 6) AS relevant_min, round(relevant_median, 6) AS relevant_median, round(relevant_max, 6) AS relevant_max, round(irrelevant_min, 6) AS irrelevant_min,
  round(irrelevant_median, 6) AS irrelevant_median, round(irrelevant_max, 6) AS irrelevant_max, relevant_min > irrelevant_max AS separable,
  round(CASE WHEN relevant_min > irrelevant_max THEN (relevant_min + irrelevant_max) / 2 ELSE relevant_median END, 6) AS suggested FROM f""")
def calibration_summary(spark, sf_dir):
    """Each vector's nearest other; vectors of label 0 stand for relevant queries."""
    own = table(spark, sf_dir, "embeddings")
    best = vectors.batch_top_k(own, own.select(F.col("vec_id").alias("query_id"), "embedding"), 2).where("query_id != vec_id")
    tops = best.groupBy("query_id").agg(F.max("score").alias("score"))
    kinds = own.select(F.col("vec_id").alias("query_id"), F.when(F.col("label") == 0, "relevant").otherwise("irrelevant").alias("kind"))
    out = vectors.calibration(tops.join(kinds, "query_id"))
    numbers = [f"{k}_{m}" for k in ("relevant", "irrelevant") for m in ("min", "median", "max")]
    return out.select(*[F.round(c, 6).alias(c) for c in numbers], "separable", F.round("suggested", 6).alias("suggested"))


@query()
def embed_topk_text(spark, sf_dir):
    """Documents nearest to a text by the hashing embedder, over its whole table."""
    from tessera.functions.embedding import hashed

    own = table(spark, sf_dir, "documents").withColumn("embedding", embed("text", hashing(128)))
    return vectors.top_k(own, hashed("licensed under the general public license", 128), 20, "doc_id").select("doc_id", F.round("score", 6).alias("score"))
