"""Queries of set operations over the driver's tables: merges, folders, cascades, statistics, reuse and incremental indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.chunking import ChunkPolicy
from tessera.functions.embedding import hashing
from tessera.operators import blobs, filters, incremental, search, sync, vectors
from tessera.operators.filters import Filters
from tessera.plans.views import MESSAGES, QUERY_VECTOR, Catalog, messages, query_vector, table
from tessera.plans.views import vectors as vector_table
from tessera.sources.scratch import fresh_path

CATALOG = Catalog()
query = CATALOG.add

_FOLDERS = "account, name, delimiter, uidvalidity, last_uid, selectable"


@query(f"""WITH a AS (SELECT lang AS account, source AS name, '/' AS delimiter, CAST(1 AS BIGINT) AS uidvalidity, max(doc_id) AS last_uid, TRUE AS selectable FROM documents WHERE doc_id % 2 = 0 AND source <> 'src1' GROUP BY ALL),
b AS (SELECT lang AS account, source AS name, '.' AS delimiter, CAST(2 AS BIGINT) AS uidvalidity, CAST(0 AS BIGINT) AS last_uid, lang <> 'de' AS selectable FROM documents WHERE n_chars > 1500 AND source <> 'src2' GROUP BY ALL)
SELECT coalesce(a.account, b.account) AS account, coalesce(a.name, b.name) AS name, coalesce(b.delimiter, a.delimiter) AS delimiter, coalesce(b.uidvalidity, a.uidvalidity) AS uidvalidity, coalesce(a.last_uid, b.last_uid) AS last_uid, coalesce(b.selectable, a.selectable) AS selectable
FROM a FULL JOIN b ON a.account = b.account AND a.name = b.name""")
def upsert_folder(spark, sf_dir):
    """A folder's watermark stays, what the server says of it changes."""
    own = table(spark, sf_dir, "documents")
    current = own.where("doc_id % 2 = 0 and source != 'src1'").groupBy(F.col("lang").alias("account"), F.col("source").alias("name")).agg(F.max("doc_id").alias("last_uid")).selectExpr("account", "name", "'/' AS delimiter", "1L AS uidvalidity", "last_uid", "true AS selectable")
    incoming = own.where("n_chars > 1500 and source != 'src2'").select(F.col("lang").alias("account"), F.col("source").alias("name")).distinct().selectExpr("account", "name", "'.' AS delimiter", "2L AS uidvalidity", "0L AS last_uid", "account != 'de' AS selectable")
    return sync.upsert_folders(current, incoming).select(_FOLDERS.split(", "))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 0 THEN CAST(0 AS DOUBLE) ELSE c_acctbal END AS c_acctbal FROM customer""")
def partial_update(spark, sf_dir):
    """Only what a change gives is taken."""
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = own.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "renamed").alias("c_name"), F.when(F.col("c_acctbal") > 0, 0.0).alias("c_acctbal"))
    return sync.partial_update(own, changes, ["c_custkey"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 1, -o_orderkey FROM orders WHERE o_orderkey % 5 = 0 AND o_orderstatus <> 'F'""")
def replace_chunks(spark, sf_dir):
    """Every fifth order's lines are replaced as a whole, by one line or by none."""
    current = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parents = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0")
    fresh = parents.where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (-F.col("o_orderkey")).alias("l_partkey"))
    return sync.replace_children(current, fresh, "l_orderkey", parents.select(F.col("o_orderkey").alias("l_orderkey")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def referential_cascade(spark, sf_dir):
    return sync.cascade(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query(f"WITH {MESSAGES} SELECT vec_id AS chunk_id, label FROM embeddings WHERE vec_id NOT IN (SELECT message_pk FROM messages WHERE deleted_at IS NOT NULL)")
def remove_message(spark, sf_dir):
    """The vectors of deleted messages go with them."""
    return incremental.removed(vector_table(spark, sf_dir), messages(spark, sf_dir).where("deleted_at is not null")).select("chunk_id", "label")


@query("""WITH c AS (SELECT vec_id AS chunk_id, 'old' AS model, label FROM embeddings WHERE vec_id % 2 = 0), n AS (
  SELECT vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'old' ELSE 'new' END AS model, label + 100 AS label FROM embeddings WHERE vec_id % 5 = 0)
SELECT coalesce(c.chunk_id, n.chunk_id) AS chunk_id, coalesce(c.model, n.model) AS model, coalesce(n.label, c.label) AS label FROM c FULL JOIN n ON c.chunk_id = n.chunk_id AND c.model = n.model""")
def upsert_vector(spark, sf_dir):
    """One row a chunk and model, the newest."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    current = own.where("chunk_id % 2 = 0").selectExpr("chunk_id", "'old' AS model", "label", "0 AS updated_at")
    fresh = own.where("chunk_id % 5 = 0").selectExpr("chunk_id", "CASE WHEN chunk_id % 3 = 0 THEN 'old' ELSE 'new' END AS model", "label + 100 AS label", "1 AS updated_at")
    return sync.upsert(current, fresh, ["chunk_id", "model"], revive=None).select("chunk_id", "model", "label")


@query("""WITH f AS (SELECT s_suppkey, CAST(s_nationkey % 3 AS BIGINT) AS uidvalidity, s_suppkey % 4 AS last_uid FROM supplier),
s AS (SELECT s_suppkey, CAST(s_nationkey % 2 AS BIGINT) AS epoch, CAST(s_nationkey % 5 AS BIGINT) AS messages FROM supplier WHERE s_suppkey % 7 <> 0),
j AS (SELECT f.*, epoch, messages, coalesce(uidvalidity, 0) <> 0 AND coalesce(epoch, 0) <> 0 AND uidvalidity <> epoch AS reset FROM f LEFT JOIN s USING (s_suppkey)),
t AS (SELECT *, CASE WHEN reset THEN 0 ELSE last_uid END AS start_uid FROM j)
SELECT s_suppkey, reset, start_uid, CASE WHEN messages IS NULL THEN 'unknown' WHEN messages <= 0 THEN 'none' WHEN start_uid <= 0 THEN 'all' ELSE 'newer' END AS request FROM t""")
def plan_folders(spark, sf_dir):
    """A changed epoch starts anew, an empty folder lists nothing, an unknown one is left alone. Suppliers stand for folders."""
    own = table(spark, sf_dir, "supplier").select(F.lit("a").alias("account"), F.col("s_name").alias("name"), "s_suppkey", "s_nationkey")
    folders = own.select("account", "name", "s_suppkey", (F.col("s_nationkey") % 3).cast("long").alias("uidvalidity"), (F.col("s_suppkey") % 4).alias("last_uid"))
    status = own.where("s_suppkey % 7 != 0").select("account", "name", (F.col("s_nationkey") % 2).cast("long").alias("epoch"), (F.col("s_nationkey") % 5).cast("long").alias("messages"))
    return sync.plan_folders(folders, status).select("s_suppkey", "reset", F.col("start_uid").cast("long").alias("start_uid"), "request")


@query("SELECT o_orderkey, o_orderkey % 10 = 0 OR o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 24 HOUR AS due FROM orders")
def reconcile_due(spark, sf_dir):
    """Orders stand for folders, their dates for the last whole scan."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("timestamp")).alias("last_full_scan_at"))
    return own.select("o_orderkey", sync.reconcile_due(now=F.lit("1998-01-01").cast("timestamp")).alias("due"))


@query("""SELECT * FROM (VALUES ('FRANCE', 0, TRUE), ('nowhere', 1, FALSE), ('CHINA', 3, TRUE)) AS t(name, position, found) WHERE name = 'nowhere' OR name IN (SELECT n_name FROM nation)
UNION ALL SELECT name, position, FALSE FROM (VALUES ('FRANCE', 0), ('CHINA', 3)) AS t(name, position) WHERE name NOT IN (SELECT n_name FROM nation)""")
def select_folders(spark, sf_dir):
    """What is asked for in its order, without what is excluded in any case; what is not there is told."""
    available = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(True).alias("selectable"))
    return sync.select_folders(available, ["FRANCE", "nowhere", "GERMANY", "CHINA"], ["germany"])


@query("SELECT n_name AS name FROM nation WHERE n_nationkey % 3 <> 0 AND lower(n_name) <> 'canada'")
def select_all_folders(spark, sf_dir):
    available = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 != 0).alias("selectable"))
    return sync.select_folders(available, None, ["Canada"]).select("name")


@query("""WITH n AS (SELECT c_custkey, lower(c_mktsegment) AS stem, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, lower(c_mktsegment) ORDER BY c_custkey) - 1 AS k FROM customer)
SELECT c_custkey, CASE WHEN k > 0 THEN c_mktsegment || '_' || k || '.txt' ELSE c_mktsegment || '.txt' END AS target FROM n""")
def collision_suffix(spark, sf_dir):
    """Customers' segments as file names in a folder for each nation."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("attachment_id"), F.col("c_nationkey").cast("string").alias("folder"), F.concat("c_mktsegment", F.lit(".txt")).alias("filename"))
    return blobs.target_names(own).select(F.col("attachment_id").alias("c_custkey"), "target")


@query("SELECT p.page_id, d.n_chars IS NOT NULL AS exists_, d.n_chars AS size_on_disk FROM pages p LEFT JOIN documents d ON d.doc_id = 3 * p.page_id")
def attachment_view(spark, sf_dir):
    """Pages as attachments, documents as the files that are there."""
    own = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") * 3).cast("string").alias("local_path"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("length"))
    return blobs.views(own, files).select("page_id", F.col("exists").alias("exists_"), "size_on_disk")


_HASHED = "a AS (SELECT doc_id AS attachment_id, CASE WHEN doc_id % 9 = 0 THEN 'none' ELSE sha256(text) END AS sha256, n_chars FROM documents)"


def _attachments(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    return own.select(F.col("doc_id").alias("attachment_id"), F.when(F.col("doc_id") % 9 == 0, "none").otherwise(F.sha2("text", 256)).alias("sha256"), F.lit(True).alias("downloaded"), "n_chars", F.col("text").cast("binary").alias("payload"))


@query(f"""WITH {_HASHED}, b AS (SELECT DISTINCT sha256 FROM a WHERE n_chars > 1000), f AS (SELECT sha256, min(attachment_id) AS first FROM a GROUP BY sha256)
SELECT attachment_id, CASE WHEN a.sha256 = 'none' THEN 'unknown' WHEN a.sha256 IN (SELECT sha256 FROM b) THEN 'relink' WHEN attachment_id = first THEN 'adopt' ELSE 'relink' END AS action FROM a JOIN f USING (sha256)""")
def blob_migration(spark, sf_dir):
    own = _attachments(spark, sf_dir)
    return blobs.migration(own, own.where("n_chars > 1000").select("sha256")).select("attachment_id", "action")


@query(f"""WITH {_HASHED}, b AS (SELECT sha256, max(n_chars) AS length FROM a WHERE sha256 <> 'none' GROUP BY sha256), u AS (SELECT sha256, count(*) AS uses FROM a WHERE n_chars % 2 = 0 AND sha256 <> 'none' GROUP BY sha256)
SELECT count(*) AS blobs, CAST(sum(length) AS BIGINT) AS bytes, CAST(sum(coalesce(uses, 0)) AS BIGINT) AS "references", CAST(sum(greatest(coalesce(uses, 0) - 1, 0) * length) AS BIGINT) AS saved_bytes FROM b LEFT JOIN u USING (sha256)""")
def blob_statistics(spark, sf_dir):
    own = _attachments(spark, sf_dir)
    stored = own.where("sha256 != 'none'").select("sha256", F.col("n_chars").alias("length"))
    return blobs.blob_statistics(stored, own.where("n_chars % 2 = 0"))


@query(f"WITH {_HASHED} SELECT sha256, 'blobs/' || substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 AS blob_path, any_value(strlen(text)) AS size FROM a JOIN documents ON doc_id = attachment_id WHERE sha256 <> 'none' GROUP BY sha256")
def blob_put(spark, sf_dir):
    """One row a content."""
    return blobs.stored(_attachments(spark, sf_dir)).select("sha256", "blob_path", F.octet_length("payload").cast("long").alias("size"))


@query(f"""WITH {_HASHED}, k AS (SELECT DISTINCT sha256 FROM a WHERE n_chars > 3000 AND sha256 <> 'none'), f AS (SELECT sha256, min(attachment_id) AS first FROM a WHERE sha256 <> 'none' GROUP BY sha256)
SELECT a.attachment_id, coalesce(a.sha256 IN (SELECT sha256 FROM k) OR attachment_id <> first, FALSE) AS reused FROM a LEFT JOIN f USING (sha256)""")
def blob_adopt(spark, sf_dir):
    """What is stored already is not written again."""
    own = _attachments(spark, sf_dir)
    return blobs.plan_writes(own, own.where("n_chars > 3000 and sha256 != 'none'").select("sha256")).select("attachment_id", "reused")


@query("SELECT count(*) FILTER (doc_id % 4 = 0) AS messages, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(*) FILTER (label = 0) FROM embeddings) AS reused, (SELECT count(*) FILTER (label NOT IN (0, 3)) FROM embeddings) AS embedded, (SELECT count(*) FILTER (label = 3) FROM embeddings) AS failed FROM documents")
def index_counters(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("doc_id % 4 = 0")
    fresh = table(spark, sf_dir, "embeddings").select((F.col("label") == 0).alias("reused"), F.when(F.col("label") != 3, F.col("embedding")).alias("embedding"))
    return incremental.counters(own, fresh)


@query("SELECT event_id AS id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def recent_runs(spark, sf_dir):
    return sync.recent(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type"), 20)


@query("SELECT c_custkey, upper(c_name) AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, lower(c_name) FROM customer WHERE c_custkey % 2 = 1 ORDER BY lower(name) DESC LIMIT 15")
def client_sort(spark, sf_dir):
    """Texts without regard to case."""
    own = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.lower("c_name")).alias("name"))
    return search.sort_rows(own, "name", True).limit(15)


@query(f"WITH {MESSAGES} SELECT message_pk, folder FROM messages WHERE folder IN ('src1', 'src2') AND account = 'en'")
def vector_metadata_filter(spark, sf_dir):
    """Equality on known keys, membership for lists; keys that are not known do not count."""
    return messages(spark, sf_dir).where(filters.metadata({"folder": ["src1", "src2"], "account": "en", "size": 3})).select("message_pk", "folder")


@query(f"WITH {MESSAGES}, {QUERY_VECTOR}, s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q WHERE vec_id IN (SELECT message_pk FROM messages WHERE deleted_at IS NULL AND folder IN ('src0', 'src1', 'src2', 'src3'))) SELECT vec_id AS message_pk, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 100")
def allowed_semi(spark, sf_dir):
    """The vector channel among messages that pass the filters, which come before the cut."""
    out = search.vector_channel(messages(spark, sf_dir), vector_table(spark, sf_dir), query_vector(spark, sf_dir), Filters(folder=("src0", "src1", "src2", "src3")))
    return out.select("message_pk", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {MESSAGES}, {QUERY_VECTOR}, s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) AS score FROM embeddings, q WHERE vec_id IN (SELECT message_pk FROM messages WHERE deleted_at IS NULL)) SELECT vec_id AS message_pk, round(1.0 / (60 + row_number() OVER (ORDER BY score DESC, vec_id)), 9) AS fused FROM s ORDER BY score DESC, vec_id LIMIT 20")
def single_mode_score(spark, sf_dir):
    out = search.hybrid(messages(spark, sf_dir), vector_table(spark, sf_dir), "", query_vector(spark, sf_dir), mode="vector")
    return out.select("message_pk", F.round("fused", 9).alias("fused"))


@query("""WITH v AS (SELECT vec_id, vec_id % 2 = 0 AND label <> 1 AS same FROM embeddings)
SELECT doc_id AS message_pk, coalesce(same, FALSE) AS reused FROM documents LEFT JOIN v ON vec_id = doc_id""")
def reuse_join(spark, sf_dir):
    """Chunks keep the vector of the same message, text and model; the others are embedded."""
    from tessera.functions.embedding import embedding_text

    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_pk"), F.lit("").alias("subject"), F.col("source").alias("text"))
    fresh = own.withColumn("embed_hash", F.sha2(embedding_text("subject", "text"), 256))
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_pk"), "embedding", F.when(F.col("label") == 1, "other").otherwise("hashing").alias("model"))
    old = known.join(own, "message_pk").select("message_pk", "embedding", "model", F.when(F.col("message_pk") % 2 == 0, F.sha2("text", 256)).otherwise("changed").alias("embed_hash"))
    return incremental.with_vectors(fresh, old, hashing(64)).where(F.size("embedding") == 64).select("message_pk", "reused")


#: So large that every message is one chunk.
_WHOLE = ChunkPolicy(10**9, 80)
_LIVE = "deleted_at IS NULL AND trim(body_text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''"


@query(f"WITH {MESSAGES} SELECT message_pk, 0 AS chunk_index, 'hashing' AS model, FALSE AS reused FROM messages WHERE {_LIVE}")
def index_rebuild(spark, sf_dir):
    """All live messages anew."""
    return incremental.rebuild(messages(spark, sf_dir), hashing(64), _WHOLE).select("message_pk", "chunk_index", "model", "reused")


@query(f"""WITH {MESSAGES}, old AS (SELECT message_pk FROM messages WHERE {_LIVE} AND message_pk % 2 = 0),
pending AS (SELECT message_pk, body_text, deleted_at FROM messages WHERE deleted_at IS NULL AND (indexed_at IS NULL OR indexed_at < updated_at))
SELECT message_pk, FALSE AS reused FROM old WHERE message_pk NOT IN (SELECT message_pk FROM pending)
UNION ALL SELECT message_pk, message_pk % 4 = 0 AS reused FROM pending WHERE {_LIVE}""")
def incremental_reuse(spark, sf_dir):
    """An index of half of the messages, a part of them changed since, after what is pending is indexed: what did not change
    keeps its vectors, the rest is embedded, and what is not pending stays as it was."""
    own, backend = messages(spark, sf_dir), hashing(64)
    before = own.where("message_pk % 2 = 0").withColumn("body_text", F.when((F.col("message_pk") % 4 == 2) & (F.btrim("body_text") != ""), F.concat("body_text", F.lit(" was longer"))).otherwise(F.col("body_text")))
    return incremental.index(own, incremental.rebuild(before, backend, _WHOLE), backend, _WHOLE).select("message_pk", "reused")


@query("SELECT vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT vec_id, row_number() OVER (ORDER BY list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) DESC, vec_id) AS rank FROM embeddings, q) WHERE rank <= 5".replace("SELECT vec_id, CAST", f"WITH {QUERY_VECTOR} SELECT vec_id, CAST", 1))
def vector_batch_of_one(spark, sf_dir):
    """A batch of one query gives what a single query gives."""
    own = table(spark, sf_dir, "embeddings")
    return vectors.batch_top_k(own, own.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).select("vec_id", "rank")


@query(f"""WITH {QUERY_VECTOR}, u AS (SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS e FROM embeddings WHERE vec_id % 10 <> 3),
s AS (SELECT vec_id AS chunk_id, list_dot_product(e::DOUBLE[], v::DOUBLE[]) AS score, (SELECT count(*) FROM u) AS stored FROM u, q)
SELECT chunk_id, round(score, 6) AS score, stored FROM s ORDER BY score DESC, chunk_id LIMIT 10""")
def vector_store(spark, sf_dir):
    """A store after all vectors came in, a quarter of them again with other values, and a tenth went."""
    from tessera.operators.vector_store import vector_store as make

    own = make(spark, fresh_path(spark, "vector-store"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("m").alias("model"), F.col("vec_id").alias("message_pk"), "embedding")
    own.upsert(rows)
    own.upsert(rows.where("chunk_id % 4 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    own.delete(rows.where("chunk_id % 10 = 3"))
    return own.query(query_vector(spark, sf_dir), 10, "m").select("chunk_id", F.round("score", 6).alias("score"), F.lit(own.count()).cast("long").alias("stored"))
