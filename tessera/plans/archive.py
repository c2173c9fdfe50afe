"""Queries of sync, merging, incremental indexing, attachments and activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.embedding import hashing
from tessera.operators import blobs, incremental, sync
from tessera.plans.views import MESSAGES, Catalog, messages, table
from tessera.sources.scratch import fresh_path
from tessera.streaming import index_stream, run_progress

CATALOG = Catalog()
query = CATALOG.add

_REMOTE = "remote AS (SELECT lang AS account, source AS folder, CAST(1 AS BIGINT) AS uidvalidity, CAST(doc_id AS VARCHAR) AS uid FROM documents)"
_LOCAL = "loc AS (SELECT account, folder, uidvalidity, uid, deleted_at FROM messages WHERE indexed_at IS NOT NULL)"


def _remote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("account"), F.col("source").alias("folder"), F.lit(1).cast("long").alias("uidvalidity"), F.col("doc_id").cast("string").alias("uid"))


def _local(spark, sf_dir):
    """What a run before has archived: messages with a label."""
    return messages(spark, sf_dir).where("indexed_at is not null").select("account", "folder", "uidvalidity", "uid", "deleted_at")


@query(f"WITH {MESSAGES}, {_REMOTE}, {_LOCAL} SELECT * FROM remote r WHERE NOT EXISTS (SELECT 1 FROM loc l WHERE l.account = r.account AND l.folder = r.folder AND l.uidvalidity = r.uidvalidity AND l.uid = r.uid)")
def new_uids_anti(spark, sf_dir):
    return sync.new_uids(_remote(spark, sf_dir), _local(spark, sf_dir))


def _seen(spark, sf_dir):
    """The remote list of a later scan: documents of more than 1000 characters are still there."""
    return table(spark, sf_dir, "documents").where("n_chars > 1000").select(F.col("lang").alias("account"), F.col("source").alias("folder"), F.lit(1).cast("long").alias("uidvalidity"), F.col("doc_id").cast("string").alias("uid"))


@query(f"WITH {MESSAGES}, {_LOCAL} SELECT l.account, l.folder, l.uidvalidity, l.uid FROM loc l WHERE deleted_at IS NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE n_chars > 1000 AND CAST(doc_id AS VARCHAR) = l.uid)")
def missing_uids_anti(spark, sf_dir):
    return sync.missing_uids(_local(spark, sf_dir), _seen(spark, sf_dir)).drop("deleted_at")


@query(f"""WITH {MESSAGES}, {_LOCAL}, whole AS (SELECT DISTINCT lang, source FROM documents WHERE n_chars > 1000)
SELECT account, folder, uidvalidity, uid, CASE WHEN deleted_at IS NULL AND (account, folder) IN (SELECT (lang, source) FROM whole) AND uid NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE n_chars > 1000) THEN TIMESTAMP '2025-01-01' ELSE deleted_at END AS deleted_at FROM loc""")
def reconcile_soft_delete(spark, sf_dir):
    return sync.soft_delete_missing(_local(spark, sf_dir), _seen(spark, sf_dir), F.lit("2025-01-01").cast("timestamp"))


@query()
def incremental_index(spark, sf_dir):
    """Chunks and vectors after an index run over what is pending, from an empty index."""
    own, backend = messages(spark, sf_dir), hashing(64)
    empty = incremental.rebuild(own.limit(0), backend)
    return incremental.index(own, empty, backend).select("message_pk", "chunk_index", "token_count", "content_hash", "reused")


@query("WITH f AS (SELECT min(doc_id) AS keep, sha256(text) AS h, count(*) AS n FROM documents GROUP BY text) SELECT keep, h, n FROM f WHERE n > 1")
def dup_by_hash(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return own.groupBy("h").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1").select("keep", "h", "n")


@query("""WITH m AS (SELECT doc_id, lang, source, sha256(text) AS mid FROM documents), f AS (SELECT lang, mid, min(doc_id) AS pk, min_by(source, doc_id) AS folder FROM m GROUP BY ALL)
SELECT doc_id AS message_pk, CASE WHEN f.pk < doc_id AND f.folder <> source THEN f.pk END AS duplicate_of FROM m JOIN f USING (lang, mid)""")
def first_seen_duplicate(spark, sf_dir):
    """Copies in another folder point to the first message with their Message-ID, which is their text's hash here."""
    own = messages(spark, sf_dir).withColumn("message_id", F.sha2("body_text", 256))
    return sync.first_copies(own).select("message_pk", "duplicate_of")


_COPIES = """m AS (SELECT doc_id, lang, source, sha256(text) AS mid FROM documents), f AS (SELECT lang, mid, min(doc_id) AS pk, min_by(source, doc_id) AS folder FROM m GROUP BY ALL),
  d AS (SELECT doc_id, source, CASE WHEN f.pk < doc_id AND f.folder <> source THEN f.pk END AS dup FROM m JOIN f USING (lang, mid)), alive AS (SELECT * FROM d WHERE doc_id % 3 <> 0)"""


def _copies(spark, sf_dir):
    own = messages(spark, sf_dir).withColumn("message_id", F.sha2("body_text", 256))
    return sync.first_copies(own).select("message_pk", "folder", "duplicate_of")


@query(f"""WITH {_COPIES}, h AS (SELECT dup AS root, min(doc_id) AS pk, min_by(source, doc_id) AS folder FROM alive WHERE dup % 3 = 0 GROUP BY ALL)
SELECT doc_id AS message_pk, CASE WHEN dup % 3 <> 0 THEN dup WHEN h.pk <> doc_id AND h.folder <> source THEN h.pk END AS duplicate_of FROM alive LEFT JOIN h ON root = dup""")
def duplicate_handed_on(spark, sf_dir):
    """A third of the messages go; of the copies of one that went the least is the first now."""
    own = _copies(spark, sf_dir)
    return sync.handed_on(own, own.where("message_pk % 3 = 0")).select("message_pk", "duplicate_of")


@query(f"WITH {_COPIES} SELECT doc_id AS message_pk, CASE WHEN dup % 3 <> 0 THEN dup END AS duplicate_of FROM alive")
def duplicate_set_null(spark, sf_dir):
    """The same without heirs."""
    own = _copies(spark, sf_dir)
    return sync.handed_on(own, own.where("message_pk % 3 = 0"), heirs=False).select("message_pk", "duplicate_of")


_EVENTS = "SELECT user_id, event_id, ts, event_type, value FROM events"


@query(f"SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(value, (ts, event_id)) AS value, max(ts) AS ts FROM ({_EVENTS}) GROUP BY user_id")
def upsert_latest_wins(spark, sf_dir):
    """Events up to a date are the table, later ones come in; each user's newest row wins."""
    own = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", F.struct("ts", "event_id").alias("at"))
    cut = F.lit("2024-01-15").cast("timestamp")
    newest = lambda d: d.groupBy("user_id").agg(*[F.max_by(c, "at").alias(c) for c in ("event_type", "value", "ts")], F.max("at").alias("at"))
    out = sync.upsert(newest(own.where(F.col("ts") < cut)), newest(own.where(F.col("ts") >= cut)), ["user_id"], order="at", revive=None)
    return out.select("user_id", "event_type", "value", "ts")


@query("""WITH old AS (SELECT user_id, max(ts) AS seen FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), fresh AS (SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15')
SELECT coalesce(o.user_id, f.user_id) AS user_id, CASE WHEN f.user_id IS NULL THEN seen END AS deleted_at FROM old o FULL JOIN fresh f ON o.user_id = f.user_id""")
def soft_delete_revive(spark, sf_dir):
    """Users are deleted at their last event, and revived by a new one."""
    own, cut = table(spark, sf_dir, "events"), F.lit("2024-01-15").cast("timestamp")
    old = own.where(F.col("ts") < cut).groupBy("user_id").agg(F.max("ts").alias("deleted_at")).withColumn("updated_at", F.col("deleted_at"))
    fresh = own.where(F.col("ts") >= cut).groupBy("user_id").agg(F.max("ts").alias("updated_at")).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    return sync.upsert(old, fresh.select(old.columns), ["user_id"]).select("user_id", "deleted_at")


_NUMBERED = "SELECT event_type AS folder, event_id, row_number() OVER (ORDER BY event_type, event_id) <= 4000 AS taken FROM events"


def _budgeted(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.lit("a").alias("account"), F.col("event_type").alias("folder"), F.col("event_type").alias("folder_order"), F.col("event_id").cast("string").alias("uid"))
    return sync.within_budget(own, 4000)


@query(f"SELECT folder, CAST(event_id AS VARCHAR) AS uid, taken FROM ({_NUMBERED})")
def budget_prefix(spark, sf_dir):
    return _budgeted(spark, sf_dir).select("folder", "uid", "taken")


@query(f"SELECT folder, count(*) AS listed, count(*) FILTER (taken) AS taken, count(*) FILTER (NOT taken) AS skipped, CASE WHEN bool_and(taken) THEN max(event_id) ELSE coalesce(max(event_id) FILTER (taken), 0) END AS last_uid, NOT bool_and(taken) AS truncated FROM ({_NUMBERED}) GROUP BY folder")
def watermark_by_folder(spark, sf_dir):
    return sync.watermarks(_budgeted(spark, sf_dir)).drop("account")


@query("""WITH f AS (SELECT user_id, event_type, count(*) AS fetched, count(*) FILTER (value > 50) AS archived, count(*) FILTER (value <= 5) AS failed FROM events GROUP BY ALL),
r AS (SELECT user_id, CAST(sum(fetched) AS BIGINT) AS fetched, CAST(sum(archived) AS BIGINT) AS archived, CAST(sum(failed) AS BIGINT) AS failed, count(DISTINCT event_type) FILTER (failed > 3) AS bad FROM f GROUP BY user_id)
SELECT user_id, fetched, archived, failed, CASE WHEN bad > 0 AND failed = 0 THEN 'partial' WHEN failed = 0 THEN 'success' WHEN archived > 0 THEN 'partial' ELSE 'failed' END AS status FROM r""")
def run_status_rollup(spark, sf_dir):
    """A user's events as a run, their types as its folders."""
    own = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("folder")).agg(F.count("*").alias("fetched"), F.count_if(F.col("value") > 50).alias("archived"), F.count_if(F.col("value") <= 5).alias("failed"))
    rows = own.withColumns({"skipped": F.lit(0), "deleted": F.lit(0), "error_summary": F.lit(""), "status": F.when(F.col("failed") > 3, "failed").otherwise("success")})
    return sync.merge_results(rows, ("user_id",)).select("user_id", "fetched", "archived", "failed", "status")


@query("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'fetch_plan' WHEN 'error' THEN 'message_failed' WHEN 'purchase' THEN 'folder_done' ELSE 'message_archived' END AS event, CAST(floor(value) AS BIGINT) AS number FROM events),
p AS (SELECT run_id, max(seq) AS last_plan, max_by(number, seq) AS total FROM l WHERE event = 'fetch_plan' GROUP BY run_id)
SELECT l.run_id, count(*) FILTER (event IN ('message_archived', 'message_failed') AND seq > coalesce(last_plan, -1)) AS done, coalesce(any_value(total), 0) AS total, count(*) FILTER (event = 'message_archived') AS archived,
  count(*) FILTER (event = 'message_failed') AS failed, count(*) FILTER (event = 'folder_done') AS folders_done, count(*) FILTER (event = 'error') AS errors FROM l LEFT JOIN p ON p.run_id = l.run_id GROUP BY l.run_id""")
def progress_counters(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", "fetch_plan").when(F.col("event_type") == "error", "message_failed").when(F.col("event_type") == "purchase", "folder_done").otherwise("message_archived")
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.floor("value").cast("long").alias("number"))
    return index_stream.batch_progress(log)


@query("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'fetch_plan' WHEN 'error' THEN 'message_failed' WHEN 'purchase' THEN 'folder_done' ELSE 'message_archived' END AS event, CAST(floor(value) AS BIGINT) AS number FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
p AS (SELECT run_id, max(seq) AS last_plan, max_by(number, seq) AS total FROM l WHERE event = 'fetch_plan' GROUP BY run_id)
SELECT l.run_id, count(*) AS events, count(*) FILTER (event IN ('message_archived', 'message_failed') AND seq > coalesce(last_plan, -1)) AS done, coalesce(any_value(total), 0) AS total, count(*) FILTER (event = 'message_archived') AS archived,
  count(*) FILTER (event = 'message_failed') AS failed, count(*) FILTER (event = 'folder_done') AS folders_done, list_sort(list(seq))[-5:] AS last, max(ts) + INTERVAL 1 DAY < (SELECT max(ts) FROM l) - INTERVAL 10 MINUTE AS stalled
FROM l LEFT JOIN p ON p.run_id = l.run_id GROUP BY l.run_id""")
def progress_stream(spark, sf_dir):
    """The same as a stream with state: counters, the last five events of each user, and who had none for a day."""
    kind = F.when(F.col("event_type") == "signup", "fetch_plan").when(F.col("event_type") == "error", "message_failed").when(F.col("event_type") == "purchase", "folder_done").otherwise("message_archived")
    place = fresh_path(spark, "progress")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # files in a folder, as they come in; the stream reads them all
    events.where("user_id is not null and ts is not null").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.lit("").alias("folder"), F.floor("value").cast("long").alias("number"), F.lit("").alias("status"), F.col("ts").cast("timestamp").alias("at")).write.parquet(f"{place}/log")
    stream = spark.readStream.schema(spark.read.parquet(f"{place}/log").schema).parquet(f"{place}/log")
    out = run_progress.run_progress(stream, stall=86400)
    out.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{place}/updates/batch={n}")).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.schema(f"{run_progress.OUT}, batch int").parquet(f"{place}/updates")
    return run_progress.latest(updates).select("run_id", "events", "done", "total", "archived", "failed", "folders_done", "last", "stalled")


@query("""WITH a AS (SELECT doc_id AS attachment_id, sha256(text) AS h FROM documents), f AS (SELECT h, min(attachment_id) AS first FROM a GROUP BY h)
SELECT attachment_id, 'blobs/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h AS blob_path, attachment_id <> first AS reused FROM a JOIN f USING (h)""")
def attachment_reuse(spark, sf_dir):
    """Texts as attachments: equal ones are written once."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("attachment_id"), F.sha2("text", 256).alias("sha256"))
    return blobs.plan_writes(own).select("attachment_id", "blob_path", "reused")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h, quality IS NOT NULL AS file, quality = 1 AS good FROM documents d LEFT JOIN labels l USING (doc_id)), s AS (
  SELECT CASE WHEN NOT file THEN 'missing_file' WHEN NOT good THEN 'corrupted' WHEN h NOT IN (SELECT sha256(text) FROM documents WHERE n_chars > 1000) THEN 'missing_blob' ELSE 'ok' END AS state FROM a)
SELECT count(*) AS checked, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'missing_file') AS missing_file, count(*) FILTER (state = 'missing_blob') AS missing_blob,
  count(*) FILTER (state = 'corrupted') AS corrupted, count(*) FILTER (state IN ('missing_file', 'corrupted')) = 0 AS healthy FROM s""")
def attachments_exists(spark, sf_dir):
    """A check of stored files: labelled texts have a file, good ones the right one, long ones a blob."""
    own = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha256"))
    marks = table(spark, sf_dir, "labels")
    attachments = own.select(F.col("doc_id").alias("attachment_id"), "sha256", F.col("doc_id").cast("string").alias("local_path"), F.lit(True).alias("downloaded"))
    files = own.join(marks, "doc_id").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("quality") == 1, F.col("sha256")).otherwise("other").alias("sha256"))
    return blobs.verification_summary(blobs.verification(attachments, files, own.where("n_chars > 1000").select("sha256"), deep=True))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def tumbling_activity(spark, sf_dir):
    """An extension: activity by day."""
    return index_stream.activity(table(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_activity(spark, sf_dir):
    """An extension: a user's events with less than half an hour between them."""
    return index_stream.sessions(table(spark, sf_dir, "events"))


@query(f"SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM ({_EVENTS}) GROUP BY user_id")
def stream_incremental_equals_batch(spark, sf_dir):
    """Events through a stream that merges its micro-batches into a table: the newest row of each user."""
    own = table(spark, sf_dir, "events")
    place = fresh_path(spark, "stream")
    stream = spark.readStream.schema(own.schema).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_type", "ts", F.struct("ts", "event_id").alias("at"))
    index_stream.merge_batches(stream, f"{place}/table", f"{place}/checkpoint", ["user_id"], "at").awaitTermination()
    return index_stream.latest_version(spark, f"{place}/table").select("user_id", "event_type", "ts")


_STORED = """a AS (SELECT doc_id, text, sha256(text) AS h, coalesce(quality = 1, FALSE) AS file FROM documents LEFT JOIN labels USING (doc_id)),
  b AS (SELECT sha256(text) AS h FROM documents WHERE n_chars > 1000 GROUP BY ALL HAVING min(doc_id) % 2 = 0), s AS (SELECT DISTINCT h FROM a WHERE file)"""


def _repaired(spark, sf_dir):
    """Labelled texts have a file, good ones the right one; long ones a blob, every other one damaged."""
    own = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("sha256"), F.col("text").cast("binary").alias("payload"))
    files = own.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("quality") == 1, F.col("payload")).otherwise(F.encode(F.lit("other"), "utf-8")).alias("payload"))
    first = own.where("n_chars > 1000").groupBy("sha256").agg(F.min_by(F.struct("doc_id", "payload"), "doc_id").alias("f"))
    stored = first.select("sha256", F.when(F.col("f.doc_id") % 2 == 0, F.col("f.payload")).otherwise(F.encode(F.lit("damaged"), "utf-8")).alias("payload"))
    attachments = own.select(F.col("doc_id").alias("attachment_id"), "sha256", F.col("doc_id").cast("string").alias("local_path"), F.lit(True).alias("downloaded"))
    return blobs.repair(attachments, files, stored)


@query(f"""WITH {_STORED} SELECT doc_id AS attachment_id, CASE WHEN h IN (SELECT h FROM b) THEN CASE WHEN file THEN 'ok' ELSE 'relinked' END WHEN h IN (SELECT h FROM s) THEN 'restored' ELSE 'lost' END AS repaired,
  CASE WHEN file OR h NOT IN (SELECT h FROM b UNION ALL SELECT h FROM s) THEN CAST(doc_id AS VARCHAR) ELSE 'blobs/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h END AS local_path FROM a""")
def attachments_repaired(spark, sf_dir):
    return _repaired(spark, sf_dir)[1].select("attachment_id", "repaired", "local_path")


@query(f"WITH {_STORED} SELECT h AS sha256, any_value(strlen(text)) AS size FROM a WHERE h IN (SELECT h FROM s) AND h NOT IN (SELECT h FROM b) GROUP BY h")
def blobs_restored(spark, sf_dir):
    return _repaired(spark, sf_dir)[0].select("sha256", F.octet_length("payload").cast("long").alias("size"))
