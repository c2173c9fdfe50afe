"""Queries of an archive on disk: the driver's documents as mail, after two syncs, and index runs where a query reads what these
make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.archive import Archive
from tessera.functions.embedding import hashing
from tessera.functions import mime
from tessera.plans.views import Catalog, table
from tessera.sources import archive as files
from tessera.sources import mailbox
from tessera.sources.scratch import fresh_path

CATALOG = Catalog()
query = CATALOG.add

_MADE: dict[tuple[str, ...], Archive] = {}
#: The first sync sees the documents whose number does not end in 9; the second all but multiples of 11.
FIRST, SECOND = "doc_id % 10 <> 9", "doc_id % 11 <> 0"
_SEEN = f"seen AS (SELECT *, lang AS account, source AS folder, {FIRST} AND NOT ({SECOND}) AS deleted FROM documents WHERE {FIRST} OR {SECOND})"


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages of a folder for each source."""
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600), "dd MMM yyyy HH:mm:ss")
    number = F.col("doc_id").cast("string")
    head = F.concat(F.lit("Subject: No. "), number, F.lit(" of "), "source", F.lit("\r\nFrom: "), F.upper("lang"), F.lit(" <"), "source", F.lit("@example.com>\r\nTo: me@example.org\r\nMessage-ID: <doc-"), number, F.lit("@corpus>\r\nDate: "), when, F.lit(" +0000\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"))
    content = F.encode(F.concat(head, F.coalesce("text", F.lit(""))), "utf-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("account"), F.col("source").alias("folder"), F.lit(1).cast("long").alias("uidvalidity"), number.alias("uid"), F.octet_length(content).cast("long").alias("size_bytes"), content.alias("content"))


def archived(spark: SparkSession, sf_dir: str) -> Archive:
    """The archive, made when a session first asks for it."""
    place = spark.sparkContext.applicationId, sf_dir
    if place not in _MADE:
        own = Archive(spark, fresh_path(spark, "archive"), embedder=hashing(64))
        raw = mails(spark, sf_dir)
        own.sync(raw.where(FIRST).drop("doc_id"))
        own.index()
        own.sync(raw.where(SECOND).drop("doc_id"), full=True)
        own.index()
        _MADE[place] = own
    return _MADE[place]


def synced(spark: SparkSession, sf_dir: str) -> Archive:
    """The archive after the two syncs, for queries that read nothing an index run makes: mail, attachments, folders, log and the
    keyword indexes of messages are what they are after the index runs. The whole one if the session has it already."""
    place = spark.sparkContext.applicationId, sf_dir
    if place in _MADE:
        return _MADE[place]
    if (*place, "synced") not in _MADE:
        own = Archive(spark, fresh_path(spark, "archive"), embedder=hashing(64))
        raw = mails(spark, sf_dir)
        own.sync(raw.where(FIRST).drop("doc_id"))
        own.sync(raw.where(SECOND).drop("doc_id"), full=True)
        _MADE[(*place, "synced")] = own
    return _MADE[(*place, "synced")]


@query(f"""WITH {_SEEN} SELECT account, folder, CAST(doc_id AS VARCHAR) AS uid, 'doc-' || doc_id || '@corpus' AS message_id, 'No. ' || doc_id || ' of ' || source AS subject, source || '@example.com' AS sender, lang_upper AS sender_name,
  make_timestamp((1704067200 + doc_id * 3600) * 1000000) AS date_utc, deleted FROM (SELECT *, upper(lang) AS lang_upper FROM seen)""")
def archive_messages(spark, sf_dir):
    """What is there: parsed, merged, and marked where the second list has it no more."""
    return synced(spark, sf_dir).table("messages").select("account", "folder", "uid", "message_id", "subject", "sender", "sender_name", "date_utc", F.col("deleted_at").isNotNull().alias("deleted"))


@query(f"""WITH r AS (SELECT 1 AS run, lang AS account, source AS folder, count(*) AS archived, CAST(0 AS BIGINT) AS deleted FROM documents WHERE {FIRST} GROUP BY ALL
UNION ALL SELECT 2, lang, source, count(*) FILTER (NOT ({FIRST})), CAST((SELECT count(*) FROM documents d WHERE d.lang = o.lang AND d.source = o.source AND d.doc_id % 10 <> 9 AND d.doc_id % 11 = 0) AS BIGINT) FROM documents o WHERE {SECOND} GROUP BY ALL)
SELECT *, 'success' AS status FROM r""")
def archive_sync_log(spark, sf_dir):
    """A row a folder and run."""
    log = synced(spark, sf_dir).table("sync_log")
    runs = log.select("started_at").distinct().orderBy("started_at").collect()  # two
    run = F.when(F.col("started_at") == F.lit(runs[0][0]), 1).otherwise(2)
    return log.select(run.alias("run"), "account", "folder", "archived", "deleted", "status")


@query(f"WITH {_SEEN} SELECT account, folder, count(*) AS total, count(*) FILTER (NOT deleted) AS live, CAST(1 AS BIGINT) AS uidvalidity, max(doc_id) AS last_uid FROM seen GROUP BY ALL")
def archive_folders(spark, sf_dir):
    """Folders with their watermarks: the highest uid that was processed."""
    return synced(spark, sf_dir).folders().select("account", "folder", "total", "live", "uidvalidity", "last_uid")


@query(f"WITH {_SEEN} SELECT count(*) AS messages, count(*) FILTER (NOT deleted) AS live, CAST(0 AS BIGINT) AS pending, TRUE AS chunked FROM seen")
def archive_statistics(spark, sf_dir):
    """After the index runs nothing is pending, and every live message has its chunks with vectors, no deleted one has any."""
    own = archived(spark, sf_dir)
    live = own.table("messages").where("deleted_at is null")
    chunks = own.table("chunks")
    same = live.select("message_pk").join(chunks.where("embedding is not null").select("message_pk").distinct(), "message_pk", "full").agg(F.count("*").alias("n")).first()[0]
    r = own.statistics().select("messages", "live", "pending").first()
    return spark.createDataFrame([(r[0], r[1], r[2], same == live.count() == chunks.select("message_pk").distinct().count())], "messages long, live long, pending long, chunked boolean")


@query(f"WITH {_SEEN} SELECT 'doc-' || doc_id || '@corpus' AS message_id, source AS folder, CAST(1 AS DOUBLE) AS score FROM seen WHERE NOT deleted AND source = 'src3'")
def archive_field_search(spark, sf_dir):
    """Senders of one folder, through the maintained index; all are of one score."""
    return synced(spark, sf_dir).search("src3", scope="sender", limit=1 << 30).select("message_id", "folder", "score")


@query(f"WITH {_SEEN} SELECT count(*) AS messages, count(*) AS indexed, (SELECT count(*) FROM seen WHERE NOT deleted) AS live FROM seen")
def archive_backup_restore(spark, sf_dir):
    """Another archive after a restore of this one's backup, its keyword index written anew."""
    own, place = archived(spark, sf_dir), fresh_path(spark, "backup")
    own.backup(f"{place}/copy")
    other = Archive(spark, f"{place}/other", embedder=hashing(64))
    other.restore(f"{place}/copy")
    r = other.statistics().first()
    return spark.createDataFrame([(r["messages"], other.indexes.messages.counts()[0], r["live"])], "messages long, indexed long, live long")


@query(f"""WITH {_SEEN} SELECT folder || '/' || strftime(make_timestamp((1704067200 + doc_id * 3600) * 1000000), '%Y%m%d_%H%M%S') || '_No. ' || doc_id || ' of ' || source || '_' || doc_id || '.md' AS path,
  'No. ' || doc_id || ' of ' || source AS subject, CAST(doc_id AS VARCHAR) AS uid, upper(lang) || ' <' || source || '@example.com>' AS sender, 18 AS fields FROM seen WHERE NOT deleted""")
def markdown_export(spark, sf_dir):
    """Every live message as a Markdown file with front matter, read back."""
    place = fresh_path(spark, "markdown")
    synced(spark, sf_dir).export(place).count()
    return files.read_markdown(spark, place).select("path", "subject", F.col("front")["uid"].alias("uid"), F.col("front")["from"].alias("sender"), F.size("front").alias("fields"))


@query("SELECT 'No. 42 of ' || source AS subject, CAST(doc_id AS VARCHAR) AS uid FROM documents WHERE doc_id = 42")
def archive_point_lookup(spark, sf_dir):
    return synced(spark, sf_dir).message("<doc-42@corpus>").select("subject", "uid")


# a folder of message files

_FILES: dict[tuple[str, str], str] = {}
#: Bytes of a message over which it is read in part; the attachment's share is the text's.
LARGE = 2000
_LETTER = "'Subject: No. ' || doc_id || ' of ' || source || chr(13) || chr(10) || 'From: ' || upper(lang) || ' <' || source || '@example.com>' || chr(13) || chr(10) || 'To: me@example.org' || chr(13) || chr(10) || 'Message-ID: <doc-' || doc_id || '@corpus>' || chr(13) || chr(10) || 'Date: ' || strftime(make_timestamp((1704067200 + doc_id * 3600) * 1000000), '%d %b %Y %H:%M:%S') || ' +0000' || chr(13) || chr(10) || 'Content-Type: text/plain; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(text, '')"


def _write_files(rows: DataFrame, place: str) -> str:
    """folder, uid, content as <place>/<folder>/<uid + 1>.eml (uids begin at 1), written by the tasks."""

    def run(batches):
        import os

        import pyarrow as pa

        n = 0
        for b in batches:
            for folder, uid, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                os.makedirs(f"{place}/{folder}", exist_ok=True)
                with open(f"{place}/{folder}/{uid}.eml", "wb") as f:
                    f.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select("folder", (F.col("uid").cast("long") + 1).cast("string"), "content").mapInArrow(run, "n long").agg(F.sum("n")).first()
    return place


def box(spark: SparkSession, sf_dir: str, parts: bool = False) -> str:
    """The documents as message files of a folder for each source, in the shared folder; with parts each has its text as an
    attachment too. Made when a session first asks for it."""
    place = spark.sparkContext.applicationId, f"{sf_dir}{parts}"
    if place not in _FILES:
        rows = mails(spark, sf_dir)
        if parts:
            body = F.base64(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
            mail = F.concat(F.lit(_PARTS[0]), "uid", F.lit(_PARTS[1]), "uid", F.lit(_PARTS[2]), body, F.lit(_PARTS[3]))
            rows = table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("uid"), "text").select("folder", "uid", F.encode(mail, "utf-8").alias("content"))
        _FILES[place] = _write_files(rows, fresh_path(spark, "mailbox").removeprefix("file://"))
        mailbox.set_epoch(_FILES[place], "Empty", 2)
    return _FILES[place]


@query(f"SELECT source AS folder, CAST(1 AS BIGINT) AS uidvalidity, CAST(doc_id + 1 AS VARCHAR) AS uid, CAST(strlen({_LETTER}) AS BIGINT) AS size_bytes FROM documents WHERE source <> 'src3'")
def mailbox_read(spark, sf_dir):
    """Message files by folder, epoch and uid, with their sizes; an excluded folder is not read, and no file opened."""
    return mailbox.mails(spark, box(spark, sf_dir), exclude="SRC3").select("folder", "uidvalidity", "uid", "size_bytes")


@query(f"SELECT source AS folder, CAST(doc_id + 1 AS VARCHAR) AS uid, sha256({_LETTER}) AS digest FROM documents WHERE doc_id + 1 > 100 AND source IN ('src1', 'src2') AND strlen({_LETTER}) < 3000")
def mailbox_since(spark, sf_dir):
    """Conditions reach the listing: uids as numbers, folders, sizes; only what is left is opened."""
    rows = mailbox.mails(spark, box(spark, sf_dir)).where("number > 100 and folder in ('src1', 'src2') and size_bytes < 3000")
    return rows.select("folder", "uid", F.sha2("content", 256).alias("digest"))


@query("SELECT source AS folder, CAST(doc_id + 1 AS VARCHAR) AS uid, 'doc-' || doc_id || '@corpus' AS message_id, 'No. ' || doc_id || ' of ' || source AS subject, source || '@example.com' AS sender FROM documents")
def mailbox_headers(spark, sf_dir):
    """Envelopes from headers alone: files are read up to the first empty line."""
    rows = mailbox.mails(spark, box(spark, sf_dir)).select("folder", "uid", "header")
    return mime.envelopes(rows, "header").select("folder", "uid", "message_id", "subject", "sender")


_PARTS = ("Subject: No. ", '\r\nContent-Type: multipart/mixed; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nbody of ', "\r\n--b\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename=t.bin\r\nContent-Transfer-Encoding: base64\r\n\r\n", "\r\n--b--\r\n")


@query(f"""WITH m AS (SELECT *, strlen(coalesce(text, '')) AS n, CAST(4 * ceil(strlen(coalesce(text, '')) / 3.0) AS BIGINT) AS b FROM documents), l AS (SELECT *, b + 2 * (greatest(b - 1, 0) // 76) AS coded FROM m),
s AS (SELECT *, coded + {sum(map(len, _PARTS))} + 2 * length(CAST(doc_id AS VARCHAR)) > {LARGE} AS large FROM l)
SELECT CAST(doc_id + 1 AS VARCHAR) AS uid, 'No. ' || doc_id AS subject, 'body of ' || doc_id AS body_text, 't.bin' AS filename, large AS in_part, NOT large AND n > 0 AS downloaded, CAST(CASE WHEN large THEN coded ELSE n END AS BIGINT) AS size_bytes FROM s""")
def mailbox_large(spark, sf_dir):
    """Of messages over a size only header and text are read, by their places in the file; attachments are told of."""
    rows = mime.messages(mailbox.mails(spark, box(spark, sf_dir, True), LARGE).withColumn("in_part", F.col("parts").isNotNull()), most=LARGE)
    a = F.get("attachments", F.lit(0))
    return rows.select("uid", "subject", "body_text", a["filename"].alias("filename"), "in_part", a["downloaded"].alias("downloaded"), a["size_bytes"].alias("size_bytes"))


@query("SELECT source AS name, CAST(1 AS BIGINT) AS epoch, count(*) AS messages, max(doc_id) + 2 AS next_uid FROM documents GROUP BY source UNION ALL SELECT 'Empty', 2, 0, 1")
def folder_status(spark, sf_dir):
    return mailbox.folder_status(spark, box(spark, sf_dir)).select("name", "epoch", "messages", "next_uid")


@query("SELECT source AS folder, CAST(doc_id + 1 AS VARCHAR) AS uid FROM documents")
def mailbox_stream(spark, sf_dir):
    """The same as a stream into a table, in batches of a third of the messages at most."""
    place, out = box(spark, sf_dir), fresh_path(spark, "stream-out")
    most = table(spark, sf_dir, "documents").count() // 3 + 1
    mailbox.register(spark)
    stream = spark.readStream.format("mailbox").schema("folder string, uid string").option("max_messages", most).option("checkpoint", f"{out}/checkpoint").load(place)
    running = stream.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema("folder string, uid string").parquet(f"{out}/table")


@query("SELECT CASE WHEN conv_id % 2 = 0 THEN 'relevant' ELSE 'irrelevant' END AS kind, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS query FROM conversations WHERE role = 'user' AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''")
def query_file(spark, sf_dir):
    """A file of queries, each with its kind, made of what users say."""
    place = fresh_path(spark, "queries")
    said = F.btrim(F.regexp_replace("text", r"\s+", " "))
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat(F.when(F.col("conv_id") % 2 == 0, "relevant").otherwise("irrelevant"), F.lit("\t"), said).alias("value"))
    rows.union(spark.range(1).select(F.lit("# comment"))).write.text(place)
    return files.read_queries(spark, place)


@query(f"""WITH {_SEEN}, f AS (SELECT DISTINCT lang, source FROM seen)
SELECT 'folders' AS command, (SELECT count(*) FROM f) AS rows UNION ALL SELECT 'list', least(3, (SELECT count(*) FROM seen WHERE NOT deleted)) UNION ALL SELECT 'show', 1
UNION ALL SELECT 'status', 1 + least(5, (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents WHERE {FIRST})) + (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents WHERE {SECOND})))
UNION ALL SELECT 'search', least(4, (SELECT count(*) FROM seen WHERE NOT deleted AND source = 'src3'))""")
def command_line(spark, sf_dir):
    """How many rows each command prints over the archive."""
    from tessera.__main__ import parser, run

    lines = ("folders", "list --limit 3", "show doc-42@corpus", "status", "search src3 --scope sender --limit 4")
    return spark.createDataFrame([(line.split()[0], len(run(parser().parse_args(line.split()), archived(spark, sf_dir)))) for line in lines], "command string, rows long")
