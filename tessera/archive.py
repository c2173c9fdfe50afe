"""An archive on disk: mail in, index, search, lists and checks, each a DataFrame over tables by parts.

A change writes the parts that it touches and a manifest; readers take the last manifest that is whole, so a job that dies
half-way changes nothing and can run again. One writer works at a time.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import mime
from tessera.functions.chunking import ChunkPolicy
from tessera.functions.embedding import Backend, backend
from tessera.functions.text import archive_name, fingerprint, safe_path
from tessera.operators import blobs, incremental, search, sync
from tessera.operators.filters import Filters, condition, pending_index
from tessera.operators.keyword_index import KeywordIndex
from tessera.operators.paging import ROWS_PER_FILE, Page, SortedPages
from tessera.sources import archive as files
from tessera.sources.cancel import Cancellation
from tessera.sources.config import Config
from tessera.sources.folders import locked, unlock
from tessera.sources.scratch import MADE, discard, written
from tessera.sources.store import Table

MESSAGES = "message_pk long, account string, folder string, uidvalidity long, uid string, message_id string, subject string, sender string, sender_name string, recipients string, cc string, in_reply_to string, references string, date_utc timestamp, date_raw string, size_bytes long, has_attachments boolean, attachment_names array<string>, body_markdown string, body_text string, content_hash string, local_markdown_path string, duplicate_of long, error string, attempts int, indexed_at timestamp, synced_at timestamp, updated_at timestamp, deleted_at timestamp"
ATTACHMENTS = "attachment_id long, message_pk long, part_index int, filename string, content_type string, size_bytes long, content_id string, is_inline boolean, sha256 string, downloaded boolean, skip_reason string, local_path string"
BLOBS = "sha256 string, blob_path string, payload binary"
CHUNKS = "message_pk long, message_id string, subject string, sender string, date_utc timestamp, folder string, chunk_index int, text string, token_count int, content_hash string, chunk_id long, embed_hash string, embedding array<float>, reused boolean, model string"
FOLDERS = "account string, name string, delimiter string, uidvalidity long, last_uid long, message_count long, selectable boolean, last_sync_at timestamp, last_full_scan_at timestamp"
LOG = "id long, account string, folder string, started_at timestamp, finished_at timestamp, status string, fetched long, archived long, skipped long, failed long, deleted long, error_summary string"
TABLES = {"messages": MESSAGES, "attachments": ATTACHMENTS, "blobs": BLOBS, "chunks": CHUNKS, "folders": FOLDERS, "sync_log": LOG}
#: Uids that share a part: new mail touches a folder's last ones only.
UIDS_PER_PART = 50_000


def part_of(account: str = "account", folder: str = "folder") -> Column:
    """The part of a message: its folder, epoch and range of uids."""
    return F.substring(F.md5(F.concat_ws("\x1f", account, folder, F.col("uidvalidity").cast("string"), F.floor(sync.uid_number() / UIDS_PER_PART).cast("string"))), 1, 12)


class Archive:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, embedder: Backend | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.embedder = embedder or backend(self.config.embedding.backend)
        self.policy = ChunkPolicy(self.config.embedding.chunk_size, self.config.embedding.chunk_overlap)

    def store(self, name: str) -> Table:
        return Table(self.spark, f"{self.root}/{name}", TABLES[name])

    def table(self, name: str) -> DataFrame:
        return self.store(name).read()

    @property
    def indexes(self) -> search.Indexes:
        """The keyword indexes, which sync() and index() keep up to date."""
        own = lambda name, key, columns: KeywordIndex(self.spark, f"{self.root}/keyword/{name}", key, columns)
        return search.Indexes(own("messages", "message_pk", search.MESSAGE_COLUMNS), own("chunks", "chunk_id", search.CHUNK_COLUMNS), own("bodies", "message_pk", ["body_text"]))

    def writing(self):
        """Held by the one writer; another one is refused."""
        return locked(self.spark, f"{self.root}/.lock")

    def cancellation(self) -> Cancellation:
        """Calls off a sync or an index run that is under way: it ends with Cancelled, and no table's version counts that was
        not whole before."""
        return Cancellation(self.spark, self.root)

    def unlock(self) -> bool:
        """Takes away what a writer that died has left."""
        return unlock(self.spark, f"{self.root}/.lock")

    # mail

    def plan(self, raw: DataFrame, status: DataFrame | None, full: bool, now: Column) -> DataFrame:
        """account, name, epoch, messages, start_uid, request, whole: what is asked of each folder. status: account, name, epoch,
        messages, as a server tells them; else what raw holds. A folder is listed whole if that is asked for, if it is new or
        began anew, and if its last whole scan is long ago."""
        if status is None:
            status = raw.groupBy("account", F.col("folder").alias("name")).agg(F.max("uidvalidity").alias("epoch"), F.count("*").alias("messages"))
        folders = self.table("folders").select("account", "name", "uidvalidity", "last_uid", "last_full_scan_at")
        known = status.select("account", "name").join(folders, ["account", "name"], "left")
        planned = sync.plan_folders(known, status.select("account", "name", "epoch", "messages"), full)
        due = sync.reconcile_due(now=now, hours=self.config.sync.full_scan_hours, forced=full)
        request = F.when((F.col("request") == "newer") & due, "all").otherwise(F.col("request"))
        return planned.withColumn("request", request).withColumn("whole", F.col("request") == "all")

    def sync(self, raw: DataFrame, full: bool = False, budget: int | None = None, status: DataFrame | None = None) -> DataFrame:
        """raw: account, folder, uidvalidity, uid, size_bytes, content, as the mailbox source gives them, and parts where large
        messages are read in part (mailbox.mails, which opens a file only if its message is taken). New messages, and those
        that could not be read before (a few times), are parsed and merged; in folders that are listed whole, messages that are
        not in raw any more are marked as deleted, unless the budget cut the run short. Returns a row a folder: counts and
        status, which is also logged."""
        with self.writing(), self.cancellation().work():
            return self._sync(raw, full, budget, status)

    def _sync(self, raw: DataFrame, full: bool, budget: int | None, status: DataFrame | None) -> DataFrame:
        started = F.lit(datetime.now(UTC))
        keys = sync.KEY
        plan = written(self.plan(raw, status, full, started), "sync-plan")
        messages = self.store("messages")
        current = messages.read(part=True)
        failed = current.where(F.col("error").isNotNull() & (F.coalesce("attempts", F.lit(1)) < self.config.sync.max_attempts)).select(*keys, F.col("attempts").alias("__tries"))
        raw = raw.drop("header", "path", "number")
        listed = raw.join(plan.select("account", F.col("name").alias("folder"), F.col("epoch").alias("uidvalidity"), "request", "start_uid"), ["account", "folder", "uidvalidity"])
        asked = listed.join(failed, keys, "left").where(F.col("__tries").isNotNull() | (F.col("request") == "all") | ((F.col("request") == "newer") & (sync.uid_number() > F.col("start_uid"))))
        known = current.where(F.col("deleted_at").isNull()).join(failed.select(keys), keys, "left_anti")  # a deleted message that is listed again comes back
        fresh = sync.new_uids(asked.drop("request", "start_uid"), known).withColumn("folder_order", F.col("folder"))
        planned = sync.within_budget(fresh, budget or self.config.sync.max_messages_per_run, ("account", "folder_order"))
        marks = written(sync.watermarks(planned), "sync-marks")
        cut = not marks.where("truncated").isEmpty()

        mails = mime.messages(planned.where("taken").drop("taken", "folder_order"), most=self.config.sync.max_attachment_mb << 20)
        path = F.concat_ws("/", safe_path(F.array("folder")), archive_name("date_utc", "subject", "uid"))
        none = F.lit(None).cast("timestamp")
        rows = mails.withColumns({"message_pk": F.xxhash64(*keys), "content_hash": fingerprint("subject", "body_text"), "local_markdown_path": path, "attachment_names": F.transform("attachments", lambda a: a["filename"]), "attempts": F.when(F.col("error").isNotNull(), F.coalesce("__tries", F.lit(0)) + 1), "synced_at": started, "updated_at": started, "indexed_at": none, "deleted_at": none, "part": part_of()}).drop("__tries")
        rows = written(rows, "sync-mails")  # parsed once
        parsed = MADE[-1]
        self.cancellation().check()
        columns = [c for c in messages.columns if c != "duplicate_of"]
        incoming = sync.copies_of(rows.select(*columns, "part"), current).select(*messages.columns, "part")

        whole = plan.where("whole").select("account", F.col("name").alias("folder"))
        listed_keys = raw.join(whole, ["account", "folder"], "left_semi").select(keys)
        missing = sync.missing_uids(current.join(whole, ["account", "folder"], "left_semi"), listed_keys) if not cut else current.where("false")
        missing = written(missing.select(*keys, "part"), "sync-missing")
        touched = [r["part"] for r in rows.select("part").union(missing.select("part")).distinct().collect()]  # parts, not rows
        self.cancellation().check()
        if touched:
            there = current.where(F.col("part").isin(touched)).join(missing.select(*keys, F.lit(True).alias("__gone")), keys, "left")
            there = there.withColumn("deleted_at", F.when(F.col("__gone"), started).otherwise(F.col("deleted_at"))).drop("__gone").select(*messages.columns, "part")
            messages.write(sync.merged(there, incoming, keys, kept=("message_pk", "synced_at")), touched)
            self._attachments(rows, touched)
            index = self.indexes
            index.messages.add(rows)
            index.bodies.add(rows)
            self._compact(index)
        results = written(self._results(rows, missing, marks, plan, started), "sync-results")
        discard(self.spark, [parsed])
        self._folders(plan, marks, cut, started)
        self.store("sync_log").write(results.withColumn("part", F.lit("log")), add=True)
        return results

    def _attachments(self, rows: DataFrame, touched: list[str]) -> None:
        """The attachments of new messages take the place of their old ones; contents that are new are stored once."""
        parts = rows.select("message_pk", "part", F.explode("attachments").alias("a")).select("message_pk", "part", "a.*", F.xxhash64("message_pk", "a.part_index").alias("attachment_id"))
        planned = blobs.plan_writes(parts.where("downloaded").select("attachment_id", "sha256", "payload"), self.table("blobs"))
        store = self.store("blobs")
        contents = blobs.stored(planned.where("not reused"))
        if not contents.isEmpty():
            store.write(contents.withColumn("part", F.substring("sha256", 1, 2)), add=True)
            store.compact()
        named = parts.join(planned.select("attachment_id", F.when(F.col("reused"), "reused").alias("__reused"), "blob_path"), "attachment_id", "left")
        own = named.withColumns({"local_path": F.col("blob_path"), "skip_reason": F.coalesce("skip_reason", "__reused")})
        table = self.store("attachments")
        before = table.read(touched, part=True).join(rows.select("message_pk"), "message_pk", "left_anti")
        table.write(before.select(*table.columns, "part").unionByName(own.select(*table.columns, "part")), touched)

    def _results(self, rows: DataFrame, missing: DataFrame, marks: DataFrame, plan: DataFrame, started: Column) -> DataFrame:
        at = ["account", "folder"]
        read = rows.groupBy(at).agg(F.count_if(F.col("error").isNull()).alias("archived"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.array_join(F.slice(F.sort_array(F.collect_set("error")), 1, 5), "; ").alias("error_summary"))
        gone = missing.groupBy(at).agg(F.count("*").alias("deleted"))
        out = plan.select("account", F.col("name").alias("folder")).join(read, at, "left").join(gone, at, "left").join(marks, at, "left")
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        out = out.select(*at, F.coalesce("taken", F.lit(0)).cast("long").alias("fetched"), *map(zero, ("archived", "skipped", "failed", "deleted")), F.coalesce("error_summary", F.lit("")).alias("error_summary"))
        status = sync.run_status(F.lit(0), F.col("failed"), F.col("error_summary"), F.col("archived"), F.col("skipped"))
        return out.withColumns({"id": F.xxhash64(*at, started), "started_at": started, "finished_at": F.current_timestamp(), "status": status}).select(self.store("sync_log").columns)

    def _folders(self, plan: DataFrame, marks: DataFrame, cut: bool, started: Column) -> None:
        """Epochs as the server has them; watermarks go on to what was processed, or begin anew with a new epoch."""
        store = self.store("folders")
        told = plan.where("request != 'unknown'").select("account", "name", F.lit("/").alias("delimiter"), F.col("epoch").alias("uidvalidity"), F.lit(0).cast("long").alias("last_uid"), F.col("messages").alias("message_count"), F.lit(True).alias("selectable"), F.lit(None).cast("timestamp").alias("last_sync_at"), F.lit(None).cast("timestamp").alias("last_full_scan_at"))
        known = sync.upsert_folders(store.read(), told)
        seen = marks.select("account", F.col("folder").alias("name"), F.col("last_uid").alias("__seen"))
        high = F.greatest(F.coalesce("__seen", F.lit(0)), F.col("start_uid")).cast("long")
        scanned = F.when(F.col("whole") & F.lit(not cut), started)
        changes = plan.where("request != 'unknown'").join(seen, ["account", "name"], "left").select("account", "name", high.alias("last_uid"), F.col("messages").alias("message_count"), started.alias("last_sync_at"), scanned.alias("last_full_scan_at"))
        store.write(written(sync.partial_update(known, changes, ["account", "name"]), "folders").withColumn("part", F.lit("all")))

    def _compact(self, index: search.Indexes) -> None:
        """Indexes of many segments, or with many rows gone, are written anew."""
        if index.messages.is_old():
            index.messages.add(self.table("messages"), fresh=True)
            index.bodies.add(self.table("messages"), fresh=True)
        if index.chunks.is_old():
            index.chunks.add(self.table("chunks"), fresh=True)

    def index(self, rebuild: bool = False) -> DataFrame:
        """Chunks and vectors of what is pending, or of all live messages anew; the chunks of messages deleted since go. Returns
        the run's counters."""
        with self.writing(), self.cancellation().work():
            return self._index(rebuild)

    def _index(self, rebuild: bool) -> DataFrame:
        store, chunks = self.store("messages"), self.store("chunks")
        messages = store.read(part=True)
        taken = F.coalesce((F.col("deleted_at").isNull() if rebuild else pending_index()) & F.col("duplicate_of").isNull(), F.lit(False))
        leaves = F.col("deleted_at").isNotNull() & F.col("indexed_at").isNotNull()
        own, gone = messages.where(taken), messages.where(leaves)
        own, gone = written(own, "index-own"), written(gone.select("message_pk", "part"), "index-gone")
        touched = [r["part"] for r in own.select("part").union(gone.select("part")).distinct().collect()]
        if not touched:
            return self.spark.createDataFrame([(0, 0, 0, 0, 0)], "messages long, chunks long, reused long, embedded long, failed long")
        before = chunks.read(None if rebuild else touched, part=True)
        fresh = incremental.chunked(own, self.policy, ("part",))
        made = incremental.with_vectors(fresh, before.where("false" if rebuild else "true"), self.embedder)
        made = written(made.select(*chunks.columns, "part"), "index-chunks")
        self.cancellation().check()
        redone = own.select("message_pk").union(gone.select("message_pk"))
        kept = before.join(redone, "message_pk", "left_anti") if not rebuild else before.where("false")
        old = before.join(redone, "message_pk", "left_semi").select("chunk_id")
        index = self.indexes.chunks
        if rebuild:
            index.add(made, fresh=True)
        else:
            stale = written(old.join(made.select("chunk_id"), "chunk_id", "left_anti"), "index-stale")
            if not stale.isEmpty():
                index.remove(stale)
            index.add(made)
        chunks.write(kept.select(*chunks.columns, "part").unionByName(made), None if rebuild else touched)
        now = F.lit(datetime.now(UTC))
        rows = messages.where(F.col("part").isin(touched))  # marked by the same conditions, so texts do not move for it
        store.write(rows.withColumn("indexed_at", F.when(taken, now).when(leaves, None).otherwise(F.col("indexed_at"))), touched)
        self._compact(self.indexes)
        return incremental.counters(own, made)

    # queries

    def search(self, query: str, filters: Filters = Filters(), limit: int | None = None, mode: str = "hybrid", scope: str = "all") -> DataFrame:
        c = self.config.search
        messages, chunks = self.table("messages"), self.table("chunks")
        limit = limit or c.default_limit
        if scope != "all":
            hits = search.field_search(messages, query, scope, filters, limit, self.indexes)
            hits = hits.select(F.lit("message").alias("granularity"), F.col("message_pk").alias("id"), "message_pk", "score", "rank")
        else:
            vector = self.embedder.embed([query])[0]
            least = c.min_score or self.embedder.least_score
            hits = search.hybrid(messages, chunks, query, vector, filters, limit, mode, c.rrf_k, {"keyword": c.keyword_weight, "vector": c.vector_weight}, least, c.score_margin, c.candidate_multiplier, self.indexes)
        order = [F.desc("fused"), *[F.col(x).asc_nulls_last() for x in ("keyword_rank", "vector_rank") if x in hits.columns], F.col("id")] if "fused" in hits.columns else [F.col("rank"), F.col("id")]
        return search.hydrate(hits, messages, chunks, query, c.snippet_length).orderBy(*order)  # a page

    def page(self, filters: Filters = Filters(), limit: int = 50, offset: int = 0, order: str = "date_desc") -> DataFrame:
        return search.page(self.table("messages"), filters, limit, offset, order)

    @property
    def pages(self) -> SortedPages:
        return SortedPages(self.spark, f"{self.root}/pages")

    def build_pages(self, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Sorts what lists show of all messages, for page_after(); as of now."""
        self.pages.build(self.table("messages").select(*search.LISTED, "deleted_at", "updated_at"), rows_per_file)

    def page_after(self, after: tuple[int, int] | None = None, limit: int = 50, filters: Filters = Filters()) -> Page:
        """The next page of live messages, newest first, after a page's `next`."""
        return self.pages.page(limit, after, condition(filters))

    def message(self, reference: str) -> DataFrame:
        """One message with its attachments, by number or Message-ID."""
        own = search.resolve(self.table("messages"), reference)
        parts = self.table("attachments").groupBy("message_pk").agg(F.sort_array(F.collect_list(F.struct("part_index", "filename", "content_type", "size_bytes", "downloaded", "skip_reason"))).alias("attachments"))
        return own.join(parts, "message_pk", "left")

    def content(self, reference: str, markdown: bool = True) -> DataFrame:
        return self.message(reference).select("message_pk", F.col("body_markdown" if markdown else "body_text").alias("content"))

    def attachment(self, attachment_id: int) -> DataFrame:
        """One attachment with its payload."""
        own = self.table("attachments").where(F.col("attachment_id") == attachment_id)
        return own.join(self.table("blobs").select("sha256", "payload"), "sha256", "left")

    def chunks(self, reference: str, limit: int = 100, offset: int = 0) -> DataFrame:
        own = self.table("chunks").join(search.resolve(self.table("messages"), reference).select("message_pk"), "message_pk", "left_semi")
        return own.orderBy("chunk_index").offset(offset).limit(limit)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.embedder.embed(texts)

    def folders(self) -> DataFrame:
        """Counts of each folder, its epoch and its watermark."""
        own = self.table("folders").select("account", F.col("name").alias("folder"), "uidvalidity", "last_uid", "last_sync_at", "last_full_scan_at")
        return search.folder_statistics(self.table("messages")).join(own, ["account", "folder"])

    def statistics(self) -> DataFrame:
        messages, chunks = self.table("messages"), self.table("chunks")
        own = messages.agg(F.count("*").alias("messages"), F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count_if(pending_index() & F.col("duplicate_of").isNull()).alias("pending"))
        return own.join(F.broadcast(chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("vectors"))))

    def health(self) -> dict[str, object]:
        r = self.statistics().first()
        return {"status": "ok", "embedder": self.embedder.name, "dimension": self.embedder.dimension, **r.asDict()}

    def last_runs(self, n: int = 20) -> DataFrame:
        return self.table("sync_log").orderBy(F.desc("finished_at"), "account", "folder").limit(n)

    # files

    def verify(self, deep: bool = False) -> DataFrame:
        """What a check of the stored attachments finds."""
        stored = self.table("blobs")
        there = stored.select(F.col("blob_path").alias("path"), (F.sha2("payload", 256) if deep else F.col("sha256")).alias("sha256"))
        return blobs.verification_summary(blobs.verification(self.table("attachments"), there, stored.select("sha256"), deep))

    def repair(self, found: DataFrame | None = None) -> DataFrame:
        """Stored contents that are damaged or gone come back from files that still have them (found: path, payload), whatever
        their names are. A damaged content of which no copy is left goes, so that mail which brings it again stores it, and its
        attachments are lost: not downloaded any more. Only parts that change are written. Returns repaired (ok, restored,
        relinked, lost, or null where nothing was to check) and attachments."""
        with self.writing():
            contents_of, table = self.store("blobs"), self.store("attachments")
            stored = contents_of.read(part=True)
            there = stored.select(F.col("blob_path").alias("path"), "payload")
            made, mended = blobs.repair(table.read(part=True), there if found is None else there.unionByName(found.select("path", "payload")), stored)
            mended = written(mended, "mended-attachments")
            made = written(made.withColumn("part", F.substring("sha256", 1, 2)), "mended-contents")
            whole = F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False))
            parts = [r[0] for r in made.select("part").union(stored.where(~whole).select("part")).distinct().collect()]
            if parts:
                kept = contents_of.read(parts, part=True).where(whole).join(made.select("sha256"), "sha256", "left_anti")
                contents_of.write(kept.select(*contents_of.columns, "part").unionByName(made.select(*contents_of.columns, "part")), parts)
            parts = [r[0] for r in mended.where(F.col("repaired").isin("restored", "relinked", "lost")).select("part").distinct().collect()]
            if parts:
                table.write(mended.where(F.col("part").isin(parts)).select(*table.columns, "part"), parts)
            return mended.groupBy("repaired").agg(F.count("*").alias("attachments"))

    def export(self, path: str) -> DataFrame:
        """Every live message as a Markdown file under path. Returns message_pk and path."""
        return files.write_markdown(self.table("messages").where("deleted_at is null"), path)

    def vacuum(self, keep: int = 2) -> None:
        """Takes away what no reader of the last versions needs."""
        with self.writing():
            for name in TABLES:
                self.store(name).vacuum(keep)
            index = self.indexes
            for own in (index.messages, index.chunks, index.bodies):
                own.vacuum()

    # copies

    def _summary(self, name: str, rows: DataFrame) -> tuple[str, int, str]:
        """Rows and a checksum that their order does not change."""
        r = rows.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("string")).first()
        return name, r[0], r[1]

    def backup(self, path: str) -> None:
        summary = []
        for name in TABLES:
            rows = self.store(name).read(part=True)
            rows.write.mode("errorifexists").parquet(f"{path}/{name}")
            summary.append(self._summary(name, self.spark.read.schema(f"{TABLES[name]}, part string").parquet(f"{path}/{name}")))
        self.spark.createDataFrame(summary, "name string, rows long, checksum string").coalesce(1).write.parquet(f"{path}/summary")

    def restore(self, path: str) -> None:
        """The backup becomes the newest version, once it is whole; what was there stays as the version before. The keyword
        indexes are written anew."""
        own = {name: self.spark.read.schema(f"{TABLES[name]}, part string").parquet(f"{path}/{name}") for name in TABLES}
        told = {r["name"]: (r["name"], r["rows"], r["checksum"]) for r in self.spark.read.parquet(f"{path}/summary").collect()}
        bad = [name for name, rows in own.items() if self._summary(name, rows) != told.get(name)]
        if bad:
            raise ValueError(f"the backup is damaged: {', '.join(bad)}")
        with self.writing():
            for name, rows in own.items():
                self.store(name).write(rows)
            index = self.indexes
            index.messages.add(self.table("messages"), fresh=True)
            index.bodies.add(self.table("messages"), fresh=True)
            index.chunks.add(self.table("chunks"), fresh=True)
