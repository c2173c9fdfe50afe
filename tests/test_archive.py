from __future__ import annotations

from pyspark.sql import functions as F

from tessera.__main__ import main, parser, run
from tessera.archive import Archive
from tessera.functions.embedding import hashing
from tessera.functions.chunking import units_of
from tessera.functions.registry import register
from tessera.operators.filters import Filters
from tessera.sources import archive as sources


def raw(spark, n):
    return sources.demo_mail(spark, n).select(F.lit("demo").alias("account"), "folder", F.lit(1).cast("long").alias("uidvalidity"), "uid", F.octet_length("content").cast("long").alias("size_bytes"), "content")


def test_life_of_an_archive(spark, tmp_path):
    own = Archive(spark, str(tmp_path / "a"), embedder=hashing(64))
    first = own.sync(raw(spark, 12))
    assert sum(r["archived"] for r in first.collect()) == 12 and {r["status"] for r in first.collect()} == {"success"}
    assert sum(r["archived"] for r in own.sync(raw(spark, 12)).collect()) == 0
    counts = own.index().first()
    assert counts["messages"] == 12 and counts["embedded"] == counts["chunks"] > 0 and counts["reused"] == 0
    assert own.index().first()["messages"] == 0
    again = own.index(rebuild=True).first()
    assert again["messages"] == 12
    subject = own.page(limit=1).first()["subject"]
    hits = own.search(subject, limit=5).collect()
    assert hits and hits[0]["subject"] == subject and hits[0]["snippet"]
    assert all(h["folder"] == "INBOX" for h in own.search("message", Filters(folder=("INBOX",))).collect())
    assert own.search(subject, scope="subject").count() > 0 and own.search("example.com", scope="sender").count() > 0
    pk = str(hits[0]["message_pk"])
    found = own.message("demo-0@example.com").first()
    assert found["attachments"][0]["filename"].startswith("table-") and own.content(pk).first()["content"]
    assert own.chunks("demo-0@example.com").count() >= 1 and len(own.embed(["x"])[0]) == 64
    assert own.verify(deep=True).first()["healthy"] is True and own.health()["messages"] == 12
    own.backup(str(tmp_path / "b"))
    own.sync(raw(spark, 10), full=True)
    assert own.statistics().first()["live"] == 10 and own.page().first()["total"] == 10
    own.restore(str(tmp_path / "b"))
    assert own.statistics().first()["live"] == 12
    assert own.folders().agg(F.sum("total")).first()[0] == 12 and own.last_runs(3).count() == 3


def test_budget_stops_early_and_goes_on(spark, tmp_path):
    own = Archive(spark, str(tmp_path / "a"), embedder=hashing(64))
    assert sum(r["fetched"] for r in own.sync(raw(spark, 9), full=True, budget=4).collect()) == 4
    assert own.statistics().first()["live"] == 4
    own.sync(raw(spark, 9), full=True)
    assert own.statistics().first()["live"] == 9


def test_command_line(spark, tmp_path):
    own = Archive(spark, str(tmp_path / "a"), embedder=hashing(64))
    go = lambda *a: run(parser().parse_args([*a]), own)
    assert sum(r["archived"] for r in go("demo", "--count", "6")) == 6
    assert go("index")[0]["messages"] == 6 and len(go("search", "message", "--limit", "3")) == 3
    assert len(go("list", "--limit", "4")) == 4 and go("status")[0]["messages"] == 6 and go("doctor")[1]["healthy"]
    assert go("config")[0]["search"]["rrf_k"] == 60 and go("folders") and go("show", "demo-1@example.com")
    assert go("backup", str(tmp_path / "b")) and go("restore", str(tmp_path / "b"))[0]["done"] == "restore"
    assert main is not None


def test_registered_functions(spark):
    register(spark)
    text = "One sentence. " * 60
    rows = spark.sql(f"SELECT * FROM chunks('{text}')").collect()
    from tessera.functions.chunking import chunks

    own = chunks(spark.createDataFrame([(1, "m", text)], "message_pk long, message_id string, body_text string")).collect()
    assert [(r["chunk_index"], r["text"], r["token_count"]) for r in rows] == [(r["chunk_index"], r["text"], r["token_count"]) for r in own]
    assert spark.sql("SELECT html_to_markdown('<b>x</b>') AS m, size(embed_text('x')) AS n").first()[:] == ("**x**", 512)
    assert units_of("a\n\nb") == ["a", "b"]


def _raw(spark, rows):
    return spark.createDataFrame([(a, f, e, u, len(c), bytearray(c)) for a, f, e, u, c in rows], "account string, folder string, uidvalidity long, uid string, size_bytes long, content binary")


def _mail(subject, message_id, body="text", **more):
    return f"Subject: {subject}\r\nMessage-ID: <{message_id}>\r\nDate: Fri, 01 Mar 2024 10:00:00 +0000\r\n\r\n{body}\r\n".encode()


def test_sync_plans_folders(spark, tmp_path):
    """Watermarks, epochs, whole scans, copies in other folders, and folders of which nothing is known."""
    own = Archive(spark, str(tmp_path / "a"), embedder=hashing(64))
    mail = [("me", "A", 1, str(u), _mail(f"a{u}", f"a{u}@x")) for u in (1, 2, 3)] + [("me", "B", 1, "7", _mail("copy", "a2@x"))]
    first = {r["folder"]: r.asDict() for r in own.sync(_raw(spark, mail)).collect()}
    assert first["A"]["archived"] == 3 and first["B"]["archived"] == 1
    copies = {r["subject"]: r["duplicate_of"] is not None for r in own.table("messages").collect()}
    assert sum(copies.values()) == 1
    marks = {r["folder"]: (r["uidvalidity"], r["last_uid"]) for r in own.folders().collect()}
    assert marks == {"A": (1, 3), "B": (1, 7)}
    again = [r for r in mail if r[3] != "1"] + [("me", "A", 1, "4", _mail("a4", "a4@x"))]
    own.sync(_raw(spark, again))  # no whole scan is due: what is gone stays
    assert own.statistics().first()["live"] == 5 and own.table("messages").where("subject = 'a4'").count() == 1
    own.sync(_raw(spark, again), full=True)
    assert own.statistics().first()["live"] == 4
    own.sync(_raw(spark, mail), full=True)  # it comes back
    assert own.table("messages").where("subject = 'a1' and deleted_at is null").count() == 1
    epoch = [("me", "A", 2, str(u), _mail(f"new{u}", f"n{u}@x")) for u in (1, 2)] + [mail[3]]
    own.sync(_raw(spark, epoch))
    live = sorted(r["subject"] for r in own.page().collect())
    assert live == ["copy", "new1", "new2"] and {r["folder"]: (r["uidvalidity"], r["last_uid"]) for r in own.folders().collect()}["A"] == (2, 2)
    status = spark.createDataFrame([("me", "A", 2, 0), ("me", "B", 1, None)], "account string, name string, epoch long, messages long")
    own.sync(_raw(spark, mail), full=True, status=status)  # an empty folder lists nothing; of the other nothing is known
    assert own.statistics().first()["live"] == 3
    assert own.last_runs(50).where("folder = 'A'").count() == 6


def test_failed_messages_are_tried_again(spark, tmp_path, monkeypatch):
    from tessera.functions import mime
    from tessera.sources.config import load

    own = Archive(spark, str(tmp_path / "a"), load(overrides={"sync": {"max_attempts": 2}}), hashing(64))
    mail = _raw(spark, [("me", "A", 1, "1", _mail("good", "g@x")), ("me", "A", 1, "2", _mail("bad", "b@x"))])
    plain = mime.messages

    def failing(raw, **more):
        out = plain(raw, **more)
        return out.withColumn("error", F.when(F.col("uid") == "2", F.lit("broken")).otherwise(F.col("error")))

    monkeypatch.setattr(mime, "messages", failing)
    first = own.sync(mail).first()
    assert (first["archived"], first["failed"], first["status"], first["error_summary"]) == (1, 1, "partial", "broken")
    monkeypatch.setattr(mime, "messages", plain)
    assert own.sync(mail).first()["archived"] == 1 and own.table("messages").where("error is not null").count() == 0
    assert own.sync(mail).first()["fetched"] == 0
    monkeypatch.setattr(mime, "messages", failing)
    other = Archive(spark, str(tmp_path / "b"), load(overrides={"sync": {"max_attempts": 2}}), hashing(64))
    assert [other.sync(mail).first()["failed"] for _ in range(3)] == [1, 1, 0]


def test_one_writer(spark, tmp_path):
    import pytest

    from tessera.sources.folders import Locked

    own = Archive(spark, str(tmp_path / "a"), embedder=hashing(64))
    with own.writing(), pytest.raises(Locked):
        own.index()
    assert own.index().first()["messages"] == 0
    with own.writing():
        assert own.unlock() and not own.unlock()


def test_contents_are_stored_once_and_only_touched_parts_are_written(spark, tmp_path):
    from email.message import EmailMessage

    def with_file(subject, data):
        m = EmailMessage()
        m["Subject"], m["Message-ID"] = subject, f"<{subject}@x>"
        m.set_content("see file")
        m.add_attachment(data, maintype="application", subtype="pdf", filename="a.pdf")
        return bytes(m)

    own = Archive(spark, str(tmp_path / "a"), embedder=hashing(64))
    own.sync(_raw(spark, [("me", "A", 1, "1", with_file("one", b"same")), ("me", "B", 1, "1", with_file("two", b"same")), ("me", "B", 1, "2", with_file("three", b"other"))]))
    assert own.table("blobs").count() == 2 and own.table("attachments").where("skip_reason = 'reused'").count() == 1
    before = own.store("messages").parts()
    own.sync(_raw(spark, [("me", "B", 1, "1", b""), ("me", "B", 1, "2", b""), ("me", "B", 1, "3", with_file("four", b"same"))]))
    after = own.store("messages").parts()
    assert own.table("blobs").count() == 2 and own.table("attachments").count() == 4 and sum(after[p] != v for p, v in before.items()) == 1
    assert own.verify(deep=True).first()["healthy"] and own.attachment(own.table("attachments").first()["attachment_id"]).first()["payload"] is not None
    own.vacuum(keep=1)
    assert own.table("messages").count() == 4 and own.verify().first()["checked"] == 4
    own.index()
    assert own.search("three", limit=3).first()["subject"] == "three" and own.search("three", scope="subject").count() == 1
    made = own.export(str(tmp_path / "md")).collect()
    assert len(made) == 4 and sum(1 for _ in (tmp_path / "md").rglob("*.md")) == 4


def test_a_small_part_is_one_file(spark, tmp_path):
    """However many shuffle partitions there are: files would be parts times tasks else, and each read lists them. A part over
    the advised size is several."""
    from tessera.sources.store import Table

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    rows = spark.range(0, 3000, 1, 8).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"), F.when(F.col("id") < 40, F.col("id") % 10).otherwise(99).cast("string").alias("part"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 64)
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        own = Table(spark, f"{tmp_path}/t", "id long, text string")
        own.write(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = lambda part: len(list((tmp_path / "t" / "data" / "version=1" / f"part={part}").glob("*.parquet")))
    assert [files(i) for i in range(10)] == [1] * 10 and files(99) > 1
    assert own.read(part=True).count() == 3000 and own.read(["3"]).count() == 4


def test_a_damaged_backup_is_refused(spark, tmp_path):
    import pytest

    own = Archive(spark, str(tmp_path / "a"), embedder=hashing(64))
    own.sync(raw(spark, 5))
    own.backup(str(tmp_path / "b"))
    other = Archive(spark, str(tmp_path / "c"), embedder=hashing(64))
    other.restore(str(tmp_path / "b"))
    assert other.statistics().first()["messages"] == 5 and other.indexes.messages.counts()[0] == 5
    rows = spark.read.parquet(str(tmp_path / "b" / "messages"))
    rows.limit(4).write.parquet(str(tmp_path / "less"))
    import shutil

    shutil.rmtree(tmp_path / "b" / "messages")
    shutil.move(tmp_path / "less", tmp_path / "b" / "messages")
    with pytest.raises(ValueError, match="messages"):
        other.restore(str(tmp_path / "b"))


def test_deleted_messages_leave_the_index(spark, tmp_path):
    own = Archive(spark, str(tmp_path / "a"), embedder=hashing(64))
    mail = [("me", "A", 1, str(u), _mail(f"a{u}", f"a{u}@x", f"word{u} again")) for u in (1, 2, 3)]
    own.sync(_raw(spark, mail))
    own.index()
    assert own.table("chunks").count() == 3 and own.indexes.chunks.counts()[0] == 3
    own.sync(_raw(spark, mail[1:]), full=True)
    own.index()
    assert own.table("chunks").count() == 2 and own.indexes.chunks.counts()[0] == 2 and own.search("word1", mode="keyword").count() == 0


def test_stored_contents_come_back_from_files(spark, tmp_path):
    """One content is damaged and one gone; a folder still has a file of the first, under another name."""
    from email.message import EmailMessage

    def mail(subject, data):
        m = EmailMessage()
        m["Subject"], m["Message-ID"] = subject, f"<{subject}@x>"
        m.set_content("see file")
        m.add_attachment(data, maintype="application", subtype="pdf", filename="a.pdf")
        return bytes(m)

    own = Archive(spark, str(tmp_path / "a"), embedder=hashing(64))
    own.sync(_raw(spark, [("me", "A", 1, "1", mail("one", b"same")), ("me", "B", 1, "1", mail("two", b"same")), ("me", "C", 1, "1", mail("three", b"other")), ("me", "D", 1, "1", mail("four", b"whole"))]))
    assert {tuple(r) for r in own.repair().collect()} == {("ok", 4)}
    before = {name: own.store(name).parts() for name in ("blobs", "attachments")}
    assert {tuple(r) for r in own.repair().collect()} == {("ok", 4)} and {name: own.store(name).parts() for name in before} == before
    stored = own.store("blobs").read(part=True)
    own.store("blobs").write(stored.where(F.col("payload") != b"other").withColumn("payload", F.when(F.col("payload") == b"same", F.lit(b"bad")).otherwise(F.col("payload"))))
    assert not own.verify(deep=True).first()["healthy"]
    (tmp_path / "found" / "deep").mkdir(parents=True)
    (tmp_path / "found" / "deep" / "saved.bin").write_bytes(b"same")
    (tmp_path / "found" / "other.pdf").write_bytes(b"changed")
    got = run(parser().parse_args(["repair-blobs", "--found", str(tmp_path / "found")]), own)
    assert {r["repaired"]: r["attachments"] for r in got} == {"restored": 2, "lost": 1, "ok": 1}
    assert sorted(bytes(r["payload"]) for r in own.table("blobs").collect()) == [b"same", b"whole"] and own.verify(deep=True).first()["healthy"]
    lost = own.table("attachments").where("skip_reason = 'lost'").collect()
    assert len(lost) == 1 and not lost[0]["downloaded"] and own.table("attachments").count() == 4
    own.sync(_raw(spark, [("me", "C", 1, "2", mail("five", b"other"))]))
    assert sorted(bytes(r["payload"]) for r in own.table("blobs").collect()) == [b"other", b"same", b"whole"] and own.verify(deep=True).first()["healthy"]


def test_a_damaged_content_without_a_copy_goes(spark, tmp_path):
    from tessera.archive import BLOBS

    own = Archive(spark, str(tmp_path / "a"), embedder=hashing(64))
    assert own.repair().count() == 0
    own.store("blobs").write(spark.createDataFrame([("ab" * 32, "x", bytearray(b"bad"), "ab")], f"{BLOBS}, part string"))
    assert own.repair().count() == 0 and own.table("blobs").count() == 0


def test_queries_of_mail_take_no_index_run(spark, tmp_path):
    import duckdb

    from tessera.plans import archive_runs

    spark.createDataFrame([(i, ("en", "de")[i % 2], f"src{i % 4}", f"text of {i}") for i in range(45)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        for name in ("archive_messages", "archive_sync_log", "archive_folders", "archive_field_search", "archive_point_lookup", "markdown_export"):
            found = archive_runs.CATALOG.queries[name](spark, str(tmp_path))
            told = db.execute(archive_runs.CATALOG.sql[name])
            columns = [c[0] for c in told.description]
            assert sorted(map(str, found.select(columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, told.df().itertuples(index=False, name=None))), name
    made = [a for place, a in archive_runs._MADE.items() if place[1] == str(tmp_path)]
    assert len(made) == 1 and not made[0].store("chunks").parts() and made[0].indexes.messages.counts()[0] == 45
