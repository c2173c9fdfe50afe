from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import archive, config, mailbox
from tessera.streaming import index_stream


@pytest.fixture
def box(tmp_path):
    for folder, uids in (("INBOX", (1, 2, 10)), ("Sent", (4,)), ("Spam", (9,))):
        (tmp_path / folder).mkdir()
        for u in uids:
            (tmp_path / folder / f"{u}.eml").write_bytes(f"Subject: {folder} {u}\r\n\r\nbody {u}\r\n".encode())
    return tmp_path


def seen(df):
    return sorted((r["folder"], r["uidvalidity"], r["uid"]) for r in df.collect())


def test_mailbox_batch(spark, box):
    mailbox.register(spark)
    read = lambda **o: spark.read.format("mailbox").options(**o).load(str(box))
    assert seen(read(exclude="spam")) == [("INBOX", 1, "1"), ("INBOX", 1, "10"), ("INBOX", 1, "2"), ("Sent", 1, "4")]
    assert seen(read(folders="INBOX", since="2")) == [("INBOX", 1, "10")]
    assert seen(mailbox.message_files(spark, str(box))) == seen(read())
    status = {r["name"]: (r["messages"], r["next_uid"]) for r in mailbox.folder_status(spark, str(box)).collect()}
    assert status["INBOX"] == (3, 11)


def test_mailbox_stream_is_incremental_and_epochs_reset(spark, box, tmp_path_factory):
    mailbox.register(spark)
    place = tmp_path_factory.mktemp("stream")
    batches: list[list[tuple]] = []

    def run():
        q = spark.readStream.format("mailbox").load(str(box)).writeStream.foreachBatch(lambda df, _: batches.append(seen(df))).option("checkpointLocation", str(place)).start()
        q.processAllAvailable()
        q.stop()

    run()
    (box / "INBOX" / "11.eml").write_bytes(b"Subject: new\r\n\r\nx")
    run()
    mailbox.set_epoch(str(box), "Sent", 2)
    run()
    assert len([x for b in batches[:1] for x in b]) == 5
    rest = [x for b in batches[1:] for x in b]
    assert rest == [("INBOX", 1, "11"), ("Sent", 2, "4")]


def test_markdown_round_trip(spark, tmp_path):
    schema = "message_pk long, folder string, subject string, uid string, d string, body_markdown string, has_attachments boolean, attachment_names array<string>, sender string, sender_name string"
    rows = [(1, "a/b", 'Quote "x": y\\z', "7", "2024-03-01 10:00:00", "# body\n\n---\ntext", True, ['b".txt', "报.pdf"], "l@x", "Li"), (2, "c", "plain", "8", None, "", False, None, "h@x", ""), (3, "a/b", 'Quote "x": y\\z', "7", "2024-03-01 10:00:00", "other", False, None, None, None)]
    own = spark.createDataFrame(rows, schema).withColumn("date_utc", F.to_timestamp("d")).drop("d")
    made = {r["message_pk"]: r["path"] for r in archive.write_markdown(own, str(tmp_path / "md 1+2")).collect()}
    assert sorted(str(p.relative_to(tmp_path / "md 1+2")) for p in (tmp_path / "md 1+2").rglob("*") if p.is_file() and not p.name.startswith("_")) == sorted(made.values())
    assert made[1].startswith("a/b/20240301_100000_Quote") and made[3] == made[1].replace(".md", "_1.md")
    out = {r["path"]: r for r in archive.read_markdown(spark, str(tmp_path / "md 1+2")).collect()}
    assert set(out) == set(made.values())
    first, second = out[made[1]], out[made[2]]
    assert set(first["front"]) == set(archive.FIELDS) and len(archive.FIELDS) == 18
    assert first["body"] == "# body\n\n---\ntext" and first["front"]["subject"] == first["subject"] == 'Quote "x": y\\z'
    assert first["front"]["from"] == "Li <l@x>" and first["front"]["attachment_count"] == "2" and first["front"]["has_attachments"] == "true" and first["front"]["uid"] == "7"
    assert second["front"]["date"] == "" and second["body"] == archive.NO_BODY and second["front"]["from"] == "h@x" and out[made[3]]["body"] == "other"
    (tmp_path / "md 1+2" / "plain.md").write_text("# T\n\nno front")
    loose = {r["path"]: r for r in archive.read_markdown(spark, str(tmp_path / "md 1+2")).collect()}["plain.md"]
    assert loose["front"] == {} and loose["subject"] == "T" and loose["body"] == "no front"
    try:
        import yaml
    except ImportError:
        return
    text = (tmp_path / "md 1+2" / made[1]).read_text()
    assert yaml.safe_load(text.split("---")[1])["attachments"] == ['b".txt', "报.pdf"]


def test_a_failed_export_leaves_the_old_one(spark, tmp_path):
    """Tasks that fail, a driver lost between its two moves, and folders that are no export."""
    import pytest
    from tessera.sources.markdown_sink import MARK, export

    to = tmp_path / "md"
    held = lambda: {str(p.relative_to(to)): p.read_text() for p in to.rglob("*") if p.is_file() and p.name != MARK}
    rows = lambda n, tag: spark.range(n).repartition(3).selectExpr("concat('f', id % 2, '/', id, '.md') path", f"concat('{tag}', id) document")
    export(rows(20, "old"), str(to))
    old = {f"f{i % 2}/{i}.md": f"old{i}" for i in range(20)}
    assert held() == old
    with pytest.raises(Exception, match="no place"):
        export(rows(20, "new").selectExpr("if(path = 'f1/7.md', '../7.md', path) path", "document"), str(to))
    assert held() == old and [p.name for p in tmp_path.iterdir()] == ["md"]
    with pytest.raises(Exception, match="overwrite"):
        rows(1, "x").write.format("markdown_export").mode("append").save(str(to))
    export(rows(5, "new"), f"file://{to}")
    assert held() == {f"f{i % 2}/{i}.md": f"new{i}" for i in range(5)}
    to.rename(tmp_path / "md.old")
    with pytest.raises(Exception, match="no place"):
        export(rows(3, "x").selectExpr("'/a.md' path", "document"), str(to))
    assert len(held()) == 5 and [p.name for p in tmp_path.iterdir()] == ["md"]
    export(rows(0, "x"), str(to))
    assert held() == {} and (to / MARK).exists()
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "letter.txt").write_text("keep")
    with pytest.raises(Exception, match="no export"):
        export(rows(3, "x"), str(tmp_path / "mine"))
    assert [p.name for p in (tmp_path / "mine").iterdir()] == ["letter.txt"]


def test_queries_snapshot_and_demo(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("# comment\nrelevant\thow to\nirrelevant\tmoon\n")
    assert [tuple(r) for r in archive.read_queries(spark, str(tmp_path / "q.tsv")).collect()] == [("relevant", "how to"), ("irrelevant", "moon")]
    demo = archive.demo_mail(spark, 12)
    assert [tuple(r) for r in demo.collect()] == [tuple(r) for r in archive.demo_mail(spark, 12).collect()]
    from tessera.functions.mime import messages

    assert messages(demo).where("error is null and sender like '%example%'").count() == 12
    archive.write_snapshot({"demo": demo}, str(tmp_path / "snap"))
    assert archive.read_snapshot(spark, str(tmp_path / "snap"), ["demo"])["demo"].count() == 12
    with pytest.raises(Exception):  # noqa: B017
        archive.write_snapshot({"demo": demo}, str(tmp_path / "snap"))


def test_config():
    own = config.load({"search": {"rrf_k": 10}, "sync": {"exclude_folders": ["Spam"]}}, {"TESSERA_SEARCH__RRF_K": "20", "TESSERA_CLEAN__STRIP_LEGAL": "false", "OTHER": "1"}, {"search": {"default_limit": 5}})
    assert (own.search.rrf_k, own.search.default_limit, own.clean.strip_legal, own.sync.exclude_folders) == (20, 5, False, ("Spam",))
    assert config.coerced("1.5") == 1.5 and config.coerced("a,b") == ("a", "b") and config.coerced("yes") is True
    for bad in ({"embedding": {"chunk_size": 10, "chunk_overlap": 10}}, {"clean": {"noise_tail_ratio": 2}}, {"sync": {"interval_minutes": 0}}):
        with pytest.raises(ValueError):
            config.load(bad, {})


EVENTS = [("r", 1, "run_start", None, None, None), ("r", 2, "folder_start", "INBOX", 2, None), ("r", 3, "fetch_plan", "INBOX", 3, None), ("r", 4, "message_archived", None, None, None), ("r", 5, "message_failed", None, None, None), ("r", 6, "message_archived", None, None, None), ("r", 7, "folder_done", None, None, None), ("r", 8, "run_done", None, None, "partial")]
LOG = "run_id string, seq long, event string, folder string, number long, status string"


def test_progress_stream_equals_batch(spark, tmp_path):
    for i, part in enumerate((EVENTS[:4], EVENTS[4:])):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 * (1 - i))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = index_stream.progress(stream).writeStream.format("memory").queryName("progress").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("select * from progress order by archived desc, folders_done desc limit 1").first()
    assert (last["phase"], last["done"], last["total"], last["archived"], last["failed"], last["folders_done"], last["percent"]) == ("partial", 3, 3, 2, 1, 1, 100.0)
    batch = index_stream.batch_progress(spark.createDataFrame(EVENTS, LOG)).first()
    assert (batch["done"], batch["total"], batch["archived"], batch["failed"]) == (3, 3, 2, 1)


def test_rates(spark):
    own = spark.createDataFrame([(5, 10, "2024-01-01 00:00:00"), (0, 10, "2024-01-01 00:00:00"), (10, 10, "2024-01-01 00:00:00")], "done long, total long, t string").withColumn("started_at", F.to_timestamp("t"))
    got = [(r["elapsed"], r["rate"], r["eta"]) for r in index_stream.rates(own, now=F.lit("2024-01-01 00:00:10").cast("timestamp")).collect()]
    assert got == [(10.0, 0.5, 10.0), (10.0, 0.0, None), (10.0, 1.0, None)]


def test_streams(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00", 1.0), (1, "a", "2024-01-01 00:10:00", 1.0), (2, "a", "2024-01-01 02:00:00", 2.0)]
    own = spark.createDataFrame(rows, "k long, event_type string, t string, value double").withColumn("ts", F.to_timestamp("t"))
    own.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(own.schema).parquet(str(tmp_path / "in"))
    q = index_stream.without_copies(stream, ["k"], "ts").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 2
    q = index_stream.activity(stream, width="1 hour").writeStream.format("memory").queryName("act").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(str(r["window_start"]), r["n"]) for r in spark.table("act").collect()} == {("2024-01-01 00:00:00", 2), ("2024-01-01 02:00:00", 1)}
    assert index_stream.sessions(own, "k").count() == 2
    index_stream.merge_batches(stream.select("k", "value", "ts"), str(tmp_path / "t"), str(tmp_path / "c"), ["k"], "ts").awaitTermination()
    assert {(r["k"], str(r["ts"])) for r in index_stream.latest_version(spark, str(tmp_path / "t")).collect()} == {(1, "2024-01-01 00:10:00"), (2, "2024-01-01 02:00:00")}


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from tessera.sources.scratch import scratch

    def session(master):
        folders = []
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: folders[-1] if folders else None, setCheckpointDir=folders.append)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)

    for master in ("spark://a:7077", "yarn", "k8s://x", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            scratch(session(master))
    for master in ("local", "local[8]", "local[*]", "local[4, 2]"):
        assert scratch(session(master))


def test_yaml_configuration(tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump({"search": {"rrf_k": 7, "unknown": 1}, "sync": {"exclude_folders": ["Spam"]}}))
    own = config.load(config.from_yaml(str(tmp_path / "c.yaml")), env={"TESSERA_SEARCH__DEFAULT_LIMIT": "3"})
    assert own.search.rrf_k == 7 and own.search.default_limit == 3 and own.sync.exclude_folders == ("Spam",)
    assert config.from_yaml(str(tmp_path / "none.yaml")) == {}
    (tmp_path / "d.yaml").write_text("- 1")
    with pytest.raises(ValueError, match="mapping"):
        config.from_yaml(str(tmp_path / "d.yaml"))


def test_tables_are_read_in_small_batches(spark, tmp_path):
    """What a worker of a UDF holds at once does not follow the number or the length of texts."""
    from tessera.sources import tables

    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.range(5000).selectExpr("id", "repeat('x', 5000) AS text").coalesce(1).write.parquet(f"{tmp_path}/t.parquet")

        def count(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_pydict({"id": [b.num_rows]})

        sizes = tables.read(spark, str(tmp_path), "t").mapInArrow(count, "id long")
        assert max(r[0] for r in sizes.collect()) <= tables.BATCH_ROWS
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
        tables.small_batches(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "64"
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
