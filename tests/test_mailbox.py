"""Mail as a source: conditions and columns that keep files shut, large messages read in part, batches with a limit."""

from __future__ import annotations

import io
import random
from email import message_from_bytes, policy
from email.message import EmailMessage
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.archive import Archive
from tessera.functions import mime
from tessera.sources import mailbox, ranges


def mail(i: int, text: str, attachment: bytes | None = None, html: str | None = None) -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"], m["Message-ID"], m["Date"] = f"No. {i} über", f"A <a{i}@example.com>", "b@example.org", f"<{i}@x>", "Mon, 01 Jan 2024 10:00:00 +0000"
    m.set_content(text)
    if html is not None:
        m.add_alternative(html, subtype="html")
    if attachment is not None:
        m.add_attachment(attachment, maintype="application", subtype="pdf", filename=f"file {i}.pdf")
    return m.as_bytes()


@pytest.fixture
def box(tmp_path) -> Path:
    for folder, uids in (("INBOX", range(1, 31)), ("Sent", range(5, 9)), ("Empty", ())):
        (tmp_path / folder).mkdir()
        for u in uids:
            (tmp_path / folder / f"{u}.eml").write_bytes(mail(u, f"body {u}\n" * u))
    return tmp_path


def trap(box: Path, folder: str, uid: int) -> None:
    """A message that cannot be opened, only be seen."""
    path = box / folder / f"{uid}.eml"
    path.unlink(missing_ok=True)
    path.mkdir()


def uids(df) -> set:
    return {(r["folder"], r["uid"]) for r in df.select("folder", "uid").collect()}


def test_conditions_reach_the_listing(spark, box):
    mailbox.register(spark)
    for u in range(1, 28):
        trap(box, "INBOX", u)
    read = lambda: spark.read.format("mailbox").schema(mailbox.LISTED + ", content binary").load(str(box))
    assert uids(read().where("folder = 'INBOX' and number > 27").select("folder", "uid", "content").where("length(content) > 0")) == {("INBOX", str(u)) for u in (28, 29, 30)}
    assert uids(read().where("folder in ('Sent', 'Empty')")) == {("Sent", str(u)) for u in range(5, 9)}
    assert uids(read().where("uid = '29' and number >= 5 and number <= 29")) == {("INBOX", "29")}
    assert uids(read().where("uid = '029'")) == set() and uids(read().where("number = 3 and number = 4")) == set()
    (box / "INBOX" / "40.eml").write_bytes(mail(40, "x" * 90_000))
    assert uids(read().where("size_bytes > 50000")) == {("INBOX", "40")}
    assert uids(read().where("size_bytes < 50000 and folder = 'Sent' and uid <> '6'")) == {("Sent", str(u)) for u in (5, 7, 8)}
    scan = read().where("folder = 'INBOX' and number > 27")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in scan


def test_columns_keep_files_shut(spark, box):
    for folder, own in (("INBOX", range(1, 31)), ("Sent", range(5, 9))):
        for u in own:
            trap(box, folder, u)
    assert uids(spark.read.format("mailbox").schema("folder string, uid string").load(str(box))) >= {("INBOX", "1"), ("Sent", "8")}
    got = mailbox.mails(spark, str(box))
    assert got.agg(F.sum("size_bytes")).first()[0] > 0 and got.where("folder = 'Sent'").count() == 4
    status = {r["name"]: (r["messages"], r["next_uid"]) for r in mailbox.folder_status(spark, str(box)).collect()}
    assert status == {"INBOX": (30, 31), "Sent": (4, 9), "Empty": (0, 1)}
    (box / "Sent" / "9.eml").write_bytes(mail(9, "only this one can be opened"))
    own = mime.messages(mailbox.mails(spark, str(box)).where("folder = 'Sent' and number > 8").drop("header")).collect()
    assert [(r["uid"], r["subject"], r["body_text"]) for r in own] == [("9", "No. 9 über", "only this one can be opened")]


def test_headers_alone(spark, box):
    (box / "Sent" / "50.eml").write_bytes(mail(50, "y" * 3_000_000))
    got = {r["uid"]: r for r in mime.envelopes(mailbox.mails(spark, str(box)).select("folder", "uid", "header"), "header").where("folder = 'Sent'").collect()}
    assert got["50"]["message_id"] == "50@x" and got["50"]["subject"] == "No. 50 über" and got["6"]["sender"] == "a6@example.com"
    assert len(ranges.header_of(str(box / "Sent" / "50.eml"))) < 1000


def test_parts_are_where_the_map_says(tmp_path):
    r, inner = random.Random(2), mail(1, "inner", b"z" * 500)
    for i in range(40):
        raw = mail(i, "text " * r.randint(0, 40) + "\n--not a boundary\n", bytes(r.randbytes(r.randint(0, 3000))) if i % 2 else None, "<p>hi</p>" if i % 3 else None)
        if i % 5 == 0:
            m = EmailMessage()
            m.set_content("outer")
            m.add_attachment(EmailMessage() if i % 2 else message_from_bytes(inner, policy=policy.default))
            raw = m.as_bytes()
        raw = raw.replace(b"\n", b"\r\n") if i % 4 == 0 else raw
        parts = ranges.parts_of(io.BytesIO(raw))
        found = [(p.kind, raw[p.begin : p.end]) for p in parts]
        want = []
        stack = [message_from_bytes(raw)]
        while stack:
            p = stack.pop()
            if p.is_multipart() and p.get_content_type() != "message/rfc822":
                stack.extend(reversed(p.get_payload()))
            else:
                want.append((p.get_content_type(), p.get_payload(decode=True) if p.get_content_type() != "message/rfc822" else None))
        assert [k for k, _ in found] == [k for k, _ in want]
        for (_, body), part, (_, payload) in zip(found, parts, want, strict=True):
            if payload is not None:
                own = message_from_bytes(b"".join(f"{k}: {v}\n".encode() for k, v in part.header.items() if k.lower().startswith("content-")) + b"\n" + body)
                assert own.get_payload(decode=True).rstrip(b"\r\n") == payload.rstrip(b"\r\n")
    odd = b"Subject: x\nContent-Type: multipart/mixed; boundary=b\n\npreamble\n--b\nContent-Type: text/plain\n\nhello\n--b\n\nno end"
    assert [(p.section, odd[p.begin : p.end]) for p in ranges.parts_of(io.BytesIO(odd))] == [("1", b"hello"), ("2", b"no end")]
    assert [p.kind for p in ranges.parts_of(io.BytesIO(b""))] == [] and len(ranges.parts_of(io.BytesIO(b"Subject: only a header"))) == 1


def test_a_message_far_over_the_limit(spark, tmp_path):
    """Header and text of a message of 300 MB, most of it one line, without reading it."""
    box = tmp_path / "box"
    (box / "INBOX").mkdir(parents=True)
    (box / "INBOX" / "1.eml").write_bytes(mail(1, "small", b"p" * 100))
    raw = mail(2, "the text of a large message", b"@MARK@", "<p>the text of a <b>large</b> message</p>")
    head, _, tail = raw.partition(b"QE1BUktA")  # @MARK@
    with open(box / "INBOX" / "2.eml", "wb") as f:
        f.write(head)
        f.seek(300 << 20, 1)
        f.write(tail)
    content, parts = ranges.fetched(str(box / "INBOX" / "2.eml"), 1 << 20)
    assert len(content) < 5000 and [(p["content_type"], p["size"] > 300 << 20) for p in parts] == [("text/plain", False), ("text/html", False), ("application/pdf", True)]
    own = Archive(spark, str(tmp_path / "archive"))
    own.sync(mailbox.mails(spark, str(box), most_bytes=1 << 20))
    rows = {r["uid"]: r for r in own.table("messages").collect()}
    assert rows["2"]["subject"] == "No. 2 über" and "large" in rows["2"]["body_text"] and rows["2"]["size_bytes"] > 300 << 20 and rows["2"]["has_attachments"] and rows["2"]["error"] is None
    attachments = {(r["filename"], r["downloaded"], r["size_bytes"] > 1000) for r in own.table("attachments").collect()}
    assert attachments == {("file 1.pdf", True, False), ("file 2.pdf", False, True)}
    assert own.table("attachments").where("not downloaded and skip_reason is null").isEmpty()


def test_batches_with_a_limit_and_a_restart(spark, box, tmp_path_factory):
    mailbox.register(spark)
    place = str(tmp_path_factory.mktemp("stream"))
    batches: list[set] = []

    def run(stop_after: int | None = None):
        def take(df, _):
            if stop_after is not None and len(batches) >= stop_after:
                raise RuntimeError("killed")
            batches.append(uids(df))

        stream = spark.readStream.format("mailbox").option("max_messages", 7).option("checkpoint", place).load(str(box))
        q = stream.writeStream.foreachBatch(take).option("checkpointLocation", place).start()
        try:
            q.processAllAvailable()
        except Exception:  # noqa: BLE001  the stop that is wanted
            pass
        finally:
            q.stop()

    run(stop_after=2)
    assert len(batches) == 2
    run()
    assert [len(b) for b in batches] == [7, 7, 7, 7, 6] and len(set().union(*batches)) == 34
    (box / "Sent" / "77.eml").write_bytes(mail(77, "new"))
    run()
    assert batches[-1] == {("Sent", "77")} and len(batches) == 6
    with pytest.raises(Exception, match="checkpoint"):
        spark.readStream.format("mailbox").option("max_messages", 7).load(str(box)).writeStream.format("noop").option("checkpointLocation", str(tmp_path_factory.mktemp("other"))).start().processAllAvailable()


def test_stream_alone(spark, tmp_path):
    """The query's stream works in a session that has not read any mail before."""
    from tessera.plans import archive_runs

    rows = [(i, f"text {i}", "en", f"src{i % 2}") for i in range(7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = archive_runs.mailbox_stream(spark.newSession(), str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((s, str(i + 1)) for i, _, _, s in rows)
