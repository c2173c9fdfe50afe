from __future__ import annotations

from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from tessera.functions import mime


def build(html=None, attachments=(), inline=(), charset="utf-8", **headers) -> bytes:
    m = EmailMessage()
    base = {"Subject": "报销 report", "From": "李雷 <Li.Lei@Corp.com>", "To": "a@x.com, B <b@x.com>", "Date": "Fri, 01 Mar 2024 10:00:00 +0800", "Message-ID": "<msg-1@corp.com>"} | headers
    for k, v in base.items():
        if v is not None:
            m[k] = v
    m.set_content("hello body\n", charset=charset)
    if html:
        m.add_alternative(html, subtype="html")
        for cid, data in inline:
            m.get_payload()[1].add_related(data, "image", "png", cid=f"<{cid}>")
    for name, data in attachments:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return bytes(m)


def test_headers_and_bodies():
    out = mime.parse(build())
    assert out["subject"] == "报销 report" and out["sender"] == "li.lei@corp.com" and out["sender_name"] == "李雷"
    assert out["recipients"] == "a@x.com, B <b@x.com>" and out["message_id"] == "msg-1@corp.com"
    assert out["date_utc"].isoformat() == "2024-03-01T02:00:00+00:00" and out["text_plain"].strip() == "hello body"
    assert mime.parse(build(Subject=None))["subject"] == mime.NO_SUBJECT
    assert mime.parse(build(Date="whenever"))["date_utc"] is None
    raw = b"Subject: =?gbk?B?" + __import__("base64").b64encode("发票".encode("gbk")) + b"?=\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n" + "发票内容很多".encode("gbk")
    wrong = mime.parse(raw)
    assert wrong["subject"] == "发票" and "发票内容很多" in wrong["text_plain"]
    assert mime.header_text(b"=?utf-8?Q?caf=C3=A9?=") == "café" and mime.header_text("=?bad?X?zz?=")


def test_attachments_and_inline_parts():
    nested = EmailMessage()
    nested["Subject"] = "inner"
    nested.set_content("inner body")
    m = EmailMessage()
    m.set_content("outer")
    m.add_attachment(nested)
    out = mime.parse(bytes(m))
    assert [a["content_type"] for a in out["attachments"]] == ["message/rfc822"] and b"inner body" in out["attachments"][0]["payload"]
    out = mime.parse(build("<p>x<img src='cid:pic'></p>", [("表.xlsx", b"12345")], [("pic", b"PNG")]))
    kinds = {a["filename"]: (a["is_inline"], a["size_bytes"]) for a in out["attachments"]}
    assert kinds["表.xlsx"] == (False, 5) and kinds["inline_pic.png"] == (True, 3)
    named = b'Content-Type: application/pdf; name="=?utf-8?B?5oql?="\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJD'
    assert mime.parse(named)["attachments"][0]["filename"] == "报"
    long_name = b"Content-Type: application/pdf\r\nContent-Disposition: attachment; filename*=utf-8''%E6%8A%A5.pdf\r\n\r\nx"
    assert mime.parse(long_name)["attachments"][0]["filename"] == "报.pdf"


def test_messages(spark):
    rows = [("1", build("<p>Hi <b>there</b><img src='cid:pic'></p><script>x</script>", [("big.bin", b"x" * 2048), ("empty.bin", b"")], [("pic", b"PNG")])), ("2", build()), ("3", b""), ("4", None)]
    raw = spark.createDataFrame(rows, "uid string, content binary")
    out = {r["uid"]: r for r in mime.messages(raw, most=1024).collect()}
    first = out["1"]
    assert "Hi **there**" in first["body_markdown"] and "attachments/inline_pic.png" in first["body_markdown"] and first["has_attachments"]
    decided = {a["filename"]: (a["downloaded"], a["skip_reason"], a["payload"] is not None) for a in first["attachments"]}
    assert decided["big.bin"][0] is False and decided["big.bin"][1].startswith("超过大小阈值") and not decided["big.bin"][2]
    assert decided["empty.bin"] == (False, "附件内容为空", False) and decided["inline_pic.png"][0]
    assert out["2"]["body_text"] == "hello body" and not out["2"]["has_attachments"]
    assert out["3"]["body_text"] == mime.NO_BODY and out["4"]["error"] is None
    off = mime.messages(raw.where("uid = 1"), download=False).first()["attachments"]
    assert {a["skip_reason"] for a in off} == {"配置为不下载附件"}


STRUCTURE = b'1 (UID 7 BODYSTRUCTURE ((("text" "plain" ("charset" "utf-8") NIL NIL "base64" 120 3 NIL NIL NIL)("text" "html" NIL NIL NIL "7bit" 400 9) "alternative")("application" "pdf" ("name" "=?utf-8?B?5oql?=") NIL NIL "base64" 99999999 NIL ("attachment" ("filename" "x.pdf")))("message" "rfc822" NIL NIL NIL "7bit" 50 NIL ("text" "plain" NIL NIL NIL "7bit" 5 1)) "mixed"))'


def test_dates_beyond_nanoseconds(spark):
    """Mail of any year is read; 64 bits of nanoseconds would end in 2262."""
    dates = ["Fri, 01 Jan 2400 10:00:00 +0800", "Sat, 01 Jan 1600 00:00:00 +0000", "whenever", "Fri, 31 Dec 9999 23:00:00 -0500"]
    raw = spark.createDataFrame([(str(i), build(Date=d)) for i, d in enumerate(dates)], "uid string, content binary")
    for rows in (mime.messages(raw), mime.envelopes(raw)):
        out = rows.orderBy("uid").select(F.date_format("date_utc", "yyyy-MM-dd HH:mm:ss"), "subject").collect()
        assert [tuple(r) for r in out] == [("2400-01-01 02:00:00", "报销 report"), ("1600-01-01 00:00:00", "报销 report"), (None, "报销 report"), (None, "报销 report")]


def test_body_structures(spark):
    parts = mime.leaf_parts(STRUCTURE)
    assert [p["section"] for p in parts] == ["1.1", "1.2", "2", "3", "3.1"]
    assert parts[2]["filename"] == "报" and parts[2]["disposition"] == "attachment" and parts[0]["encoding"] == "BASE64" and parts[0]["lines"] == 3
    for bad in (b"", b"((", b'("text', None, b")("):
        assert isinstance(mime.leaf_parts(bad), list)
    own = spark.createDataFrame([(1, STRUCTURE, 10**9), (2, STRUCTURE, 1000), (3, None, 10**9)], "id int, s binary, size long").withColumn("parts", mime.body_structure("s"))
    got = {r["id"]: (r["plan"], r["text"]) for r in own.select("id", mime.fetch_plan("size", "parts", 50 << 20).alias("plan"), mime.text_sections("parts").alias("text")).collect()}
    assert got == {1: ("partial", ["1.1", "1.2", "3.1"]), 2: ("full", ["1.1", "1.2", "3.1"]), 3: ("full", [])}


def test_envelopes_and_parts_left_out(spark):
    raw = spark.createDataFrame([("1", build()), ("2", b"")], "uid string, content binary")
    out = {r["uid"]: (r["subject"], r["sender"]) for r in mime.envelopes(raw).collect()}
    assert out == {"1": ("报销 report", "li.lei@corp.com"), "2": (mime.NO_SUBJECT, "")}
    assert b"hello body" not in bytes(raw.select(mime.header_bytes("content").alias("h")).first()["h"])
    own = spark.createDataFrame([(STRUCTURE,)], "s binary").select(mime.parts_not_fetched(mime.body_structure("s"), 50 << 20).alias("a")).first()["a"]
    assert [(a["filename"], a["downloaded"], a["skip_reason"].startswith("超过")) for a in own] == [("报", False, True), ("attachment_2", False, False)]


@pytest.mark.parametrize("name", ["utf-8", "gb18030", "latin-1"])
def test_charsets(name):
    assert mime.body_text("déjà vu".encode(name, "replace") if name != "gb18030" else "报销".encode(name), name)


def test_parts_are_quarantined():
    assert mime.parsed(b"\xff\xfe\x00broken")["error"] is None
    assert F is not None


def test_a_message_with_a_large_part_is_fetched_in_part(spark):
    raw = build("<p>x</p>", [("big.bin", b"x" * 4096), ("small.bin", b"y")])
    own = spark.createDataFrame([("1", raw, len(raw)), ("2", raw, 10)], "uid string, content binary, size_bytes long")
    out = {r["uid"]: {a["filename"]: (a["downloaded"], a["skip_reason"], a["payload"] is None) for a in r["attachments"]} for r in mime.messages(own, most=1024).collect()}
    assert out["1"]["small.bin"] == (False, mime.TOO_LARGE, True) and out["1"]["big.bin"][1].startswith("超过大小阈值")
    assert out["2"]["small.bin"] == (True, None, False) and not out["2"]["big.bin"][0]


def test_parts_of_forwarded_mail_stay_inside():
    inner = EmailMessage()
    inner["Subject"] = "inner"
    inner.set_content("inner body")
    inner.add_attachment(b"123", maintype="application", subtype="pdf", filename="in.pdf")
    m = EmailMessage()
    m.set_content("outer")
    m.add_attachment(inner)
    out = mime.parse(bytes(m))
    assert out["text_plain"].strip() == "outer" and [a["content_type"] for a in out["attachments"]] == ["message/rfc822"]
