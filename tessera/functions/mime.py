"""Mail messages: MIME trees and BODYSTRUCTURE lists by UDFs, policies and plans over their parts by expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from email import message_from_bytes
from email.header import decode_header, make_header
from email.message import Message
from email.utils import collapse_rfc2231_value, getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import EXTENSIONS, _col, safe_filename

# Character sets that are tried after the declared one, types that are attachments without a name, headers
# that are kept, and what stands for what is missing.
CHARSETS = ("utf-8", "gb18030", "big5", "shift_jis", "euc-kr", "latin-1")
ATTACHED = ("application/", "image/", "audio/", "video/", "message/rfc822", "text/calendar", "text/csv")
KEPT_HEADERS = ("List-Id", "List-Unsubscribe", "X-Mailer", "Return-Path", "Delivered-To")
NO_SUBJECT, NO_BODY, TOO_LARGE = "(无主题)", "(此邮件无正文内容)", "整封邮件过大，未下载附件"
MOST_BODY, MOST_ATTACHMENT = 2 * 1024 * 1024, 50 * 1024 * 1024

ATTACHMENT = T.StructType(
    [
        T.StructField("part_index", T.IntegerType()),
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("content_id", T.StringType()),
        T.StructField("is_inline", T.BooleanType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
MESSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("message_id", "subject", "sender", "sender_name", "recipients", "cc", "reply_to", "in_reply_to", "references", "date_raw")]
    + [T.StructField("date_utc", T.TimestampType()), T.StructField("text_plain", T.StringType()), T.StructField("text_html", T.StringType())]
    + [T.StructField("raw_headers", T.MapType(T.StringType(), T.StringType())), T.StructField("attachments", T.ArrayType(ATTACHMENT)), T.StructField("error", T.StringType())]
)


def text_of(raw: bytes) -> str:
    for name in CHARSETS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def header_text(value) -> str:
    """An RFC 2047 header as text; what is malformed is read as far as it goes."""
    if value is None:
        return ""
    text = text_of(bytes(value)) if isinstance(value, (bytes, bytearray)) else str(value)
    if "=?" not in text:
        return text
    pieces = decode_header(text)
    try:
        return str(make_header(pieces))
    except (LookupError, ValueError):
        return "".join(p if isinstance(p, str) else text_of(p) for p, _ in pieces)


def body_text(payload: bytes, declared: str | None) -> str:
    """The first character set that reads all of it; else the one with the fewest signs it cannot read."""
    best: tuple[float, str] | None = None
    for name in dict.fromkeys([*([declared.lower()] if declared else []), *CHARSETS]):
        try:
            text = payload.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        bad = text.count("�")
        if not bad:
            return text
        share = bad / max(1, len(text))
        if best is None or share < best[0]:
            best = share, text
    return best[1] if best else payload.decode("utf-8", "replace")


def part_name(part: Message) -> str:
    raw = part.get_filename() or part.get_param("name", header="content-type")
    return re.sub(r"[\r\n]", "", header_text(collapse_rfc2231_value(raw) if raw else "")).strip()


def addresses(value) -> list[str]:
    """name <address> of each address of a header."""
    raw = header_text(value)
    return [f"{n} <{a}>" if n and a else a or n for n, a in ((n.strip(), a.strip()) for n, a in getaddresses([raw])) if n or a] if raw else []


def payload_of(part: Message) -> bytes:
    try:
        payload = part.get_payload(decode=True)
    except (ValueError, LookupError, AssertionError):
        return b""
    if payload is None:
        raw = part.get_payload()
        return raw.encode("utf-8", "replace") if isinstance(raw, str) else b""
    return payload


def _date(raw: str):
    try:
        when = parsedate_to_datetime(raw)
    except (TypeError, ValueError, IndexError):
        return None
    from datetime import UTC

    try:
        return when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)
    except OverflowError:  # beyond the year 9999
        return None


def parse(raw: bytes) -> dict:
    """One message as MESSAGE has it, payloads included; policies come after."""
    import hashlib

    mail = message_from_bytes(raw)
    sender = next(iter(addresses(mail.get("From"))), "")
    shown = re.fullmatch(r"(.*?)\s*<([^>]+)>", sender)
    date_raw = header_text(mail.get("Date")).strip()
    bodies: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    found: list[dict] = []
    waiting = [mail]
    while waiting:  # what a forwarded message holds stays inside it
        part = waiting.pop()
        if part.is_multipart() and part.get_content_type() != "message/rfc822":
            waiting.extend(reversed(part.get_payload()))
        kind, disposition, name = part.get_content_type().lower(), (part.get_content_disposition() or "").lower(), part_name(part)
        cid = header_text(part.get("Content-ID")).strip().strip("<>").strip()
        if kind == "message/rfc822":
            payload, name, inline = b"".join(x.as_bytes() for x in part.get_payload()) if part.is_multipart() else payload_of(part), name or f"forwarded_{len(found) + 1}.eml", False
        elif part.is_multipart():
            continue
        elif kind in bodies and disposition != "attachment" and not name:
            text = body_text(payload_of(part), part.get_content_charset())[:MOST_BODY]
            if text.strip():
                bodies[kind].append(text)
            continue
        else:
            inline = disposition == "inline" or bool(cid)
            if not name and not inline and not kind.startswith(ATTACHED):
                continue
            name = name or (f"inline_{cid or len(found) + 1}{EXTENSIONS.get(kind, '.bin')}" if inline else f"attachment_{len(found) + 1}")
            payload = payload_of(part)
        found.append({"part_index": len(found) + 1, "filename": name, "content_type": kind or "application/octet-stream", "size_bytes": len(payload), "content_id": cid or None, "is_inline": inline, "sha256": hashlib.sha256(payload).hexdigest() if payload else None, "payload": payload})
    return {
        "message_id": header_text(mail.get("Message-ID")).strip().strip("<>").strip()[:512],
        "subject": header_text(mail.get("Subject")) or NO_SUBJECT,
        "sender": (shown[2] if shown else sender).strip().lower(),
        "sender_name": shown[1].strip().strip('"').strip() if shown else "",
        "recipients": ", ".join(addresses(mail.get("To"))),
        "cc": ", ".join(addresses(mail.get("Cc"))),
        "reply_to": next(iter(addresses(mail.get("Reply-To"))), ""),
        "in_reply_to": header_text(mail.get("In-Reply-To")),
        "references": header_text(mail.get("References")),
        "date_raw": date_raw,
        "date_utc": _date(date_raw) if date_raw else None,
        "text_plain": "\n\n".join(bodies["text/plain"]),
        "text_html": "\n\n".join(bodies["text/html"]),
        "raw_headers": {k: header_text(mail[k])[:500] for k in KEPT_HEADERS if mail[k]},
        "attachments": found,
        "error": None,
    }


def parsed(raw: bytes | None) -> dict:
    """A message that cannot be parsed is a row with its error, not a failure of the others."""
    try:
        return parse(bytes(raw or b""))
    except Exception as e:  # noqa: BLE001  quarantined in the error column
        return {f.name: None for f in MESSAGE} | {"error": f"{type(e).__name__}: {e}"[:500]}


def parse_mail(c: Column | str) -> Column:
    """MESSAGE of a binary column."""

    @F.pandas_udf(MESSAGE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out = pd.DataFrame([parsed(x) for x in s], columns=MESSAGE.names)
            out["date_utc"] = pd.Series(list(out["date_utc"]), dtype="datetime64[us, UTC]")  # nanoseconds would end in 2262
            yield out

    return run(c)


def attachment_policy(attachments: Column | str, most: int = MOST_ATTACHMENT, download: bool = True, size: Column | None = None) -> Column:
    """Each attachment with a safe name, downloaded, skip_reason; the payload only of those that are kept. size: the whole
    message's; one over `most` with a part over it is fetched in part, without any attachment."""
    partial = F.lit(False) if size is None else F.coalesce((size > most) & F.exists(_col(attachments), lambda a: a["size_bytes"] > most), F.lit(False))

    def decide(a: Column) -> Column:
        big = F.concat(F.lit(f"超过大小阈值 {most // 1048576}MB（实际 "), F.format_string("%.1f", a["size_bytes"] / F.lit(1048576.0)), F.lit("MB）"))
        reason = F.when(a["size_bytes"] > most, big).when(F.lit(not download), "配置为不下载附件").when(partial, TOO_LARGE).when(a["size_bytes"] == 0, "附件内容为空")
        kept = [a[n].alias(n) for n in ("part_index", "content_type", "size_bytes", "content_id", "is_inline", "sha256")]
        name = safe_filename(a["filename"], 120, "attachment").alias("filename")
        return F.struct(*kept, name, reason.isNull().alias("downloaded"), reason.alias("skip_reason"), F.when(reason.isNull(), a["payload"]).alias("payload"))

    return F.transform(_col(attachments), decide)


def has_attachments(attachments: Column | str) -> Column:
    return F.exists(_col(attachments), lambda a: ~a["is_inline"])


def cid_paths(attachments: Column | str) -> Column:
    """map of content id to local path."""
    own = F.filter(_col(attachments), lambda a: a["content_id"].isNotNull())
    return F.map_from_entries(F.transform(own, lambda a: F.struct(a["content_id"], F.concat(F.lit("attachments/"), a["filename"]))))


PART = T.StructType([T.StructField("section", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("size", T.LongType()), T.StructField("lines", T.LongType()), T.StructField("filename", T.StringType()), T.StructField("disposition", T.StringType())])

_TOKEN = re.compile(rb'\(|\)|"((?:[^"\\]|\\.)*)"|[^\s()"]+', re.S)


def s_expression(raw: bytes) -> list:
    """Nested lists of byte strings; a list that does not end ends with the input."""
    top: list = []
    stack = [top]
    for m in _TOKEN.finditer(raw):
        token = m.group()
        if token == b"(":
            stack[-1].append([])
            stack.append(stack[-1][-1])
        elif token == b")":
            if len(stack) > 1:
                stack.pop()
        else:
            stack[-1].append(re.sub(rb"\\(.)", rb"\1", m.group(1), flags=re.S) if m.group(1) is not None else token)
    return top


def _ascii(node: list, i: int) -> str:
    return node[i].decode("ascii", "replace") if len(node) > i and isinstance(node[i], bytes) else ""


def _number(node: list, i: int) -> int:
    text = _ascii(node, i)
    return int(text) if text.isdigit() else 0


def _parameter(params, name: str) -> str:
    pairs = zip(params[::2], params[1::2], strict=False) if isinstance(params, list) else ()
    return next((header_text(v) for k, v in pairs if isinstance(k, bytes) and isinstance(v, bytes) and v and k.lower() == name.encode()), "")


def leaf_parts(raw: bytes | None) -> list[dict]:
    """The leaf parts of a BODYSTRUCTURE, with the section each is fetched by."""
    top = s_expression(bytes(raw or b""))
    named = [x[i + 1] for x in (top, *(y for y in top if isinstance(y, list))) for i, y in enumerate(x[:-1]) if isinstance(y, bytes) and y.upper() == b"BODYSTRUCTURE" and isinstance(x[i + 1], list)]
    lists = named or [x for x in top if isinstance(x, list)]
    root = next((x for x in lists if x and isinstance(x[0], list)), lists[0] if lists else None)
    out: list[dict] = []
    waiting = [(root, "")] if root else []
    while waiting:
        node, section = waiting.pop()
        if not node:
            continue
        if isinstance(node[0], list):
            children = []
            for i, child in enumerate(node, 1):
                if not isinstance(child, list):
                    break
                children.append((child, f"{section}.{i}" if section else str(i)))
            waiting.extend(reversed(children))
            continue
        main, sub = _ascii(node, 0).lower(), _ascii(node, 1).lower()
        name, shown = _parameter(node[2] if len(node) > 2 else None, "name"), ""
        for d in node[8:11]:
            if isinstance(d, list) and d and isinstance(d[0], bytes) and _ascii(d, 0).lower() in ("attachment", "inline"):
                shown = _ascii(d, 0).lower()
                name = name or _parameter(d[1] if len(d) > 1 else None, "filename")
                break
        own = section or "1"
        out.append({"section": own, "content_type": f"{main}/{sub}" if sub else main, "encoding": _ascii(node, 5).upper() or "7BIT", "size": _number(node, 6), "lines": _number(node, 7), "filename": name, "disposition": shown})
        if main == "message" and len(node) > 8 and isinstance(node[8], list):
            waiting.append((node[8], f"{own}.1"))
    return out


def body_structure(c: Column | str) -> Column:
    """array of PART."""

    @F.pandas_udf(T.ArrayType(PART))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(leaf_parts, na_action=None)

    return run(c)


def fetch_plan(size: Column | str, parts: Column | str, most: int = MOST_ATTACHMENT) -> Column:
    """full or partial: all of a message is fetched if it fits, if none of its parts is too large, or if its parts are not
    known."""
    size, parts = _col(size), _col(parts)
    large = F.exists(F.coalesce(parts, F.array().cast(T.ArrayType(PART))), lambda p: p["size"] > most)
    return F.when((size > 0) & (size <= most), "full").when(large, "partial").otherwise("full")


def text_sections(parts: Column | str, most: int = MOST_ATTACHMENT, count: int = 4) -> Column:
    """Sections of the first text parts that fit."""
    own = F.filter(_col(parts), lambda p: p["content_type"].startswith("text/") & (p["size"] <= most))
    return F.transform(F.slice(own, 1, count), lambda p: p["section"])


def header_bytes(c: Column | str) -> Column:
    """What comes before a message's first empty line, so that bodies need not be parsed, nor sent to a worker."""
    text = F.decode(_col(c), "ISO-8859-1")
    return F.encode(F.concat(F.get(F.split(text, "\r?\n\r?\n", 2), F.lit(0)), F.lit("\r\n\r\n")), "ISO-8859-1")


def envelopes(raw: DataFrame, content: str = "content") -> DataFrame:
    """All columns but the content, and message_id, subject, sender, sender_name, recipients, cc, date_utc, date_raw."""
    own = raw.withColumn("__m", parse_mail(header_bytes(content)))
    return own.select(*(c for c in raw.columns if c != content), *[f"__m.{n}" for n in ("message_id", "subject", "sender", "sender_name", "recipients", "cc", "date_utc", "date_raw")])


def parts_not_fetched(parts: Column | str, most: int = MOST_ATTACHMENT) -> Column:
    """Attachments of a message of which only text parts are fetched: what BODYSTRUCTURE says, and why they are not here."""
    own = F.filter(_col(parts), lambda p: ~p["content_type"].startswith("text/") | (p["disposition"] == "attachment") | (p["filename"] != ""))

    def attachment(p: Column, i: Column) -> Column:
        name = F.when(p["filename"] == "", F.concat(F.lit("attachment_"), (i + 1).cast("string"))).otherwise(p["filename"])
        reason = F.when(p["size"] > most, F.concat(F.lit(f"超过大小阈值 {most // 1048576}MB（实际 "), F.format_string("%.1f", p["size"] / F.lit(1048576.0)), F.lit("MB）"))).otherwise(TOO_LARGE)
        return F.struct((i + 1).cast("int").alias("part_index"), safe_filename(name, 120, "attachment").alias("filename"), p["content_type"].alias("content_type"), p["size"].alias("size_bytes"), (p["disposition"] == "inline").alias("is_inline"), F.lit(False).alias("downloaded"), reason.alias("skip_reason"))

    return F.transform(own, attachment)


def messages(raw: DataFrame, content: str = "content", most: int = MOST_ATTACHMENT, download: bool = True) -> DataFrame:
    """All columns but the content, and the message's, its attachments decided on, its body composed."""
    from tessera.functions.cleaning import compose_body
    from tessera.functions.html import html_to_markdown_with

    mail = raw.withColumn("__m", parse_mail(content)).select(*(c for c in raw.columns if c != content), "__m.*")
    size = F.col("size_bytes") if "size_bytes" in raw.columns else None
    attachments = attachment_policy("attachments", most, download, size)
    if "parts" in raw.columns:  # of a message that was read in part its parts tell what is not here
        there = F.transform(parts_not_fetched("parts", most), lambda a: F.struct(*[a[n].alias(n) if n not in ("content_id", "sha256", "payload") else F.lit(None).cast("binary" if n == "payload" else "string").alias(n) for n in ("part_index", "content_type", "size_bytes", "content_id", "is_inline", "sha256", "filename", "downloaded", "skip_reason", "payload")]))
        attachments = F.when(F.col("parts").isNotNull(), there).otherwise(attachments)
    mail = mail.withColumn("attachments", attachments).drop("parts").withColumn("has_attachments", F.coalesce(has_attachments("attachments"), F.lit(False)))
    mail = mail.withColumn("__md", html_to_markdown_with("text_html", cid_paths("attachments"))).withColumn("__body", compose_body("text_plain", "__md", "subject"))
    blank = F.btrim("__body.plain") == ""
    return mail.withColumns({"body_markdown": F.when(blank, f"*{NO_BODY}*").otherwise(F.col("__body.markdown")), "body_text": F.when(blank, NO_BODY).otherwise(F.col("__body.plain"))}).drop("__md", "__body")
