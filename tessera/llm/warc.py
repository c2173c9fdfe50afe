"""WARC archives: records with segments and chunked framing are written, read back and put together again."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dealt, prepare, scratch, written

#: Bytes of a record's block: a longer one goes on in continuation records. Bytes of a chunk of the HTTP framing.
SEGMENT, CHUNK = 8192, 4096
#: Bytes of records in a file, before compression.
FILE_BYTES = 128 << 20
#: Records' dates; archives of the same pages are the same.
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The payload of a whole chunked body; framing that does not hold is an error."""
    out, at = [], 0
    while True:
        line = framed.index(CRLF, at)
        size = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            if framed[at : at + 2] != CRLF:
                raise ValueError("chunked body does not end")
            return b"".join(out)
        if framed[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is not as long as it says")
        out.append(framed[at : at + size])
        at += size + 2


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it, which the text writer adds."""
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + CRLF + CRLF + block


def clean(value: str | None) -> str | None:
    """A header value on one line."""
    return None if value is None else " ".join(value.split()) or None


def page_records(page: int | None, url: str | None, payload: bytes, first: int | None, mark: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a response, cut into segments if it is long, or a revisit of page `first`. Without a mark it is
    the response that revisits of this payload refer to, and its name holds the payload's digest."""
    digest = digest_of(payload)
    name, shared = f"urn:page:{'' if page is None else page}:{mark or digest}", [("WARC-Target-URI", clean(url)), ("WARC-Date", DATE), ("WARC-Payload-Digest", "sha1:" + digest)]
    if first is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *shared, ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{first}:{digest}>"), ("Content-Type", "application/http; msgtype=response")], HTTP)]
    block = HTTP + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    kind = ("Content-Type", "application/http; msgtype=response")
    out = [record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *shared, kind, ("WARC-Segment-Number", 1 if len(parts) > 1 else None)], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:{i}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", len(block) if i == len(parts) else None)], part))
    return out


def unzipped(data: bytes) -> bytes:
    """All members of a gzipped file, or the data itself."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), block and end of the record that begins here; one that does not hold is an error."""
    head = data.find(CRLF + CRLF, at)
    lines = data[at : max(head, at)].decode("utf-8", "surrogateescape").split("\r\n")
    if head < 0 or not lines[0].startswith("WARC/"):
        raise ValueError("no record begins here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    begin, size = head + 4, headers.get("content-length", "")
    if not size.isdigit():
        raise ValueError("a record without a length")
    end = begin + int(size)
    if data[end : end + 4] != CRLF + CRLF:
        raise ValueError("a record is not as long as it says")
    return headers, data[begin:end], end + 4


def records_of(data: bytes) -> Iterator[tuple[int, dict[str, str] | None, bytes, str | None]]:
    """Place, headers, block and error of each record of an archive. Behind one that does not hold it goes on where the next
    record begins."""
    at = 0
    while at < len(data):
        try:
            headers, block, end = record_at(data, at)
        except ValueError as e:
            yield at, None, b"", str(e)
            found = data.find(CRLF + b"WARC/", at + 1)
            end = found + 2 if found >= 0 else len(data)
        else:
            yield at, headers, block, None
        at = end


def reassembled(parts: list[tuple[int, int | None, bytes]]) -> bytes | None:
    """The block of (segment number, total length or None, bytes) in any order; None if segments are missing."""
    parts = sorted(parts, key=lambda p: p[0])
    total = parts[-1][1]
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or total is None:
        return None
    block = b"".join(p[2] for p in parts)
    if len(block) != total:
        raise ValueError(f"segments have {len(block)} bytes, not {total}")
    return block


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(CRLF + CRLF)
    coded = any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(CRLF))
    return unchunked(body) if coded else body


def write_archives(pages: DataFrame, folder: str, least_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT, file_bytes: int = FILE_BYTES) -> None:
    """Writes pages as gzipped WARC files of about file_bytes at most. Of equal payloads of least_revisit_bytes or more the
    least page id is a response, the others revisit it. Where several rows have that id, all are responses and one of them is
    referred to. Only payloads that occur again are looked up, and a very common one is dealt over tasks."""
    prepare(pages.sparkSession)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    by_page = own.where(F.octet_length("html") >= least_revisit_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    again = written(by_page.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("n", "page_id").alias("firsts"), F.sum("n").alias("n")).where("n > 1"), "payloads")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, n = uuid.uuid4().hex[:16], 0
        for batch in batches:
            out = []
            for page, url, html, to, named in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                out += page_records(page, url, html.encode("utf-8", "surrogatepass"), to if to != page else None, None if named else f"{mark}{n}", segment)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary())], names=["record"])

    joined = dealt(own, again, ["digest"], ["page_id", "url"], how="left")
    is_first = F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    rows = joined.select("page_id", "url", "html", "first", is_first.alias("named"))
    if not again.where("firsts > 1").isEmpty():  # repeated rows: of those with one id and payload the first by url is referred to
        several = is_first & (F.col("firsts") > 1)
        counted = joined.where(several).groupBy("digest", "page_id", "url").agg(F.first("html").alias("html"), F.first("first").alias("first"), F.count("*").alias("n"))
        least = counted.groupBy("digest").agg(F.min(F.struct("url")).alias("least"))
        numbered = counted.join(least, "digest").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        repeated = numbered.select("page_id", "url", "html", "first", ((F.col("i") == 1) & F.struct("url").eqNullSafe(F.col("least"))).alias("named"))
        rows = joined.where(~F.coalesce(several, F.lit(False))).select("page_id", "url", "html", "first", is_first.alias("named")).unionByName(repeated)
    (rows.mapInArrow(lines, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", max(1, file_bytes // (segment + 1024))).text(folder))


READ = pa.schema([("origin", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("file", pa.string()), ("at", pa.int64()), ("error", pa.string())])
READ_DDL = "origin string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, segment int, total long, block binary, file string, at long, error string"


def _page(name: str) -> int | None:
    """The page that a record's name holds; a name of another kind is an error."""
    parts = name.strip("<>").split(":")
    if parts[:2] != ["urn", "page"] or len(parts) < 3 or parts[2] and not parts[2].lstrip("-").isdigit():
        raise ValueError(f"{name} names no page")
    return int(parts[2]) if parts[2] else None


def _response(origin: str, digest: str, block: bytes) -> dict:
    payload = payload_of(block)
    if digest_of(payload) != digest:
        raise ValueError(f"payload of {origin} does not have its digest")
    return {"origin": origin, "page_id": _page(origin), "record_type": "response", "payload_bytes": len(payload), "payload_digest": digest}


def read_file(data: bytes, file: str = "") -> list[dict]:
    """Rows of READ: records that are whole in this file, the segments of those that are not, and bad records with their
    error. Records of other types are passed over."""
    out, open_parts = [], {}
    for at, headers, block, error in records_of(data):
        try:
            if error:
                raise ValueError(error)
            name, number, kind = headers.get("warc-record-id", ""), int(headers.get("warc-segment-number", 0)), headers.get("warc-type")
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            if number and kind in ("response", "continuation"):
                total = headers.get("warc-segment-total-length")
                open_parts.setdefault(headers.get("warc-segment-origin-id", name), []).append((number, int(total) if total else None, block, digest, at))
            elif kind == "revisit":
                out.append({"origin": name, "page_id": _page(name), "record_type": "revisit", "payload_digest": digest, "refers_to": _page(headers.get("warc-refers-to", ""))})
            elif kind == "response":
                out.append(_response(name, digest, block))
        except ValueError as e:
            out.append({"record_type": "bad", "file": file, "at": at, "error": str(e), "block": block or None})
    for origin, parts in open_parts.items():
        try:
            page, block = _page(origin), reassembled([p[:3] for p in parts])
            if block is None:
                out += [{"origin": origin, "page_id": page, "record_type": "segment", "payload_digest": d or None, "segment": n, "total": total, "block": b, "file": file, "at": at} for n, total, b, d, at in parts]
            else:
                out.append(_response(origin, min(parts, key=lambda p: p[0])[3], block))
        except ValueError as e:
            out.append({"origin": origin, "record_type": "bad", "file": file, "at": min(p[4] for p in parts), "error": str(e)})
    return out


def read_records(spark, folder: str) -> DataFrame:
    """READ of all records in the archives of a folder."""
    prepare(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = read_file(unzipped(data), file)
                except zlib.error as e:
                    rows = [{"record_type": "bad", "file": file, "at": 0, "error": str(e)}]
                for i in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 4096], schema=READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")
    return written(files.mapInArrow(parse, READ_DDL), "records")  # digests, and the blocks of parted records only


def _together(rows: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, error of segments that no file holds together, grouped by their origin."""

    def joined(key, pdf):
        import pandas as pd

        parts = [(int(n), None if pd.isna(t) else int(t), bytes(b)) for n, t, b in zip(pdf["segment"], pdf["total"], pdf["block"], strict=True)]
        own, error = {}, None
        try:
            block = reassembled(parts)
            if block is None:
                raise ValueError(f"segments of {key[0]} are missing")
            own = _response(key[0], next((d for d in pdf["payload_digest"] if isinstance(d, str)), ""), block)
        except ValueError as e:
            error = str(e)
        return pd.DataFrame({"page_id": pd.array([own.get("page_id")], "Int64"), "payload_bytes": pd.array([own.get("payload_bytes")], "Int64"), "payload_digest": [own.get("payload_digest")], "error": [error], "origin": [key[0]]})

    return rows.where("record_type = 'segment'").groupBy("origin").applyInPandas(joined, "page_id long, payload_bytes long, payload_digest string, error string, origin string")


def bad_records(rows: DataFrame) -> DataFrame:
    """file, at, origin, error of what read_records() found but cannot be read: a record without a length, or not as long as
    it says; a name that is no page's; a payload without its digest; framing that does not hold; segments that are missing or
    not as long together as they say; a file that cannot be unzipped."""
    alone = rows.where("record_type = 'bad'").select("file", "at", "origin", "error")
    return alone.unionByName(_together(rows).where("error is not null").select(F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("at"), "origin", "error"))


def pages_of(rows: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each response and revisit that read_records() found. Bad
    records give no row: bad_records() has them. A revisit of a page that is not there has no payload_bytes."""
    none = F.lit(None).cast("long")
    whole = rows.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest")
    responses = whole.unionByName(_together(rows).where("error is null").select("page_id", "payload_bytes", "payload_digest"))
    by_page = responses.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = rows.where("record_type = 'revisit'").select("page_id", "payload_digest", "refers_to")
    counts = revisits.groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n")).join(by_page, ["refers_to", "payload_digest"], "left")
    sized = dealt(revisits, counts, ["refers_to", "payload_digest"], ["page_id"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("record_type", F.lit("response")).withColumn("refers_to", none).select(columns).unionByName(sized.withColumn("record_type", F.lit("revisit")).select(columns))


def read_archives(spark, folder: str) -> DataFrame:
    """pages_of() the archives of a folder."""
    return pages_of(read_records(spark, folder))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit_bytes: int = 0) -> DataFrame:
    """Writes the archives into the shared folder and reads them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to. One row a row of pages. Null html: an empty payload. Null page_id: a response only if no row of its payload
    has an id, else a revisit of the least. Rows of equal payload that repeat the least page_id are all responses. Empty
    pages: no rows. Other columns are not read. A record that cannot be read back is an error."""
    folder = f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least_revisit_bytes, id_col, url_col, html_col)
    rows = read_records(pages.sparkSession, folder)
    if not (bad := bad_records(rows)).isEmpty():
        raise ValueError(f"an archive cannot be read back: {bad.first()}")
    return pages_of(rows)
