"""Sinks and sources of the archive: Markdown files with front matter, query files, demo mail, snapshots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import archive_name, safe_path
from tessera.sources.markdown_sink import export
from tessera.sources.scratch import written

# The fields of the front matter, in order, and what stands for a body that is not there.
FIELDS = ("message_id", "subject", "from", "to", "cc", "date", "folder", "uid", "attachments", "local_path", "account", "uidvalidity", "in_reply_to", "references", "size_bytes", "has_attachments", "attachment_count", "archived_at")
NO_BODY = "*(此邮件无正文内容)*"


def _quoted(c: Column) -> Column:
    """A YAML double-quoted scalar."""
    text = F.coalesce(c, F.lit(""))
    for sign, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(sign), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _unquoted(c: Column) -> Column:
    text = F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit("\\\\"), F.lit("\uf8ff"))
    for sign, escaped in (('"', '\\"'), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(escaped), F.lit(sign))
    return F.replace(text, F.lit("\uf8ff"), F.lit("\\"))


def _front(messages: DataFrame) -> dict[str, Column]:
    """Each field's value as YAML has it; columns that are not there are empty."""
    there = set(messages.columns)
    text = lambda name: F.col(name).cast("string") if name in there else F.lit("")
    number = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("0")) if name in there else F.lit("0")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    shown = F.when(F.coalesce(text("sender_name"), F.lit("")) != "", F.concat(text("sender_name"), F.lit(" <"), text("sender"), F.lit(">"))).otherwise(text("sender"))
    attached = F.coalesce("attachment_names", F.array().cast("array<string>")) if "attachment_names" in there else F.array().cast("array<string>")
    return {
        "message_id": _quoted(text("message_id")), "subject": _quoted(text("subject")), "from": _quoted(shown), "to": _quoted(text("recipients")), "cc": _quoted(text("cc")),
        "date": _quoted(iso("date_utc") if "date_utc" in there else F.lit("")), "folder": _quoted(text("folder")), "uid": _quoted(text("uid")),
        "attachments": F.concat(F.lit("["), F.array_join(F.transform(attached, _quoted), ", "), F.lit("]")), "local_path": _quoted(F.col("path")), "account": _quoted(text("account")),
        "uidvalidity": number("uidvalidity"), "in_reply_to": _quoted(text("in_reply_to")), "references": _quoted(text("references")), "size_bytes": number("size_bytes"),
        "has_attachments": F.coalesce(F.col("has_attachments"), F.lit(False)).cast("string") if "has_attachments" in there else F.lit("false"), "attachment_count": F.size(attached).cast("string"),
        "archived_at": _quoted(iso("synced_at") if "synced_at" in there else F.lit("")),
    }


def documents(messages: DataFrame, body: str = "body_markdown") -> DataFrame:
    """message_pk, path, document: a file for each message, its front matter, the subject as a heading, and the body. Where
    messages of a folder would have one name, _1, _2 … tell them apart."""
    name = archive_name("date_utc", "subject", "uid")
    own = messages.withColumns({"__folder": safe_path(F.array("folder")), "__name": name})
    n = F.row_number().over(Window.partitionBy("__folder", F.lower("__name")).orderBy("message_pk")) - 1
    numbered = own.withColumn("__n", n)
    suffix = F.when(F.col("__n") > 0, F.concat(F.lit("_"), F.col("__n").cast("string"))).otherwise("")
    named = numbered.withColumn("path", F.concat(F.col("__folder"), F.lit("/"), F.regexp_replace("__name", r"\.md$", ""), suffix, F.lit(".md")))
    front = _front(named)
    head = F.array_join(F.array(*[F.concat(F.lit(f"{f}: "), front[f]) for f in FIELDS]), "\n")
    title = F.when(F.coalesce("subject", F.lit("")) == "", "(无主题)").otherwise(F.regexp_replace("subject", "\\s+", " "))
    text = F.btrim(F.coalesce(F.col(body), F.lit("")))
    whole = F.concat(F.lit("---\n"), head, F.lit("\n---\n\n# "), title, F.lit("\n\n"), F.when(text == "", NO_BODY).otherwise(text), F.lit("\n"))
    return named.select("message_pk", "path", whole.alias("document"))


def write_markdown(messages: DataFrame, path: str, body: str = "body_markdown") -> DataFrame:
    """Each message's file under path, in place of the export that was there; where a task fails for good, the old one stays
    whole. Returns message_pk, path of what is there."""
    named = documents(messages, body)
    export(named, path)
    return written(named.select("message_pk", "path"), "markdown")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path (under the given one), front (map of field to text), subject, body of each Markdown file. A file without front
    matter is all body."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    parts = F.split("value", "(?m)^---$", 3)
    has = F.col("value").startswith("---") & (F.size(parts) == 3)
    lines = F.filter(F.split(F.get(parts, F.lit(1)), "\n"), lambda x: x.contains(": "))
    front = F.map_from_entries(F.transform(lines, lambda x: F.struct(F.substring_index(x, ": ", 1), _unquoted(F.substring(x, F.instr(x, ": ") + 2, F.length(x))))))
    rest = F.regexp_replace(F.when(has, F.get(parts, F.lit(2))).otherwise(F.col("value")), "^\n+", "")
    where = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), F.lit("^.*?" + re.escape(path.split("://")[-1].rstrip("/")) + "/"), F.lit(""))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.select(where.alias("path"), F.when(has, front).otherwise(none).alias("front"), F.regexp_extract(rest, r"^# ([^\n]*)", 1).alias("subject"), F.regexp_replace(F.regexp_replace(rest, r"^# [^\n]*\n+", ""), "\n$", "").alias("body"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """kind, query of a file of tab-separated lines; # begins a comment."""
    return spark.read.schema("kind string, query string").option("sep", "\t").option("comment", "#").csv(path).where(F.col("query").isNotNull())


def write_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A backup: every table under one new folder; an old one is never written over."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


#: Demo mail: subjects, senders and folders that rows take in turn.
DEMO_SUBJECTS = ["Quarterly report", "发票报销流程", "Server expansion plan", "Team outing", "会议纪要", "Contract draft", "Security notice", "招聘进展", "Release notes", "Travel request"]
DEMO_SENDERS = ["Li Lei <li.lei@example.com>", "Han Mei <han.mei@example.com>", "Ops <ops@example.org>", "HR <hr@example.org>"]
DEMO_FOLDERS = ["INBOX", "INBOX", "INBOX", "Sent", "Projects", "Archive"]


def demo_mail(spark: SparkSession, n: int, seed: int = 20240301) -> DataFrame:
    """folder, uid, content: n messages, the same for the same seed."""
    pick = lambda values, salt: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(seed + salt)), F.lit(len(values))) + 1).cast("int"))
    rows = spark.range(n).select("id", pick(DEMO_SUBJECTS, 1).alias("subject"), pick(DEMO_SENDERS, 2).alias("sender"), pick(DEMO_FOLDERS, 3).alias("folder"))

    @F.pandas_udf(T.BinaryType())
    def build(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        from email.message import EmailMessage
        from email.utils import parseaddr

        for ids, subjects, senders in batches:
            out = []
            for i, subject, sender in zip(ids, subjects, senders, strict=True):
                m = EmailMessage()
                m["Subject"], m["From"], m["To"], m["Message-ID"] = subject, sender, "you@example.com", f"<demo-{i}@example.com>"
                m["Date"] = f"{i % 28 + 1} Mar 2024 {i % 24:02d}:00:00 +0000"
                m.set_content(f"{subject}\n\nThis is message {i} from {parseaddr(sender)[0]}.\n")
                if i % 3 == 0:
                    m.add_attachment(b"%d,%d\n" % (i % 7, i % 5), maintype="text", subtype="csv", filename=f"table-{i % 4}.csv")
                    m.set_boundary(f"demo-{i}")
                out.append(bytes(m))
            yield pd.Series(out)

    return rows.select("folder", (F.col("id") + 1).cast("string").alias("uid"), build("id", "subject", "sender").alias("content"))
