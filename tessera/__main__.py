"""python -m tessera COMMAND: the archive from the command line."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from tessera.archive import Archive
from tessera.operators.filters import Filters
from tessera.sources import archive, config, mailbox


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    top.add_argument("--root", default="archive", help="where the archive's tables are")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, text: sub.add_parser(name, help=text)
    p = add("sync", "read new mail from a folder of messages")
    p.add_argument("mailbox")
    p.add_argument("--full", action="store_true")
    p.add_argument("--budget", type=int)
    add("demo", "fill the archive with made-up mail").add_argument("--count", type=int, default=40)
    add("index", "chunk and embed what is pending").add_argument("--rebuild", action="store_true")
    p = add("search", "search messages")
    p.add_argument("query")
    p.add_argument("--mode", choices=["hybrid", "keyword", "vector"], default="hybrid")
    p.add_argument("--scope", choices=["all", "subject", "sender", "recipient", "cc", "body"], default="all")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--folder", action="append", default=[])
    p.add_argument("--sender")
    p = add("list", "a page of messages")
    p.add_argument("--order", choices=["date_desc", "date_asc", "subject", "sender"], default="date_desc")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--offset", type=int, default=0)
    add("show", "one message").add_argument("reference")
    for name, text in (("status", "counts and the last runs"), ("folders", "counts by folder"), ("doctor", "whether the archive is in order"), ("config", "the parameters in force")):
        add(name, text)
    add("verify-blobs", "check stored attachments").add_argument("--deep", action="store_true")
    add("repair-blobs", "bring stored attachments back from files").add_argument("--found", help="a folder of files")
    add("backup", "copy the tables").add_argument("path")
    add("restore", "take the tables from a copy").add_argument("path")
    return top


def run(args: argparse.Namespace, own: Archive) -> list[dict]:
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if args.command == "sync":
        raw = mailbox.mails(own.spark, args.mailbox, own.config.sync.max_attachment_mb << 20, exclude=",".join(own.config.sync.exclude_folders))
        return rows(own.sync(raw, args.full, args.budget))
    if args.command == "demo":
        from pyspark.sql import functions as F

        demo = archive.demo_mail(own.spark, args.count).select(F.lit("demo").alias("account"), "folder", F.lit(1).cast("long").alias("uidvalidity"), "uid", F.octet_length("content").cast("long").alias("size_bytes"), "content")
        return rows(own.sync(demo))
    if args.command == "index":
        return rows(own.index(args.rebuild))
    if args.command == "search":
        return rows(own.search(args.query, Filters(folder=tuple(args.folder), sender=args.sender), args.limit, args.mode, args.scope).select("message_pk", "subject", "sender", "folder", "snippet"))
    if args.command == "list":
        return rows(own.page(limit=args.limit, offset=args.offset, order=args.order))
    if args.command == "show":
        return rows(own.message(args.reference))
    if args.command == "status":
        return [own.health(), *rows(own.last_runs(5))]
    if args.command == "folders":
        return rows(own.folders())
    if args.command == "doctor":
        return [own.health(), *rows(own.verify())]
    if args.command == "verify-blobs":
        return rows(own.verify(args.deep))
    if args.command == "repair-blobs":
        found = own.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.found).withColumnRenamed("content", "payload") if args.found else None
        return rows(own.repair(found))
    if args.command == "config":
        return [asdict(own.config)]
    getattr(own, args.command)(args.path)
    return [{"done": args.command, "path": args.path}]


def main(arguments: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for row in run(args, Archive(spark, args.root, config.load())):
        print(json.dumps(row, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
