"""Mail as a Spark data source: a folder tree of message files read by epoch and uid, in batch or as a stream.

The tasks list and read the files, so driver and executors must see the folder under the same path; for stores that only
Spark reads there is message_files().
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tessera.functions.mime import PART
from tessera.sources.ranges import fetched, header_of

SCHEMA = "account string, folder string, uidvalidity long, uid string, size_bytes long, content binary"
#: What a listing tells, for which no file is opened. number: the uid as one.
LISTED = "account string, folder string, uidvalidity long, uid string, number long, size_bytes long, path string"
#: Messages of a batch in memory.
BATCH = 64
#: Tasks that share a folder.
SLICES = 8
UIDVALIDITY = ".uidvalidity"


class Slice(InputPartition):
    """The messages of a folder with low < uid <= high (None: any) whose uid is `index` modulo `of`. The task lists them."""

    def __init__(self, folder: str, epoch: int, low: int, high: int | None, index: int, of: int):
        super().__init__((folder, epoch, low, high, index, of))
        self.folder, self.epoch, self.low, self.high, self.index, self.of = folder, epoch, low, high, index, of


class _Box:
    """<root>/<folder>/<uid>.eml; a folder's epoch is in its .uidvalidity file, 1 if there is none."""

    def __init__(self, options: dict[str, str]):
        self.root = Path(options["path"])
        self.account = options.get("account", "")
        excluded = {x.strip().lower() for x in options.get("exclude", "").split(",") if x.strip()}
        wanted = [x.strip() for x in options.get("folders", "").split(",") if x.strip()]
        self.keep = lambda name: name.lower() not in excluded and (not wanted or name in wanted)

        self.of = int(options.get("slices", SLICES))

    def epochs(self) -> dict[str, int]:
        """The folders and their epochs: a look at the folders only, not at what is in them."""
        out = {}
        for d in sorted(p for p in self.root.iterdir() if p.is_dir()):
            if self.keep(d.name):
                mark = d / UIDVALIDITY
                out[d.name] = int(mark.read_text()) if mark.exists() else 1
        return out

    def uids(self, folder: str) -> Iterator[int]:
        with os.scandir(self.root / folder) as found:
            for entry in found:
                stem, dot, ending = entry.name.rpartition(".")
                if dot and ending == "eml" and stem.isdigit():
                    yield int(stem)

    def slices(self, folder: str, epoch: int, low: int, high: int | None = None) -> list[Slice]:
        return [Slice(folder, epoch, low, high, i, self.of) for i in range(self.of)]

    def rows(self, part: Slice, columns: list[str] | None = None, sizes: tuple[int, int] | None = None) -> Iterator[tuple]:
        """The asked columns of the slice's messages, of those within sizes; a file is opened for its content only, and asked
        for its size only where that is asked for."""
        columns = columns or [c.split()[0] for c in SCHEMA.split(", ")]
        for uid in sorted(u for u in self.uids(part.folder) if u > part.low and (part.high is None or u <= part.high) and u % part.of == part.index):
            path = self.root / part.folder / f"{uid}.eml"
            size = path.stat().st_size if sizes or "size_bytes" in columns else None
            if sizes and not sizes[0] <= size <= sizes[1]:
                continue
            known = {"account": self.account, "folder": part.folder, "uidvalidity": part.epoch, "uid": str(uid), "number": uid, "size_bytes": size, "path": str(path)}
            yield tuple(known[c] if c in known else path.read_bytes() for c in columns)


ANY = (0, 1 << 62)


class _Reader(DataSourceReader):
    """Conditions on folder, uid, number and size reach the listing: what they rule out is not asked for, let alone opened."""

    def __init__(self, options, schema: StructType):
        self.box, self.columns = _Box(options), schema.names
        self.folders: set[str] | None = None
        self.numbers, self.sizes = (int(options.get("since", 0)) + 1, ANY[1]), ANY

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        """Whether a condition is one that the listing keeps by itself."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, IsNotNull):
            return column in ("account", "folder", "uidvalidity", "uid", "number", "size_bytes", "path")
        if isinstance(f, (EqualTo, In)) and column in ("folder", "uid"):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            if column == "folder":
                self.folders = wanted if self.folders is None else self.folders & wanted
                return True
            own = [int(x) for x in wanted if isinstance(x, str) and x.isdigit()]
            self.numbers = max(self.numbers[0], min(own, default=1)), min(self.numbers[1], max(own, default=0))
            return len(wanted) == 1 and all(str(x) in wanted for x in own) and bool(own)
        if column not in ("number", "size_bytes") or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or not isinstance(f.value, int):
            return False
        low, high = self.numbers if column == "number" else self.sizes
        if not isinstance(f, (LessThan, LessThanOrEqual)):
            low = max(low, f.value + isinstance(f, GreaterThan))
        if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            high = min(high, f.value - isinstance(f, LessThan))
        if column == "number":
            self.numbers = low, high
        else:
            self.sizes = low, high
        return True

    def partitions(self):
        wanted = {f: e for f, e in self.box.epochs().items() if self.folders is None or f in self.folders}
        return [s for f, e in wanted.items() for s in self.box.slices(f, e, self.numbers[0] - 1, self.numbers[1])]

    def read(self, partition):
        return self.box.rows(partition, self.columns, None if self.sizes == ANY else self.sizes)


class _Stream(DataSourceStreamReader):
    """Offsets are {folder: [epoch, last uid]}; a changed epoch starts its folder anew. With the option max_messages a batch
    ends after so many messages, folder after folder; the option checkpoint, the query's own folder, then says where it was
    when it stopped. (A query that is to run once, with availableNow, asks for one end only and so takes one such batch.)"""

    def __init__(self, options, schema: StructType):
        self.box, self.columns = _Box(options), schema.names
        self.most = int(options["max_messages"]) if "max_messages" in options else None
        if self.most is not None and "checkpoint" not in options:
            raise ValueError("max_messages needs the option checkpoint, the folder of the query's checkpoint")
        self.seen = _last_offset(options["checkpoint"]) if self.most is not None else {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        if self.most is None:
            return {f: [e, max(self.box.uids(f), default=0)] for f, e in self.box.epochs().items()}
        out, left = {}, self.most
        for f, e in self.box.epochs().items():
            low = self.seen[f][1] if f in self.seen and self.seen[f][0] == e else 0
            taken = heapq.nsmallest(left, (u for u in self.box.uids(f) if u > low)) if left else []
            out[f] = [e, taken[-1] if taken else low]
            left -= len(taken)
        self.seen = out
        return out

    def partitions(self, start, end):
        out, now = [], self.box.epochs()
        self.seen = {f: max(at, self.seen.get(f, at)) for f, at in end.items()}  # a batch that runs again after a stop
        for f, (epoch, high) in end.items():
            if now.get(f) != epoch:  # it began anew since; the next batch has it
                continue
            low = start[f][1] if f in start and start[f][0] == epoch else 0
            if high > low:
                out += self.box.slices(f, epoch, low, high)
        return out

    def read(self, partition):
        return self.box.rows(partition, self.columns)

    def commit(self, end):
        pass


def _last_offset(checkpoint: str) -> dict:
    """The last end that the query has planned, from its checkpoint; none if it is new."""
    place = Path(checkpoint.removeprefix("file://"), "offsets")
    planned = [int(p.name) for p in place.iterdir() if p.name.isdigit()] if place.is_dir() else []
    return json.loads((place / str(max(planned))).read_text().strip().splitlines()[-1]) if planned else {}


class MailboxSource(DataSource):
    """spark.read.format("mailbox").load(root): options folders, exclude, account, since; of a stream max_messages and
    checkpoint. With a schema of its own it gives these columns, of SCHEMA and LISTED; without `content` no file is opened."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options), schema)

    def streamReader(self, schema):
        return _Stream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets conditions reach it."""
    spark.dataSource.register(MailboxSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _fetch(most: int | None):
    """content and parts of a message by its path and size."""

    @F.pandas_udf(T.StructType([T.StructField("content", T.BinaryType()), T.StructField("parts", T.ArrayType(PART))]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, sizes in batches:
            yield pd.DataFrame([fetched(p, most if most is not None and s > most else None) for p, s in zip(paths, sizes, strict=True)], columns=["content", "parts"])

    return run


@F.pandas_udf(T.BinaryType())
def _header(paths: pd.Series) -> pd.Series:
    return paths.map(header_of)


def mails(spark: SparkSession, root: str, most_bytes: int | None = None, **options: str) -> DataFrame:
    """LISTED, header, content and parts of each message. Files are opened where header, content or parts are asked for,
    after all conditions: header reads up to the first empty line. Of a message over most_bytes content holds the header and
    the text parts that fit, read by their places in the file, and parts says what there is besides; else parts is null."""
    register(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(BATCH, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))))
    listed = spark.read.format("mailbox").schema(LISTED).options(**options).load(root)
    return listed.withColumn("__got", _fetch(most_bytes)("path", "size_bytes")).select(*listed.columns, _header("path").alias("header"), "__got.content", "__got.parts")


def message_files(spark: SparkSession, root: str) -> DataFrame:
    """The same rows by Spark's own file source, for stores that only Spark reads: <root>/<folder>/<uid>.eml."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(root)
    return files.select(F.lit("").alias("account"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.lit(1).cast("long").alias("uidvalidity"), F.regexp_extract("path", r"([^/]+)\.eml$", 1).alias("uid"), F.col("length").alias("size_bytes"), "content")


def folder_status(spark: SparkSession, root: str) -> DataFrame:
    """account, name, epoch, messages, next_uid of each folder, empty ones too; the tasks list them."""
    epochs = spark.createDataFrame(list(_Box({"path": root}).epochs().items()), "name string, epoch long")  # a row a folder
    register(spark)
    listed = spark.read.format("mailbox").schema("folder string, number long").load(root)
    found = listed.groupBy(F.col("folder").alias("name")).agg(F.count("*").alias("messages"), F.max("number").alias("last"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return epochs.join(found, "name", "left").select(F.lit("").alias("account"), "name", "epoch", none("messages").alias("messages"), (none("last") + 1).alias("next_uid"))


def offset_text(offset: dict) -> str:
    return json.dumps(offset, sort_keys=True)


def set_epoch(root: str, folder: str, epoch: int) -> None:
    os.makedirs(f"{root}/{folder}", exist_ok=True)
    Path(root, folder, UIDVALIDITY).write_text(str(epoch))
