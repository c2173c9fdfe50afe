"""Pages by key: rows sorted by date and id in files whose ranges are known, so that a page reads the files it lies in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.folders import done, remove

#: Rows of a file; and files that are looked up at first, twice as many each time they do not fill a page.
ROWS_PER_FILE, FIRST_FILES = 20_000, 1
RANGES = "file string, n long, low_key long, low_id long, high_key long, high_id long"
LEAST = -(1 << 63)


@dataclass(frozen=True)
class Page:
    """rows in order; next: the key and id to go on after, None behind the last row; files: how many were read."""

    rows: DataFrame
    next: tuple[int, int] | None
    files: int


class SortedPages:
    """A copy of rows' listed columns in the order of (time, id), newest first, in versions: a build writes a new one, which
    counts when it is whole. Rows without a time come last."""

    def __init__(self, spark: SparkSession, path: str, time: str = "date_utc", key: str = "message_pk"):
        self.spark, self.path, self.time, self.key = spark, path, time, key

    def _version(self) -> int | None:
        versions = done(self.spark, f"{self.path}/ranges", "version=")
        return versions[-1] if versions else None

    def _order(self) -> Column:
        return F.coalesce(F.unix_micros(F.col(self.time).cast("timestamp")), F.lit(LEAST))

    def build(self, rows: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> None:
        """rows: the key, the time and what else a list shows; sorted once, by ranges, over all tasks."""
        at = (self._version() or 0) + 1
        place, parts = f"{self.path}/data/version={at}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        own = rows.withColumn("__key", self._order()).withColumn("__id", F.col(self.key).cast("long"))
        own.repartitionByRange(parts, "__key", "__id").sortWithinPartitions("__key", "__id").write.option("maxRecordsPerFile", rows_per_file).parquet(place)
        named = self.spark.read.schema(own.schema).parquet(place).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"), F.min(F.struct("__key", "__id")).alias("low"), F.max(F.struct("__key", "__id")).alias("high"))
        named.select("file", "n", F.col("low.__key").alias("low_key"), F.col("low.__id").alias("low_id"), F.col("high.__key").alias("high_key"), F.col("high.__id").alias("high_id")).coalesce(1).write.parquet(f"{self.path}/ranges/version={at}")  # a row a file
        for old in done(self.spark, f"{self.path}/ranges", "version=")[:-2]:
            remove(self.spark, f"{self.path}/data/version={old}")
            remove(self.spark, f"{self.path}/ranges/version={old}")

    def page(self, limit: int, after: tuple[int, int] | None = None, where: Column | None = None) -> Page:
        """The next rows after a key and id (None: the first ones) that pass a condition. Reads the file that they begin in,
        and more only while they do not fill the page."""
        version = self._version()
        if version is None:
            raise LookupError("the pages have not been built")
        ranges = self.spark.read.schema(RANGES).parquet(f"{self.path}/ranges/version={version}")
        place = F.struct(F.col("__key"), F.col("__id"))
        before = None if after is None else F.struct(F.lit(after[0]).cast("long").alias("__key"), F.lit(after[1]).cast("long").alias("__id"))
        if before is not None:
            ranges = ranges.where(F.struct(F.col("low_key").alias("__key"), F.col("low_id").alias("__id")) < before)
        files, taken = FIRST_FILES, 0
        while True:
            found = ranges.orderBy(F.desc("high_key"), F.desc("high_id"), F.desc("low_key"), F.desc("low_id")).limit(files + 1).collect()  # as many as are read
            more, own = len(found) > files, [r["file"] for r in found[:files]]
            data = self.spark.read.parquet(*own) if own else self.spark.read.parquet(f"{self.path}/data/version={version}").where("false")
            data = data if before is None else data.where(place < before)
            data = data if where is None else data.where(where)
            best = data.orderBy(F.desc("__key"), F.desc("__id")).limit(limit)
            rows = best.collect()  # a page
            taken = len(own)
            if len(rows) == limit or not more:
                last = (rows[-1]["__key"], rows[-1]["__id"]) if len(rows) == limit else None
                return Page(self.spark.createDataFrame(rows, best.schema).drop("__key", "__id"), last, taken)
            files *= 2
