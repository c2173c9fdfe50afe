"""Tables on disk by parts: a change writes the parts that it touches, and a manifest of which part is where."""

from __future__ import annotations

import operator
from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.folders import done, names, numbers, remove

MANIFEST = "part string, version int"
#: Versions of a part after which it is time to write it as one.
MOST_VERSIONS = 16


class Table:
    """Rows with a column `part`, in data/version=…/part=…. The last manifest that is whole says which versions of each part
    count, so a job that dies half-way changes nothing and can run again, and what a change does not touch is not copied."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def parts(self) -> dict[str, list[int]]:
        """The versions of each part."""
        versions = done(self.spark, f"{self.path}/manifest")
        out: dict[str, list[int]] = defaultdict(list)
        if versions:
            for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{versions[-1]}").collect():  # a row a part
                out[r["part"]].append(r["version"])
        return dict(out)

    def read(self, only: list[str] | None = None, part: bool = False) -> DataFrame:
        """All rows, or those of some parts; with the column `part` if asked for. Only their folders are read."""
        by_version: dict[tuple[int, ...], list[str]] = defaultdict(list)
        own = self.parts()
        for name, versions in own.items():
            if only is None or name in only:
                for v in versions:
                    by_version[v].append(name)
        columns = [*self.columns, "part"] if part else self.columns
        if not by_version:
            return self.spark.createDataFrame([], f"{self.schema}, part string").select(columns)
        tests: list[Column] = [(F.col("version") == v) & F.col("part").isin(x) for v, x in by_version.items()]
        rows = self.spark.read.schema(f"{self.schema}, version int, part string").parquet(f"{self.path}/data")
        return rows.where(reduce(operator.or_, tests)).select(columns)

    def write(self, rows: DataFrame, touched: list[str] | None = None, add: bool = False) -> None:
        """rows (with `part`) become the touched parts, by default all there are; with add they come to what is there."""
        before = self.parts()
        at = max([*numbers(self.spark, f"{self.path}/data", "version="), *numbers(self.spark, f"{self.path}/manifest")], default=0) + 1
        own = rows.select(*self.columns, "part")
        dealt = own.hint("rebalance", "part")  # a part is a file, unless it is large: then so many as its size asks for
        dealt.write.partitionBy("part").parquet(f"{self.path}/data/version={at}")
        fresh = names(self.spark, f"{self.path}/data/version={at}", "part=")
        gone = set() if add else set(before) if touched is None else set(touched)
        after = [(p, v) for p, versions in before.items() if p not in gone for v in versions] + [(p, at) for p in fresh]
        self.spark.createDataFrame(after, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{at}")

    def compact(self) -> None:
        """Parts of many versions are written as one."""
        many = [p for p, v in self.parts().items() if len(v) > MOST_VERSIONS]
        if many:
            self.write(self.read(many, part=True), many)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Takes away the versions that none of the last `keep` manifests names. Returns them."""
        manifests = done(self.spark, f"{self.path}/manifest")
        named: set[int] = set()
        for m in manifests[-keep:]:
            named |= {r["version"] for r in self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{m}").collect()}
        old = [v for v in numbers(self.spark, f"{self.path}/data", "version=") if manifests and v not in named and v < manifests[-1]]
        for v in old:
            remove(self.spark, f"{self.path}/data/version={v}")
        for m in manifests[:-keep]:
            remove(self.spark, f"{self.path}/manifest/{m}")
        return old
