"""Numbered folders on any store that Spark reads, which of them are whole, and a lock for one writer."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbered(spark: SparkSession, path: str, prefix: str) -> list[tuple[int, object, object]]:
    own, fs = _path(spark, path)
    if not fs.exists(own):
        return []
    found = [s.getPath() for s in fs.listStatus(own)]
    return sorted(((int(n), p, fs) for p in found if p.getName().startswith(prefix) and (n := p.getName()[len(prefix) :]).isdigit()), key=lambda x: x[0])


def numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    return [n for n, _, _ in _numbered(spark, path, prefix)]


def done(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """The numbers of folders whose write has ended."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return [n for n, p, fs in _numbered(spark, path, prefix) if fs.exists(of(p, "_SUCCESS"))]


def remove(spark: SparkSession, path: str) -> None:
    own, fs = _path(spark, path)
    fs.delete(own, True)


def exists(spark: SparkSession, path: str) -> bool:
    own, fs = _path(spark, path)
    return bool(fs.exists(own))


def put(spark: SparkSession, path: str) -> None:
    """An empty file."""
    own, fs = _path(spark, path)
    fs.create(own, True).close()


class Locked(RuntimeError):
    """Another writer is at work."""


@contextlib.contextmanager
def locked(spark: SparkSession, path: str) -> Iterator[None]:
    """Holds the file `path` while it lasts. A writer that died leaves it behind: unlock() takes it away."""
    own, fs = _path(spark, path)
    fs.mkdirs(own.getParent())
    if not fs.createNewFile(own):
        raise Locked(f"{path} is held by another writer")
    try:
        yield
    finally:
        fs.delete(own, False)


def unlock(spark: SparkSession, path: str) -> bool:
    own, fs = _path(spark, path)
    return bool(fs.delete(own, False))


def names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows the prefix in the names of the folders there."""
    own, fs = _path(spark, path)
    found = [s.getPath().getName() for s in fs.listStatus(own)] if fs.exists(own) else []
    return sorted(n[len(prefix) :] for n in found if n.startswith(prefix))
