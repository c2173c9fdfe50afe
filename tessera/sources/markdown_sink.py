"""Markdown files as a data source that is written with a job commit: a new export takes the old one's place, or nothing changes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: A file of this name says that a folder is an export, so that it may be replaced as a whole.
MARK = "_markdown_export"
FORMAT = "markdown_export"


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    store, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, base.rstrip("/")


def _there(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != fs.FileType.NotFound


def _empty(store: fs.FileSystem, path: str) -> bool:
    return not store.get_file_info(fs.FileSelector(path))


@dataclass
class Files(WriterCommitMessage):
    n: int


class MarkdownWriter(DataSourceArrowWriter):
    """Tasks write into a folder beside the export; two moves put it there when all have ended. The driver sees a count a task."""

    def __init__(self, path: str):
        self.path, self.staging, self.old = path, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        store, base = store_of(self.staging)
        made: set[str] = set()
        n = 0
        for batch in iterator:
            for to, text in zip(batch.column("path").to_pylist(), batch.column("document").to_pylist(), strict=True):
                if to is None or to.startswith("/") or ".." in to.split("/"):
                    raise ValueError(f"{to!r} is no place within an export")
                folder = f"{base}/{to}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{base}/{to}.{uuid.uuid4().hex}.part"
                try:
                    with store.open_output_stream(part) as f:
                        f.write((text or "").encode())
                    store.move(part, f"{base}/{to}")  # an attempt that runs again puts the same file there
                except BaseException:
                    if _there(store, part):
                        store.delete_file(part)
                    raise
                n += 1
        return Files(n)

    def commit(self, messages: list[Files | None]) -> None:
        store, new = store_of(self.staging)
        _, base = store_of(self.path)
        _, old = store_of(self.old)
        store.create_dir(new, recursive=True)
        with store.open_output_stream(f"{new}/{MARK}") as f:
            f.write(f"{sum(m.n for m in messages if m is not None)} files\n".encode())
        if _there(store, base):
            store.move(base, old)
        store.move(new, base)
        if _there(store, old):
            store.delete_dir(old)

    def abort(self, messages: list[Files | None]) -> None:
        store, new = store_of(self.staging)
        if _there(store, new):
            store.delete_dir(new)


class MarkdownExport(DataSource):
    """Rows path (within the export), document. Only mode overwrite: an export is replaced as a whole. A folder that holds
    anything else is left alone with an error. Where a driver was lost between the two moves, the next write puts the old
    export back first. For stores that move folders (shared mounts, HDFS)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> MarkdownWriter:
        if not overwrite:
            raise ValueError("an export is replaced as a whole: use mode overwrite")
        if not {"path", "document"} <= set(schema.names):
            raise ValueError("an export has the columns path and document")
        own = MarkdownWriter(self.options["path"])
        store, base = store_of(own.path)
        _, old = store_of(own.old)
        if _there(store, old):
            if _there(store, base):
                store.delete_dir(old)
            else:
                store.move(old, base)
        if _there(store, base) and not _there(store, f"{base}/{MARK}") and not _empty(store, base):
            raise ValueError(f"{own.path} holds files that are no export")
        return own


def export(files: DataFrame, path: str) -> None:
    """files (path, document) become the whole export at path, or nothing changes there."""
    files.sparkSession.dataSource.register(MarkdownExport)
    files.select("path", "document").write.format(FORMAT).mode("overwrite").save(path)
