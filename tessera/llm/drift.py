"""Drifted schemas: rows ranked by a checksum, written as files of changing schemas, and rewritten to one evolved schema.

Both ways of dealing rows out are an RDD partitioner with repartitionAndSortWithinPartitions: ranges of the checksum for
ranking, then the file's number, with the rank as the second sort key, for writing and for rewriting. Files are streamed
through pyarrow, so the folder must be one that it can open: a shared mount, s3, gs, or hdfs.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import row_key
from tessera.sources.scratch import fresh_path

#: Files at most (rows of a file: one more than the rows over this).
FILES = 500
#: Rows and bytes of texts of a row group (a single row may be larger), and rows of a batch in memory.
GROUP, GROUP_BYTES, BATCH = 20_000, 16 << 20, 2_000
LEAST = -(1 << 63)


class Field(NamedTuple):
    """A column of the evolved schema: its Parquet field id, name, Arrow type, and what stands for it where a file lacks it."""

    id: int
    name: str
    type: pa.DataType
    fill: object = None


#: Bits of a version, what each does to a file.
SWAPPED, REVERSED, LACKING, NARROW = 1, 2, 4, 8
#: Columns that SWAPPED, LACKING and NARROW touch.
SWAP, LACK, NARROWER = ("name", "email"), {"nation_id": -1, "source": "none"}, {"balance": pa.float32(), "nation_id": pa.int32()}


def version_of(file_no: int) -> int:
    found = zlib.crc32(f"42:{file_no}".encode()) % 24
    return 0 if found > 15 else found


def evolved(rows: DataFrame) -> list[Field]:
    """The evolved schema of a table: its columns, nullable, nation_id as long, field ids from 1."""
    return [Field(i, f.name, pa.int64() if f.name == "nation_id" else to_arrow_type(f.dataType), LACK.get(f.name)) for i, f in enumerate(rows.schema, 1)]


def drifted(fields: list[Field], version: int) -> list[tuple[int, str, pa.DataType]]:
    """Id, name and type of the columns of a file of this version, in its order."""
    names = {f.id: f.name for f in fields}
    if version & SWAPPED:
        at = {f.name: f.id for f in fields}
        names[at[SWAP[0]]], names[at[SWAP[1]]] = SWAP[1], SWAP[0]
    own = [(f.id, names[f.id], NARROWER.get(f.name, f.type) if version & NARROW else f.type) for f in fields if not (version & LACKING and f.name in LACK)]
    return own[:1] + own[:0:-1] if version & REVERSED else own


def arrow_schema(columns: Iterable[tuple[int, str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(name, kind, True, {"PARQUET:field_id": str(i)}) for i, name, kind in columns])


def ids_of(schema: pa.Schema) -> list[int | None]:
    return [int(v) if (v := (f.metadata or {}).get(b"PARQUET:field_id")) else None for f in schema]


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def file_name(file_no: int) -> str:
    return f"file-{file_no:05d}.parquet"


def file_no_of(path: str) -> int:
    return int(path.rpartition("/")[2][5:10])


# -- ranking ---------------------------------------------------------------------------------------------------------------


def _micros(c: Column, kind: str) -> Column:
    """A time as microseconds since 1970, UTC; other values as they are."""
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        gap = c - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
        day, hour, minute, second = (F.extract(F.lit(k), gap) for k in ("DAY", "HOUR", "MINUTE", "SECOND"))
        return ((day.cast("long") * 24 + hour) * 60 + minute) * 60_000_000 + (second * 1_000_000).cast("long")
    return c


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """crc, given, id (the place in the order: checksum, rows without a key first, key), t (what tells rows of one key apart),
    salt (what tells equal rows apart), row (all columns, times as microseconds)."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    row = F.struct(*(_micros(F.col(n), k).alias(f"c{i}") for i, (n, k) in enumerate(rows.dtypes)))
    return rows.select(F.crc32(text.cast("binary")).alias("crc"), F.col(key).isNotNull().cast("int").alias("given"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), row_key(*rows.columns)[0].alias("t"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), row.alias("row"))


def cuts(keys: DataFrame, parts: int) -> list[tuple]:
    """Where the ranges of the order begin: even ranges of the checksum, and, where one key has more rows than a range should
    have, ranges of what tells its rows apart, for equal rows of their salt. At most `parts` of either kind reach the driver:
    bins of the checksum are counted first, and only full ones looked into."""
    bins = 16 * parts
    bin_of = (F.col("crc") * bins / F.lit(float(1 << 32))).cast("long")
    total, per_bin = keys.count(), keys.groupBy(bin_of.alias("bin")).count()
    share = max(1, math.ceil(total / parts))
    full = [r["bin"] for r in per_bin.where(F.col("count") > max(share, 1000)).collect()]
    found = {(math.ceil(i * (1 << 32) / parts), 0, LEAST, LEAST, LEAST) for i in range(1, parts)}
    if full:
        groups = keys.where(bin_of.isin(full)).groupBy("crc", "given", "id", "t").agg(F.count("*").alias("n"))
        hot = groups.groupBy("crc", "given", "id").agg(F.sum("n").alias("n")).where(F.col("n") > share).collect()
        copies = groups.where(F.col("n") > share).collect() if hot else []
        for r, own in [*((r, (r["crc"], r["given"], r["id"])) for r in hot), *((r, (r["crc"], r["given"], r["id"], r["t"])) for r in copies)]:
            k = math.ceil(r["n"] / share)
            rest = (LEAST,) * (4 - len(own))
            found |= {(*own, LEAST + (i << 64) // k, *rest) for i in range(k)} | {(*own[:-1], own[-1] + 1, LEAST, *rest)}
    return sorted(found)


def ranked(rows: DataFrame, key: str = "client_id", parts: int | None = None) -> tuple[RDD, int]:
    """(rank, row) for all rows in the order of unsigned crc32 of the key's decimal text, then of the key, and how many rows
    there are. Rows without a key come first, with checksum 0; rows of one key stand in the order of a hash of their columns."""
    keys = keyed(rows, key)
    starts = cuts(keys.select("crc", "given", "id", "t"), parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = keys.rdd.map(lambda r: ((r[0], r[1], r[2], r[3], r[4]), tuple(r[5])))
    sorted_rows = pairs.repartitionAndSortWithinPartitions(len(starts) + 1, lambda k: bisect.bisect_right(starts, k))
    sizes = dict(sorted_rows.mapPartitionsWithIndex(lambda i, it: [(i, sum(1 for _ in it))]).collect())
    before, total = {}, 0
    for i in sorted(sizes):
        before[i], total = total, total + sizes[i]

    def places(i: int, it: Iterator) -> Iterator[tuple[int, tuple]]:
        return ((before[i] + j, row) for j, (_, row) in enumerate(it))

    return sorted_rows.mapPartitionsWithIndex(places), total


# -- files -----------------------------------------------------------------------------------------------------------------


def _table(rows: list[tuple], schema: pa.Schema, at: list[int]) -> pa.Table:
    """rows: one value a field of the evolved schema, times as microseconds. at: which of them each column takes."""
    columns = []
    for f, i in zip(schema, at, strict=True):
        values = [r[i] for r in rows]
        columns.append(pa.array(values, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(values, pa.float64()).cast(f.type, safe=False) if pa.types.is_float32(f.type) else pa.array(values, f.type))
    return pa.Table.from_arrays(columns, schema=schema)


def _write(uri: str, schema: pa.Schema, at: list[int], rows: Iterator[tuple]) -> None:
    """One file, whole or not there: streamed under a name of its own, then moved. A task that is run again writes the same."""
    place, path = _opened(uri)
    attempt, held, size = f"{path}.{uuid.uuid4().hex}.attempt", [], 0
    with place.open_output_stream(attempt) as out, pq.ParquetWriter(out, schema) as writer:
        for row in rows:
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if len(held) == GROUP or size >= GROUP_BYTES:
                writer.write_table(_table(held, schema, at))
                held, size = [], 0
        writer.write_table(_table(held, schema, at))
    place.move(attempt, path)


def filed(rows: RDD, n_files: int, parts: int, write: Callable[[int, Iterator[tuple]], object]) -> RDD:
    """rows: ((file_no, place), row). Deals them out by file_no, sorted by file_no and place, and calls write(file_no, rows in
    order) for each file; returns what it gives."""
    parts = min(parts, n_files)

    def files(it: Iterator) -> Iterator[object]:
        row = next(it, None)
        while row is not None:
            file_no = row[0][0]

            def own() -> Iterator[tuple]:
                nonlocal row
                while row is not None and row[0][0] == file_no:
                    yield row[1]
                    row = next(it, None)

            yield write(file_no, own())

    return rows.repartitionAndSortWithinPartitions(parts, lambda k: k[0] * parts // n_files).mapPartitions(files)


def write_drifted(rows: DataFrame, folder: str, key: str = "client_id", most_files: int = FILES) -> dict[int, list[str]]:
    """Writes the ranked rows as files, each in the schema of its version; gives each file's names of columns, in order."""
    fields, spark = evolved(rows), rows.sparkSession
    by_rank, total = ranked(rows, key)
    if not total:
        return {}
    size = 1 + total // most_files
    n_files = math.ceil(total / size)
    at = {f.id: i for i, f in enumerate(fields)}

    def write(file_no: int, own: Iterator[tuple]) -> tuple[int, list[str]]:
        columns = drifted(fields, version_of(file_no))
        _write(f"{folder}/{file_name(file_no)}", arrow_schema(columns), [at[c[0]] for c in columns], own)
        return file_no, [c[1] for c in columns]

    place, path = _opened(folder)
    place.create_dir(path)
    return dict(filed(by_rank.map(lambda x: ((x[0] // size, x[0]), x[1])), n_files, _parts(spark), write).collect())


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def data_files(folder: str) -> list[str]:
    """The folder's files in order; as many as write_drifted makes at most, whatever the table's size."""
    place, path = _opened(folder)
    return sorted(f"{folder}/{x.base_name}" for x in place.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.base_name.endswith(".parquet"))


def _units(uri: str, fields: list[Field]) -> list[tuple[str, int, int]]:
    """Path, number and first row of each row group of a file that is not in the evolved schema."""
    place, path = _opened(uri)
    with place.open_input_file(path) as f:
        found = pq.ParquetFile(f)
        wanted = arrow_schema((x.id, x.name, x.type) for x in fields)
        if found.schema_arrow.remove_metadata().equals(wanted, check_metadata=False) and ids_of(found.schema_arrow) == ids_of(wanted):
            return []
        out, begun = [], 0
        for i in range(found.metadata.num_row_groups):
            out.append((uri, i, begun))
            begun += found.metadata.row_group(i).num_rows
        return out


def _values(column: pa.Array) -> list:
    return column.cast(pa.int64()).to_pylist() if pa.types.is_timestamp(column.type) else column.to_pylist()


def _read(unit: tuple[str, int, int], fields: list[Field]) -> Iterator[tuple[tuple[int, int], tuple]]:
    """Rows of a row group by the fields' ids, in the evolved order; a field that the file lacks takes its fill."""
    uri, group, begun = unit
    place, path = _opened(uri)
    with place.open_input_file(path) as f:
        found = pq.ParquetFile(f)
        at = {i: n for n, i in enumerate(ids_of(found.schema_arrow)) if i is not None}
        for batch in found.iter_batches(BATCH, row_groups=[group]):
            columns = [_values(batch.column(at[x.id])) if x.id in at else [x.fill] * batch.num_rows for x in fields]
            for row in zip(*columns, strict=True):
                yield (file_no_of(uri), begun), row
                begun += 1


def rewrite(spark: SparkSession, folder: str, staging: str, fields: list[Field]) -> set[int]:
    """Turns each file of the folder whose columns are not the evolved ones (ids, names, types, order) into one that has them,
    with its rows in order; the others are not touched. Files are read by row groups, many tasks side by side. New files are
    made in the folder `staging` and take the old ones' places when all are there, so a task that is run again reads what the
    first one read. Gives the numbers of the files that were rewritten."""
    paths, sc = data_files(folder), spark.sparkContext
    if not paths:
        return set()
    schema = arrow_schema((x.id, x.name, x.type) for x in fields)
    out, out_path = _opened(staging)
    out.create_dir(out_path)

    def write(file_no: int, own: Iterator[tuple]) -> int:
        _write(f"{staging}/{file_name(file_no)}", schema, list(range(len(fields))), own)
        return file_no

    parts = _parts(spark)
    units = sc.parallelize(paths, min(parts, len(paths))).flatMap(lambda p: _units(p, fields)).map(lambda u: (u, None)).partitionBy(parts, lambda u: zlib.crc32(repr(u).encode()))
    done = filed(units.flatMap(lambda u: _read(u[0], fields)), max(map(file_no_of, paths)) + 1, parts, write).collect()
    place, path = _opened(folder)
    for file_no in done:
        place.move(f"{out_path}/{file_name(file_no)}", f"{path}/{file_name(file_no)}")
    place.delete_dir(out_path)
    return set(done)


# -- what is in the files --------------------------------------------------------------------------------------------------


def plain(value: object, kind: pa.DataType) -> str:
    """A value as it stands in a row's digest: null `?`, times as microseconds, fractions as 2^-20ths rounded down."""
    if value is None:
        return "?"
    if isinstance(value, float):
        return str(math.floor(value * 1048576)) if math.isfinite(value) else str(value)
    return str(value)


def digest(uri: str) -> dict[str, object]:
    """Rows, nulls, columns and digests of one file, read in stretches."""
    place, path = _opened(uri)
    ids, rows, n_rows, n_nulls, sep = hashlib.sha256(), hashlib.sha256(), 0, 0, b""
    with place.open_input_file(path) as f:
        found = pq.ParquetFile(f)
        schema = found.schema_arrow
        for batch in (b for i in range(found.metadata.num_row_groups) for b in found.iter_batches(BATCH, row_groups=[i])):
            n_rows += batch.num_rows
            n_nulls += sum(c.null_count for c in batch.columns)
            columns = [[plain(v, k.type) for v in _values(c)] for c, k in zip(batch.columns, schema, strict=True)]
            ids.update((b"," if sep else b"") + ",".join(columns[0]).encode())
            rows.update(sep + "\n".join(map("|".join, zip(*columns, strict=True))).encode())
            sep = b"\n"
    return {"n_rows": n_rows, "n_nulls": n_nulls, "ids_sha256": ids.hexdigest(), "rows_sha256": rows.hexdigest(), "columns": ",".join(schema.names)}


RESULT = "file_no long, version long, n_rows long, n_nulls long, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"


def drifted_rewrite(rows: DataFrame, key: str = "client_id", folder: str | None = None) -> DataFrame:
    """Ranks rows by their key's checksum, writes them as drifted files in a new folder of the shared one, rewrites those, and
    returns one row a final file: file_no, version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns, columns, path,
    rewritten, read from the files that are there in the end.

    Null keys: first, checksum 0, `?` among the ids. Repeated rows and keys: all stay, equal keys in the order of a hash of
    their columns. Nulls stay null, of any column; only what a file lacks is filled. A fraction that is no number or has no
    end stands in rows_sha256 as `nan`, `inf` or `-inf`. No rows: no files and no rows. Texts of any length: row groups are
    cut by rows and bytes."""
    spark = rows.sparkSession
    root = folder or fresh_path(spark, "drifted")
    files, fields = f"{root}/files", evolved(rows)
    names = write_drifted(rows, files, key)
    done = rewrite(spark, files, f"{root}/staging", fields)

    def row(path: str) -> tuple:
        own, file_no = digest(path), file_no_of(path)
        return file_no, version_of(file_no), own["n_rows"], own["n_nulls"], own["ids_sha256"], own["rows_sha256"], ",".join(names[file_no]), own["columns"], path, file_no in done

    paths = data_files(files) if names else []
    return spark.createDataFrame(spark.sparkContext.parallelize(paths, max(1, min(_parts(spark), len(paths)))).map(row), RESULT)
