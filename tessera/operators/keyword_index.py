"""A keyword index on disk that is kept up to date: segments of postings, and marks on the rows of older ones that are gone."""

from __future__ import annotations

import itertools
import math
import operator
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.match import Phrase
from tessera.operators.postings import B, K1, LEAST_IDF, asked_terms, scored_hits, token_lines
from tessera.sources.folders import done, numbers, remove
from tessera.sources.scratch import MADE, discard, written
from tessera.sources.tables import small_batches

#: Folders of a segment, and slots of all folders, by the first letters of a term: a term, or a prefix of so many letters, lies in
#: one of them.
BUCKETS, SLOTS, LETTERS = 32, 256, 2
#: Segments after which it is time to write the index anew.
MOST_SEGMENTS = 16
#: A segment's rows lie in ranges of like length, of about so many rows, and at most so many ranges.
RANGE_ROWS, MOST_RANGES = 128, 1024
#: Hits that a pruned search collects at most; rows that it scores at first, for each hit asked for, and how many times more
#: each time it goes on.
MOST_TOP, FIRST, MORE = 10_000, 4, 4
#: Bytes of tokens whose postings a task puts together at once.
AT_ONCE = 8 << 20
#: A row has the postings of all terms of a slot in ranges `low` to `high` of one task, so that a corpus of rare terms costs rows
#: by its size and not by its words. heads: an Arrow batch, a row a term and range. doc_ids (over `first`), lens, tfs: a number
#: for each document of each row of heads; places: one for each occurrence, its place in its column times the number of columns,
#: and the column's number. Numbers are unsigned, little-endian, and as narrow as the bytes by their count are.
POSTINGS = "slot int, low int, high int, first long, heads binary, doc_ids binary, lens binary, tfs binary, places binary, segment int, bucket int"
#: How many rows have a term in a range, how often at most, and how short the shortest is.
HEADS = pa.schema([("term", pa.string()), ("range", pa.int32()), ("docs", pa.int32()), ("max_tf", pa.int32()), ("min_len", pa.int32())])
#: Occurrences of one Arrow batch, about.
OCCURRENCES = 1 << 17
LENGTHS = "doc_id long, len int, segment int"
GONE = "doc_id long, len int, of int, segment int"
FACTS = "n long, tokens long, gone long, gone_tokens long, fresh boolean, segment int"


def slot_of(term: str) -> int:
    return zlib.crc32(term[:LETTERS].encode()) % SLOTS


def _nothing(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, and no task of Python."""
    return spark.range(0).select(*[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])


class KeywordIndex:
    """The columns of rows by key. A change writes one more segment: the new rows' postings, sorted by term in a folder for
    each bucket, and which rows of older segments they replace. Segments count once their facts are whole, so a job that dies
    changes nothing. Statistics are those of the rows that are there: sums over the segments' facts, a row each."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: list[str]):
        self.spark, self.path, self.key, self.columns = spark, path, key, columns

    def _facts(self) -> list:
        """The facts of the segments that count: those since the last one that began anew."""
        whole = done(self.spark, f"{self.path}/facts", "segment=")
        if not whole:
            return []
        rows = sorted(self.spark.read.schema(FACTS).parquet(f"{self.path}/facts").where(F.col("segment").isin(whole)).collect(), key=lambda r: r["segment"])
        start = max((i for i, r in enumerate(rows) if r["fresh"]), default=0)
        return rows[start:]

    def _read(self, name: str, schema: str, segments: list[int]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("segment").isin(segments))

    def lengths(self) -> DataFrame:
        """doc_id, len, segment of the rows that are there."""
        facts = self._facts()
        if not facts:
            return _nothing(self.spark, LENGTHS)
        own = [r["segment"] for r in facts]
        rows = self._read("lengths", LENGTHS, own)
        return self._without_gone(rows, facts, own)

    def _without_gone(self, rows: DataFrame, facts: list, segments: list[int]) -> DataFrame:
        if not sum(r["gone"] for r in facts):
            return rows
        gone = self._read("gone", GONE, segments).select("doc_id", F.col("of").alias("segment"))
        return rows.join(gone, ["doc_id", "segment"], "left_anti")

    def add(self, docs: DataFrame, fresh: bool = False) -> None:
        """The rows of docs, one a key, come in or replace those with their keys; with fresh the index begins anew. Texts are
        cut into tokens once, and dealt by their range, rows of like length; a task puts the postings of a slot's terms
        into one row, and notes of each term and range how many rows have it, how often at most, and how short the shortest is: what
        a row there can score at best. (A range that several tasks or batches share is noted by each.)"""
        small_batches(self.spark)
        own = written(token_lines(docs, self.key, self.columns), "tokens", compression="zstd")
        made = MADE[-1]
        at = self._begin()
        own.select("doc_id", "len").write.parquet(f"{self.path}/lengths/segment={at}")
        salts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
        lengths = self._read("lengths", LENGTHS, [at])
        ranges = lengths.select("len").distinct().withColumn("range", self._range(lengths))  # a row a length
        ranged = own.join(ranges, "len").select("doc_id", "len", "range", "lines").repartitionByRange("range", "doc_id")
        columns = ", ".join(c for c in POSTINGS.split(", ") if c.split()[0] not in ("segment", "bucket"))
        rows = ranged.mapInArrow(_postings, columns).withColumn("bucket", F.pmod(F.col("slot"), F.lit(BUCKETS)))
        dealt = rows.repartition("bucket", F.pmod(F.col("low"), F.lit(salts)))  # a very common term is in so many tasks
        dealt.sortWithinPartitions("bucket", "slot", "low").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings/segment={at}")
        self._end(at, lengths.select("doc_id"), fresh)
        discard(self.spark, [made])

    @staticmethod
    def _range(lengths: DataFrame) -> Column:
        """The range of a row of so many tokens: cuts between the lengths' quantiles, MOST_RANGES at most."""
        n = lengths.count()
        ranges = min(MOST_RANGES, max(1, math.ceil(n / RANGE_ROWS)))
        cuts = lengths.agg(F.percentile_approx("len", [i / ranges for i in range(1, ranges)], 10 * MOST_RANGES)).first()[0] if ranges > 1 else []
        marks = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<int>")
        return F.size(F.filter(marks, lambda c: c < F.col("len"))).cast("int")

    def remove(self, ids: DataFrame) -> None:
        """ids: the key of rows that go."""
        at = self._begin()
        _nothing(self.spark, "doc_id long, len int").write.parquet(f"{self.path}/lengths/segment={at}")
        self._end(at, ids.select(F.col(self.key).cast("long").alias("doc_id")), False)

    def _begin(self) -> int:
        return max(numbers(self.spark, f"{self.path}/lengths", "segment="), default=0) + 1

    def _end(self, at: int, replaced: DataFrame, fresh: bool) -> None:
        before = self.lengths() if not fresh else _nothing(self.spark, LENGTHS)
        gone = before.where(F.col("segment") != at).join(replaced, "doc_id", "left_semi")
        gone.select("doc_id", "len", F.col("segment").alias("of")).write.parquet(f"{self.path}/gone/segment={at}")
        sums = lambda name, schema, n, t: self._read(name, schema, [at]).agg(F.count("*").alias(n), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias(t))
        facts = sums("lengths", LENGTHS, "n", "tokens").join(F.broadcast(sums("gone", GONE, "gone", "gone_tokens")))  # one row each
        facts.withColumn("fresh", F.lit(fresh)).coalesce(1).write.parquet(f"{self.path}/facts/segment={at}")

    def is_old(self) -> bool:
        """Whether there are many segments, or many rows of them gone: time for add(…, fresh=True)."""
        facts = self._facts()
        return len(facts) > MOST_SEGMENTS or 3 * sum(r["gone"] for r in facts) > sum(r["n"] for r in facts)

    def counts(self) -> tuple[int, int]:
        """Rows that are there, and their tokens."""
        facts = self._facts()
        return sum(r["n"] - r["gone"] for r in facts), sum(r["tokens"] - r["gone_tokens"] for r in facts)

    def hits(self, plan: list[list[Phrase]], column: str | None = None) -> DataFrame:
        """variant, doc_id, score as keyword_hits() of postings.py gives them over the rows that are there. Of the postings only
        the folders and row groups of the plan's terms are read."""
        facts = self._facts()
        if not facts or not plan or not all(plan):
            return _nothing(self.spark, "variant int, doc_id long, score double")
        own = [r["segment"] for r in facts]
        n, length = self.counts()
        return scored_hits(self._without_gone(self._occurrences(self._asked(own, asked_terms(plan)), asked_terms(plan)), facts, own), n, length, plan, column)

    def _occurrences(self, rows: DataFrame, asked: set[tuple[str, bool]] | None = None) -> DataFrame:
        """doc_id, col, len, pos, term, range, segment: of rows of postings the terms asked for, a row an occurrence."""
        each = rows.select("segment", "first", "heads", "doc_ids", "lens", "tfs", "places").mapInArrow(_unpacked(asked), "term string, range int, segment int, doc_id long, len int, place int")
        width = len(self.columns)
        col = F.element_at(F.array(*map(F.lit, self.columns)), F.col("place") % width + 1)
        return each.select("doc_id", col.alias("col"), "len", F.floor(F.col("place") / width).cast("int").alias("pos"), "term", "range", "segment")

    def _counted(self, rows: DataFrame, asked: set[tuple[str, bool]], within: dict[int, list[int]] | None = None) -> DataFrame:
        """doc_id, len, tf, term, range, segment: the same, a row a document and term; within: the ranges of each segment."""
        return rows.select("segment", "first", "heads", "doc_ids", "lens", "tfs").mapInArrow(_unpacked(asked, within), "term string, range int, segment int, doc_id long, len int, tf int")

    def _heads(self, rows: DataFrame, asked: set[tuple[str, bool]]) -> DataFrame:
        """segment, term, range, docs, max_tf, min_len."""
        return rows.select("segment", "heads").mapInArrow(_unpacked_heads(asked), "segment int, term string, range int, docs int, max_tf int, min_len int")

    def _asked(self, segments: list[int], asked: set[tuple[str, bool]]) -> DataFrame:
        """Rows of postings that may have the asked terms, from their folders only."""
        rows = self._read("postings", POSTINGS, segments)
        if all(len(t) >= LETTERS or not prefix for t, prefix in asked):
            slots = sorted({slot_of(t) for t, _ in asked})
            rows = rows.where(F.col("bucket").isin(sorted({s % BUCKETS for s in slots})) & F.col("slot").isin(slots))
        return rows

    def top(self, phrases: list[Phrase], n: int, allowed: DataFrame | None = None) -> DataFrame:
        """doc_id, score of the n best rows that have all phrases, ties to the smaller key; allowed: the doc_ids that may be
        among them. What hits() and a sort give, but of the postings only those are read that may hold such a row: ranges
        whose best possible score is under that of the n-th hit so far are passed over. Phrases of several tokens, and more
        than MOST_TOP hits, are scored in full."""
        if n > MOST_TOP or any(len(p.tokens) != 1 for p in phrases):
            found = self.hits([phrases]).select("doc_id", "score")
            best = (found if allowed is None else found.join(allowed, "doc_id", "left_semi")).orderBy("score", "doc_id").limit(n)
            if n > MOST_TOP:
                return best
            rows = [tuple(r) for r in best.collect()]
        else:
            rows = self.pruned(phrases, n, allowed)[0]
        return self.spark.createDataFrame(rows, "doc_id long, score double")

    def pruned(self, phrases: list[Phrase], n: int, allowed: DataFrame | None = None) -> tuple[list[tuple[int, float]], dict[str, int]]:
        """The rows of top(), for phrases of one token, and how many postings (a row with a term) there are and were read."""
        facts = self._facts()
        count, length = self.counts()
        report = {"postings": 0, "read": 0, "ranges": 0, "ranges_read": 0}
        if not facts or not phrases or not count:
            return [], report
        own, average = [r["segment"] for r in facts], length / count or 1.0
        slots = [(i, p.tokens[0], p.prefix) for i, p in enumerate(phrases)]
        asked = asked_terms([phrases])
        fits = lambda t, prefix: F.col("term").startswith(t) if prefix else F.col("term") == t
        phrase = F.explode(F.array_compact(F.array(*[F.when(fits(t, prefix), F.lit(i)) for i, t, prefix in slots])))
        blocks = self._heads(self._asked(own, asked), asked).groupBy("segment", "range", "term").agg(F.sum("docs").alias("docs"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
        blocks = blocks.select("segment", "range", "term", "docs", "max_tf", "min_len", phrase.alias("phrase"))
        # a row a segment, range and phrase: at most MOST_SEGMENTS times MOST_RANGES of each phrase
        ranges = blocks.groupBy("segment", "range", "phrase").agg(F.sum("docs").alias("docs"), F.sum("max_tf").alias("tf"), F.min("min_len").alias("len"), F.min("term").alias("first"), F.max("term").alias("last")).collect()
        weights = []
        for i, t, prefix in slots:
            mine = [r for r in ranges if r["phrase"] == i]
            if len({x for r in mine for x in (r["first"], r["last"])}) <= 1 and not sum(r["gone"] for r in facts):
                df = sum(r["docs"] for r in mine)
            else:  # rows with several of the terms, or that are gone, are told apart
                df = self._without_gone(self._counted(self._asked(own, {(t, prefix)}), {(t, prefix)}).select("segment", "doc_id").distinct(), facts, own).count()
            idf = math.log((count - df + 0.5) / (df + 0.5))
            weights.append(idf if idf > 0 else LEAST_IDF)

        best, rows = defaultdict(float), defaultdict(list)
        for r in ranges:
            best[r["segment"], r["range"]] += weights[r["phrase"]] * r["tf"] * (K1 + 1) / (r["tf"] + K1 * (1 - B + B * r["len"] / average))
            rows[r["segment"], r["range"]].append(r["docs"])
        waiting = sorted((place for place, docs in rows.items() if len(docs) == len(phrases)), key=lambda p: (-best[p], p))
        report |= {"postings": sum(map(sum, rows.values())), "ranges": len(rows)}

        top: list[tuple[int, float]] = []
        most = max(256, FIRST * n)
        while waiting:
            least = -top[n - 1][1] if len(top) >= n else 0.0
            waiting = [p for p in waiting if best[p] * (1 + 1e-9) >= least]
            now, seen = [], 0
            for p in waiting:
                now.append(p)
                seen += min(rows[p])
                if seen >= most:
                    break
            if not now:
                break
            waiting, most = waiting[len(now) :], most * MORE
            report["read"] += sum(sum(rows[p]) for p in now)
            report["ranges_read"] += len(now)
            by_segment: dict[int, list[int]] = defaultdict(list)
            for segment, place in now:
                by_segment[segment].append(place)
            near = reduce(operator.or_, [(F.col("segment") == x) & (F.col("low") <= max(places)) & (F.col("high") >= min(places)) for x, places in by_segment.items()])  # reaches the scan
            found = self._without_gone(self._counted(self._asked(own, asked).where(near), asked, dict(by_segment)), facts, own).select("doc_id", "len", "tf", phrase.alias("phrase"))
            tf = found.groupBy("doc_id", "len", "phrase").agg(F.sum("tf").alias("tf"))
            weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("phrase") + 1)
            gain = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / average))
            scored = tf.groupBy("doc_id").agg(F.sum(-gain).alias("score"), F.count("*").alias("phrases")).where(F.col("phrases") == len(phrases)).drop("phrases")
            if allowed is not None:
                scored = scored.join(allowed, "doc_id", "left_semi")
            hits = [(r["doc_id"], r["score"]) for r in scored.orderBy("score", "doc_id").limit(n).collect()]  # a page
            top = sorted(top + hits, key=lambda x: (x[1], x[0]))[:n]
        return top, report

    def vacuum(self) -> list[int]:
        """Takes away the segments from before the index last began anew. Returns them."""
        facts = self._facts()
        names_ = ("lengths", "postings", "gone", "facts")
        old = sorted({x for name in names_ for x in numbers(self.spark, f"{self.path}/{name}", "segment=") if facts and x < facts[0]["segment"]})
        for x in old:
            for name in names_:
                remove(self.spark, f"{self.path}/{name}/segment={x}")
        return old


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, len, range, lines as rows of postings, of about AT_ONCE bytes of lines at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= AT_ONCE:
            yield from _grouped(held)
            held, size = [], 0
    yield from _grouped(held)


def _grouped(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).sort_by([("range", "ascending"), ("doc_id", "ascending")]).combine_chunks() if held else None
    if rows is None or not rows.num_rows:
        return
    ids, lens, ranges = (rows[c].to_numpy() for c in ("doc_id", "len", "range"))
    lines = pc.list_flatten(rows["lines"]).combine_chunks()  # a line a column of each row
    width = len(lines) // rows.num_rows
    terms, owners, places = [], [], []
    for c in range(width):
        words = pc.split_pattern(lines.take(pa.array(np.arange(c, len(lines), width))), " ")
        counts = np.asarray(pc.list_value_length(words))
        flat = pc.list_flatten(words)
        owner = np.repeat(np.arange(rows.num_rows), counts)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        some = np.asarray(pc.not_equal(flat, ""))  # a line without tokens is split into one that is empty
        terms.append(flat.filter(pa.array(some)))
        owners.append(owner[some])
        places.append(place[some] * width + c)
    coded = pa.concat_arrays(terms).dictionary_encode()
    if not len(coded):
        return
    begun = pc.utf8_slice_codeunits(coded.dictionary, 0, LETTERS).dictionary_encode()
    slots = np.array([slot_of(x) for x in begun.dictionary.to_pylist()])[np.asarray(begun.indices)]
    by_slot = np.argsort(slots, kind="stable")  # words are numbered anew, slot by slot
    number = np.empty(len(slots), np.int64)
    number[by_slot] = np.arange(len(slots))
    slots, words = slots[by_slot], coded.dictionary.take(pa.array(by_slot))
    codes, owner, place = number[np.asarray(coded.indices)], np.concatenate(owners), np.concatenate(places)
    key = codes * rows.num_rows + owner
    order = np.argsort(key, kind="stable")  # by term and row; columns and places keep their order
    key, codes, owner = key[order], codes[order], owner[order]
    new_doc = np.append(True, key[1:] != key[:-1])
    new_row = np.append(True, (codes[1:] != codes[:-1]) | (ranges[owner[1:]] != ranges[owner[:-1]]))
    docs = np.flatnonzero(new_doc)
    rows_at = np.flatnonzero(new_row[docs])  # the first row of each term and range
    tf, own = np.diff(np.append(docs, len(key))), owner[docs]
    spans = np.diff(np.append(rows_at, len(docs)))
    starts = docs[rows_at]
    first, by_doc, at = int(ids.min()), np.append(rows_at, len(docs)), ranges[own[rows_at]]
    columns = [words.take(pa.array(codes[starts])), at, spans, np.maximum.reduceat(tf, rows_at), np.minimum.reduceat(lens[own], rows_at)]
    heads = pa.RecordBatch.from_arrays([columns[0], *[pa.array(c, pa.int32()) for c in columns[1:]]], schema=HEADS)
    numbers_ = [(ids[own].view(np.uint64) - np.int64(first).view(np.uint64)), lens[own], tf, place[order]]
    slot = slots[codes[starts]]
    cuts = np.append(np.flatnonzero(np.append(True, slot[1:] != slot[:-1])), len(slot))
    doc_cuts, place_cuts = by_doc[cuts], np.append(starts, len(key))[cuts]
    for n, (i, j) in enumerate(itertools.pairwise(cuts.tolist())):
        packed = [_packed(x[c[n] : c[n + 1]]) for x, c in zip(numbers_, (doc_cuts, doc_cuts, doc_cuts, place_cuts), strict=True)]
        values = [int(slot[i]), int(at[i:j].min()), int(at[i:j].max()), first, heads.slice(i, j - i).serialize().to_pybytes(), *packed]
        yield pa.RecordBatch.from_pydict({c.split()[0]: [v] for c, v in zip(POSTINGS.split(", "), values, strict=False)}, schema=_BLOCK)


_BLOCK = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in POSTINGS.split(", ")[:-2]])


def _packed(values: np.ndarray) -> bytes:
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if int(values.max()) <= np.iinfo(k).max)
    return values.astype(kind).tobytes()


def _numbers(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, f"<u{len(packed) // n}")


def _fits(heads: pa.RecordBatch, asked: set[tuple[str, bool]] | None, ranges: list[int] | None) -> pa.Array:
    """Which rows of heads are asked for, in some ranges."""
    terms = heads["term"]
    out = pa.array(np.full(len(terms), asked is None))
    if asked is not None:
        out = pc.is_in(terms, value_set=pa.array(sorted(t for t, prefix in asked if not prefix), pa.string()))
        for t in sorted(t for t, prefix in asked if prefix):
            out = pc.or_(out, pc.starts_with(terms, pattern=t))
    return out if ranges is None else pc.and_(out, pc.is_in(heads["range"], value_set=pa.array(ranges, pa.int32())))


def _unpacked_heads(asked: set[tuple[str, bool]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heads = pa.ipc.read_record_batch(pa.py_buffer(packed), HEADS)
                own = heads.filter(_fits(heads, asked, None))
                if own.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.num_rows, segment), pa.int32()), *own.columns], names=["segment", *HEADS.names])

    return run


def _unpacked(asked: set[tuple[str, bool]] | None, within: dict[int, list[int]] | None = None):
    """Rows of postings as rows of documents with tf, or of occurrences with place where places are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            each = "places" in batch.schema.names
            for segment, first, packed, ids, lens, tfs, *places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heads = pa.ipc.read_record_batch(pa.py_buffer(packed), HEADS)
                fits = np.flatnonzero(_fits(heads, asked, None if within is None else within.get(segment, [])))
                if not len(fits):
                    continue
                ends = np.cumsum(heads["docs"].to_numpy())
                ids, lens, tfs = (_numbers(x, int(ends[-1])) for x in (ids, lens, tfs))
                until = np.append(0, np.cumsum(tfs, dtype=np.int64))
                spots = _numbers(places[0], int(until[-1])) if each else None
                own = heads.take(pa.array(fits))
                for i, term, at, docs in zip(fits.tolist(), own["term"].to_pylist(), own["range"].to_pylist(), own["docs"].to_pylist(), strict=True):
                    j = int(ends[i])
                    mine = slice(j - docs, j)
                    tf = tfs[mine].astype(np.int32)
                    doc_ids = (ids[mine].astype(np.uint64) + np.int64(first).view(np.uint64)).view(np.int64)
                    columns = (doc_ids, lens[mine].astype(np.int32))
                    last = spots[until[j - docs] : until[j]].astype(np.int32) if each else tf
                    held.append((term, at, segment, *(np.repeat(x, tf) if each else x for x in columns), last))
                    size += len(last)
                    if size >= OCCURRENCES:
                        yield _rows(held, each)
                        held, size = [], 0
        if held:
            yield _rows(held, each)

    return run


def _rows(held: list[tuple], each: bool) -> pa.RecordBatch:
    terms, ranges, segments, *numbers_ = zip(*held, strict=True)
    of = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in numbers_[2]]))
    columns = [pa.array(terms, pa.string()).take(of), pa.array(ranges, pa.int32()).take(of), pa.array(segments, pa.int32()).take(of), *[pa.array(np.concatenate(x)) for x in numbers_]]
    return pa.RecordBatch.from_arrays(columns, names=["term", "range", "segment", "doc_id", "len", "place" if each else "tf"])
