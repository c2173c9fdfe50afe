"""Spelling variants: words one edit apart, found by scans of a dictionary sorted forwards and one sorted backwards.

Two words that differ by one edit agree before it and behind it, so one of their halves is the same. A word stands in a
block with all words that share its first half (forward dictionary) and in one with those that share its last half
(reversed dictionary). A block that is large is divided in the same way: of the part that its words do not share, either
the first half is the same or the rest is. Each step halves where the edit can be, and an edit lies on one side only, so
each pair of words is found once. In the end a block's words agree in all but one place, and there are no more of them
than letters. Words of equal length (kind r, one letter replaced) and of lengths m and m + 1 (kind i, one put in) have
blocks of their own.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare, written

#: Code points and occurrences that a word has at least; how much more frequent its form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a code point.
DROP = 199
#: Characters of a text that are counted at once.
STRETCH = 1 << 20
#: Words of a block that one task holds; larger blocks are divided over tasks. Words that are held against each other directly.
BLOCK, FEW = 10_000, 12

LETTER = "a-z\u00c0-\u00ff"
NO_LETTER = re.compile(f"[^{LETTER}]")

#: A word in a block, last: one that cannot be divided. A pair has no block.
ENTRY = pa.schema([("block", pa.string()), ("last", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])
FOUND = pa.schema([*ENTRY, ("near", pa.string()), ("near_n", pa.int64())])


def _sql(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Places that part a text between runs of letters."""
    at = 0
    while at < len(text):
        found = NO_LETTER.search(text, min(at + size, len(text)))
        end = found.start() if found else len(text)
        yield at, end
        at = max(end, at + 1)


def counted(doc: int | None, text: str, least: int = LEAST_LENGTH, drop: int = DROP) -> Iterator[Counter]:
    """Words of a text whose A-Z are lower-cased, each with its count; runs that the checksum of doc and run picks have lost
    a code point."""
    start, runs = zlib.crc32(b"%d:" % doc if doc is not None else b":"), re.compile(f"[{LETTER}]{{{least},}}")
    for a, b in stretches(text):
        out: Counter = Counter()
        for run, n in Counter(runs.findall(text, a, b)).items():
            h = zlib.crc32(run.encode(), start)
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += n
        yield out


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, often: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """word, n: the words of all texts that occur often enough. A batch's words are counted before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        for batch in batches:
            total: Counter = Counter()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for own in counted(doc, (text or "").encode().lower().decode(), least, drop):  # bytes: A-Z only
                    total.update(own)
                    if len(total) > STRETCH // 8:
                        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=schema)
                        total = Counter()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=schema)

    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def halves(kind: str, m: int, p: int, s: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """What the two parts of a block share: code points at the front and at the back, for edits behind the first half of
    what is not shared, and for edits in it. m: the length of the shorter word. None: nothing is left to divide."""
    k = m - p - s
    if kind == "r":
        return None if k == 1 else ((p + k // 2, s), (p, s + k - k // 2))
    half = (k + 1) // 2
    return None if k == 0 else ((p + half, s), (p, s + k - half + 1))


def named(kind: str, m: int, p: int, s: int, word: str) -> str:
    """A block's name: what its words share, in the order of the forward and of the reversed dictionary. The second half of
    the name tells blocks apart that share a text but not what they are."""
    return f"{word[:p]}\0{word[len(word) - s :][::-1] if s else ''}\0{kind}{m}"


def of_name(block: str) -> tuple[str, int, int, int]:
    front, back, own = block.split("\0")
    return own[0], int(own[1:]), len(front), len(back)


def blocks(kind: str, m: int, p: int, s: int, word: str) -> Iterator[tuple[str, bool]]:
    """The parts of a block that a word is in, each with whether it is the last."""
    for p2, s2 in halves(kind, m, p, s) or ((p, s),):
        yield named(kind, m, p2, s2, word), halves(kind, m, p2, s2) is None


def entries(word: str, least: int = 1) -> Iterator[tuple[str, bool]]:
    """The blocks that a word begins in: with its own length, and as the shorter and as the longer of two."""
    n = len(word)
    for kind, m in (("r", n), ("i", n), ("i", n - 1)):
        if m >= least:
            yield from blocks(kind, m, 0, 0, word)


def one_edit(kind: str, a: str, b: str, most: int) -> bool:
    """Whether b is a with one code point replaced (r) or put in (i) that stands, where they first differ, at `most` at most."""
    d, end = 0, len(a)
    while d < end and a[d] == b[d]:
        d += 1
    if kind == "r":
        return d < end and a[d + 1 :] == b[d + 1 :]
    return d <= most and a[d:] == b[d + 1 :]


def pairs(kind: str, m: int, p: int, s: int, own: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Pairs one edit apart among words of a block that one task holds, divided further as long as they are many."""
    parts = halves(kind, m, p, s)
    if len(own) > FEW and parts:
        for i, (p2, s2) in enumerate(parts):
            groups = defaultdict(list)
            for x in own:
                groups[x[0][p:p2] if i == 0 else x[0][len(x[0]) - s2 : len(x[0]) - s]].append(x)
            for group in groups.values():
                if len(group) > 1:
                    yield from pairs(kind, m, p2, s2, group)
        return
    if kind == "r":
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if one_edit("r", a[0], b[0], m):
                    yield *a, *b
        return
    short, long = [x for x in own if len(x[0]) == m], [x for x in own if len(x[0]) == m + 1]
    for a in short:
        for b in long:
            if one_edit("i", a[0], b[0], m - s):
                yield *a, *b


def made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def scan(block_size: int):
    """A scan of a range of the sorted dictionary: pairs of the blocks that lie in it whole and are not too large; the other
    blocks' words (the first and the last block of a range may go on in the next one) with the parts that they are in. Blocks
    that cannot be divided lie in it whole."""

    def parted(block: str, rows: list[tuple[str, int]]) -> Iterator[tuple]:
        of = of_name(block)
        for word, n in rows:
            for name, last in blocks(*of, word):
                yield name, last, word, n, None, None

    def closed(block: str, rows: list[tuple[str, int]], whole: bool) -> Iterator[tuple]:
        if whole:
            return ((None, None, *pair) for pair in pairs(*of_name(block), rows))
        return parted(block, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        block, end, held, whole = None, False, [], False
        for b in batches:
            for name, last, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != block:
                    if block is not None:
                        out += closed(block, held, whole)
                    block, end, held, whole = name, last, [], last or block is not None
                held.append((word, n))
                if len(held) > block_size and not end:
                    out += parted(block, held)
                    held, whole = [], False
                if len(out) >= 20_000:
                    yield made(out, FOUND)
                    out = []
        if block is not None:
            out += closed(block, held, end)
        if out:
            yield made(out, FOUND)

    return run


def near_words(dictionary: DataFrame, block_size: int = BLOCK, least: int = 1) -> DataFrame:
    """dictionary: word, n; words of `least` code points or more. Returns word, n, near, near_n: each pair of words one edit
    apart, once (which is first is open). Each pass sorts the words of all open blocks and cuts them into ranges, so a block
    of any size is spread over tasks; a pass halves what its blocks' words do not share, so there are about as many passes as
    the longest word's length has binary digits. Blocks that cannot be divided have no more words than there are letters, and
    are kept together."""
    spark = dictionary.sparkSession

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(*block, word, n) for word, n in zip(*(c.to_pylist() for c in b.columns), strict=True) for block in entries(word, least)]
            if rows:
                yield made(rows, ENTRY)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    now, found = written(dictionary.select("word", "n").mapInArrow(begin, _sql(ENTRY)), "variant-blocks"), []
    while True:
        ranges = now.where("not last").repartitionByRange(parts, "block", "word").sortWithinPartitions("block", "word")
        ends = now.where("last").repartition(parts, "block").sortWithinPartitions("block", "word")
        scanned = written(ranges.mapInArrow(scan(block_size), _sql(FOUND)).union(ends.mapInArrow(scan(block_size), _sql(FOUND))), "variant-pairs")
        found.append(scanned.where("block is null").select("word", "n", "near", "near_n"))
        now = scanned.where("block is not null").select("block", "last", "word", "n")
        if now.isEmpty():
            return functools.reduce(DataFrame.union, found)


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_size: int = BLOCK) -> DataFrame:
    """word, n (occurrences), n_near (words one edit apart), form (of these the most frequent, ties to the least in code-point
    order, if it is RATIO times as frequent; else null), form_n, root (the last word that forms lead to; the word itself
    without one). One row a word: a run of letters (a-z after lower-casing A-Z, and U+00C0 to U+00FF) of LEAST_LENGTH code
    points with LEAST_COUNT occurrences.

    Null and empty texts have no words; a row without id counts like any other, with an empty id in its checksum; repeated
    rows count each time. No words: no rows. Other columns are not read."""
    dictionary = written(words(docs, id_col, text_col), "variant-words")
    near = near_words(dictionary, block_size, LEAST_LENGTH)
    both = near.union(near.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    likely = -F.col("best.less") >= RATIO * F.col("n")
    known = written(dictionary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, F.col("best.near")).alias("form"), F.when(likely, -F.col("best.less")).alias("form_n")), "variant-forms")
    return known.join(roots(known.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form, without circles (a form is more frequent than its word). word, root: where the way ends. Each round
    doubles the length of the ways that are known."""
    ways = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = written(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")), "variant-roots")
        if ways.where("open").isEmpty():
            return ways.drop("open")
