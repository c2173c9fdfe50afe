"""Removal of repeated substrings by prefix-free parsing.

A rolling hash over K bytes sets triggers: of every window of L bytes the least hash in it (the last of equals) is the
window's trigger, so each place's trigger follows from its own L bytes alone and equal windows have theirs at equal places.
The windows of one trigger make a phrase, which overlaps the next one by the L - 1 bytes that windows need. The corpus is
then a parse, a sequence of phrase occurrences, over a dictionary of distinct phrases. Two windows can only be equal if
their phrases have the same trigger bytes, so the corpus' order splits into that of each trigger's suffixes:
- the parse puts the occurrences of a phrase side by side. As every L bytes lie in one phrase, its order behind the first
  phrase never matters: a phrase that occurs twice or more repeats with all of its windows, and a trigger that occurs once
  has nothing repeated in its phrase;
- where several phrases share a trigger, equal windows have it at one place, so the dictionary's suffixes that matter are
  those from the trigger on, and its beginnings up to the trigger read backwards. Both are put in order, with the bytes that
  neighbours share; together they tell which phrases agree in any window. Phrases of a trigger that has very many are cut
  into shorter ones, which meet only if they share the bytes that all of their windows have, twice; what is still too many
  is dealt out a row a suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dealt, prepare, row_key, texts_of, written

LENGTH, K = 200, 32
#: Distinct phrases of a trigger that are compared in one row at most, and windows of the pieces into which the phrases of
#: larger groups are cut, step by step.
TOGETHER, CUTS = 1 << 13, (24, 6)
#: Where an occurrence of a phrase is.
PLACE = ["k1", "k2", "lo"]
#: Bytes of phrases that are put in order together, about.
ORDERED = 1 << 22
#: Bytes hashed at once. A longer text goes on in the next block.
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_R = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, np.uint64(base)), dtype=np.uint64)))


_UP, _DOWN = _powers(_BASE, BLOCK + 512), _powers(pow(_BASE, -1, 1 << 64), BLOCK + 512)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on; the same for equal bytes at any place."""
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_R[data] * _UP[: len(data)], dtype=np.uint64)))
    h = (sums[k:] - sums[:-k]) * _DOWN[: len(data) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def phrases(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For a block of texts (ends[i]: where the text that holds byte i ends): first and last window start of each phrase,
    its trigger's place, and the trigger's hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    h = rolling(data, k)
    marked = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    at = (_PLACE - (least_of(marked, length - k + 1) & _PLACE)).astype(np.int64)
    starts = np.flatnonzero(ends[: len(at)] - np.arange(len(at)) >= length)
    if not len(starts):
        return none, none, none, none
    place = at[starts]
    cut = np.flatnonzero(np.diff(place)) + 1
    first, last = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))]
    where = place[np.concatenate(([0], cut))]
    return first, last, where, h[where].view(np.int64)


def blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Texts joined up to BLOCK bytes: (row, offset in its text) of each part, and the bytes. Parts of a long text overlap
    so that each window start is in one part."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for row, text in enumerate(texts):
        for a in range(0, max(1, len(text) - length + 1), BLOCK - 1024):
            part = text[a : a + BLOCK - 1024 + length - 1]
            if len(part) < length:
                continue
            if parts and size + len(part) > BLOCK:
                yield [(r, o) for r, o, _ in parts], b"".join(x for _, _, x in parts), [len(x) for _, _, x in parts]
                parts, size = [], 0
            parts.append((row, a, part))
            size += len(part)
    if parts:
        yield [(r, o) for r, o, _ in parts], b"".join(x for _, _, x in parts), [len(x) for _, _, x in parts]


PARSE = "k1 long, k2 long, lo int, hi int, at int, trigger long, phrase long"
PARSE_SCHEMA = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("trigger", pa.int64()), ("phrase", pa.int64())])


def parser(length: int, k: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            k1, k2 = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for own, joined, sizes in blocks(texts_of(batch.column(2)), length):
                ends = np.repeat(np.cumsum(sizes), sizes)
                lo, hi, at, trigger = phrases(np.frombuffer(joined, np.uint8), ends, length, k)
                if not len(lo):
                    continue
                names = np.array([digest(joined[a : b + length], p - a) for a, b, p in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
                part = np.searchsorted(np.cumsum(sizes), lo, "right")
                rows = np.array([r for r, _ in own])[part]
                shift = np.array([o for _, o in own])[part] - np.concatenate(([0], np.cumsum(sizes)))[part]
                yield pa.RecordBatch.from_arrays([pa.array(k1[rows]), pa.array(k2[rows]), pa.array((lo + shift).astype(np.int32)), pa.array((hi + shift).astype(np.int32)), pa.array((at - lo).astype(np.int32)), pa.array(trigger), pa.array(names)], schema=PARSE_SCHEMA)

    return parse


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([squeeze.compress(x) for x in texts_of(batch.column(3))], type=pa.binary())], schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("z", pa.binary())]))


PIECES = pa.schema([("trigger", pa.int64()), ("alone", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("at", pa.int32()), ("piece", pa.binary())])
PIECES_DDL = "trigger long, alone boolean, k1 long, k2 long, lo int, at int, piece binary"


def extractor(length: int):
    """The bytes of each phrase that is asked for of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for k1, k2, z, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = open_up.decompress(z)
                rows += [(x["trigger"], x["alone"], k1, k2, x["lo"], x["at"], text[x["lo"] : x["hi"] + length]) for x in own]
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[i : i + 4096], strict=True), PIECES, strict=True)], schema=PIECES)

    return run


SPANS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def in_order(parts: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The order of (group, bytes), and how many bytes each shares with the one before it; -1 at the start of a group."""
    order = np.array(sorted(range(len(parts)), key=parts.__getitem__), np.int64)
    shared = np.full(len(parts), -1, np.int64)
    width = max((len(x) for _, x in parts), default=0)
    for i in range(1, len(parts), 1 << 13):
        own = [parts[j] for j in order[i - 1 : i + (1 << 13)].tolist()]
        rows = np.frombuffer(b"".join(x.ljust(width, b"\0") for _, x in own), np.uint8).reshape(len(own), width)
        group, size = np.array([g for g, _ in own]), np.array([len(x) for _, x in own])
        differ = rows[1:] != rows[:-1]
        lcp = np.where(differ.any(1), differ.argmax(1), width) if width else np.zeros(len(own) - 1, np.int64)
        shared[i : i + (1 << 13)] = np.where(group[1:] == group[:-1], np.minimum(lcp, np.minimum(size[1:], size[:-1])), -1)
    return order, shared


def repeated_windows(groups: list[int], places: list[int], pieces: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(piece, first, last) of each run of starts in it whose `length` bytes another piece of the group has as well, at the
    same place from its own trigger's (places). The suffixes from the triggers on are put in order, and the beginnings up to
    them read backwards: two pieces share a window with a bytes before the trigger if they are neighbours for a bytes in one
    order and for the rest in the other, all between them included."""
    after = [(g, x[p : p + length]) for g, p, x in zip(groups, places, pieces, strict=True)]
    before = [(g, x[max(0, p - length) : p][::-1]) for g, p, x in zip(groups, places, pieces, strict=True)]
    (order_a, lcp_a), (order_b, lcp_b) = in_order(after), in_order(before)

    def most(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.maximum(lcp, np.append(lcp[1:], -1))
        return out

    room_a, room_b = most(order_a, lcp_a), most(order_b, lcp_b)
    live = np.flatnonzero((room_a >= 0) & (room_b >= 0) & (room_a + room_b >= length))
    if not len(live):
        return
    place_a, place_b = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
    place_a[order_a], place_b[order_b] = np.arange(len(pieces)), np.arange(len(pieces))
    size_a, size_b = np.array([len(after[i][1]) for i in live]), np.array([len(before[i][1]) for i in live])
    low, high = max(0, length - int(room_a[live].max())), min(length, int(room_b[live].max()))
    shared = np.zeros((len(live), high - low + 3), bool)
    for a in range(low, high + 1):
        has = np.flatnonzero((size_b >= a) & (size_a >= length - a))
        key = np.cumsum(lcp_b < a)[place_b[live[has]]] * len(pieces) + np.cumsum(lcp_a < length - a)[place_a[live[has]]]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        shared[has[order], a - low + 1] = np.append(False, same) | np.append(same, False)
    piece, begin = np.nonzero(shared[:, 1:] & ~shared[:, :-1])
    _, end = np.nonzero(shared[:, :-1] & ~shared[:, 1:])
    own = live[piece]
    at = np.array(places, np.int64)[own]
    yield from zip(own.tolist(), (at - low - end + 1).tolist(), (at - low - begin).tolist(), strict=True)


def classes_together(length: int):
    """Of all phrases of a trigger: the runs of window starts that share their bytes with others. Those of phrases that occur
    again in the parse are known to be repeated, and only stand for comparison. Several triggers go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, at = batch.column(0).to_pylist(), 0
            while at < len(groups):
                rows, size = [], 0
                while at < len(groups) and (not size or size < ORDERED):
                    own = {(x["k1"], x["k2"], x["lo"]): x for x in groups[at]}
                    rows += [(at, x) for x in own.values()]
                    size += sum(len(x["piece"]) for x in own.values())
                    at += 1
                found = repeated_windows([g for g, _ in rows], [x["at"] for _, x in rows], [x["piece"] for _, x in rows], length)
                out = [(x["k1"], x["k2"], x["lo"] + a, x["lo"] + b) for i, a, b in found if (x := rows[i][1])["alone"]]
                for i in range(0, len(out), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out[i : i + 8192], strict=True), SPANS, strict=True)], schema=SPANS)

    return run


def cutter(length: int, width: int):
    """Pieces of `width` windows of each phrase, named by the bytes that all of a piece's windows share. Places count from
    the trigger, which equal windows have at equal places, so equal windows are in pieces of one name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            rows = []
            for trigger, alone, k1, k2, lo, at, piece in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                n = len(piece) - length + 1
                i = 0
                while i < n:
                    begin = i - (i - at) % width  # of the whole piece: at the phrase's ends less of it is there
                    j = min(n, begin + width)
                    core = piece[begin + width - 1 : begin + length]  # is in each window of the piece
                    rows.append((digest(b"%d %d %d " % (trigger, width, begin - at) + core, 3) - (1 << 63), alone, k1, k2, lo + i, at - i, piece[i : j - 1 + length]))
                    i = j
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[i : i + 4096], strict=True), PIECES, strict=True)], schema=PIECES)

    return run


SUFFIXES = pa.schema([("trigger", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("alone", pa.bool_()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32())])


def suffix_rows(length: int):
    """A row for each suffix of each phrase, named by 128 bits of its first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for trigger, alone, k1, k2, lo, piece in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                n = len(piece) - length + 1
                names = np.frombuffer(b"".join(digest(piece[i : i + length], 1) for i in range(n)), np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, trigger, np.int64)), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array([alone] * n), pa.array(np.full(n, k1, np.int64)), pa.array(np.full(n, k2, np.int64)), pa.array(np.arange(lo, lo + n, dtype=np.int32))], schema=SUFFIXES)

    return run


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])


def cut(text: bytes, lo: list[int], hi: list[int], length: int) -> tuple[list[int], bytes]:
    """The maximal removed runs (begin and end, flat) and what is left, for windows from lo to hi."""
    if not lo:
        return [], text
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, np.array(hi) + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
    return edges.tolist(), np.frombuffer(text, np.uint8)[~gone].tobytes()


def remover(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_up = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [open_up.decompress(z) for z in batch.column(1).to_pylist()]
            done = [cut(x, lo or [], hi or [], length) for x, lo, hi in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], type=pa.int64()), pa.array([s for s, _ in done], type=pa.list_(pa.int64())), pa.array([b for _, b in done], type=pa.binary())], schema=KEPT)

    return run


def _classes(pieces: DataFrame, length: int, cuts: tuple[int, ...]) -> DataFrame:
    """k1, k2, lo, hi: runs of window starts in pieces (distinct rows) whose windows are in another piece of the trigger."""
    columns = pieces.columns
    sizes = pieces.groupBy("trigger").agg((F.count("*") <= TOGETHER).alias("few"))
    sized = pieces.join(sizes, "trigger")
    groups = sized.where("few").groupBy("trigger").agg(F.collect_list(F.struct("alone", "k1", "k2", "lo", "at", "piece")).alias("own")).select("own")
    found = groups.mapInArrow(classes_together(length), "k1 long, k2 long, lo int, hi int")
    many = sized.where("not few").select(columns)
    if not cuts:
        suffixes = many.select("trigger", "alone", "k1", "k2", "lo", "piece").mapInArrow(suffix_rows(length), "trigger long, s1 long, s2 long, alone boolean, k1 long, k2 long, at int")
        several = suffixes.groupBy("trigger", "s1", "s2").agg(F.count("*").alias("n")).where("n > 1").select("trigger", "s1", "s2")
        return found.unionByName(suffixes.where("alone").join(several, ["trigger", "s1", "s2"]).select("k1", "k2", F.col("at").alias("lo"), F.col("at").alias("hi")))
    cut_up = written(many.mapInArrow(cutter(length, cuts[0]), PIECES_DDL).withColumns({"n1": F.xxhash64("piece"), "n2": F.xxhash64(F.lit(3), "piece")}), "cut")
    equal = cut_up.groupBy("trigger", "n1", "n2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo")).alias("one"))
    marked = cut_up.join(equal, ["trigger", "n1", "n2"])
    again = marked.where("alone and n > 1").select("k1", "k2", "lo", (F.col("lo") + F.octet_length("piece") - length).alias("hi"))
    stands = (F.col("one.k1") == F.col("k1")) & (F.col("one.k2") == F.col("k2")) & (F.col("one.lo") == F.col("lo"))
    distinct = marked.where(stands).withColumn("alone", F.expr("alone and n = 1")).select(columns)
    return found.unionByName(again).unionByName(_classes(distinct, length, cuts[1:]))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (begin and end of each maximal removed run, flat), kept (the bytes that are left). One row a
    row of docs. Removed: each byte that some `length`-byte string covers which also starts anywhere else, in the same text
    or another; strings that overlap count, and the input decides, not what is left. Null text: empty; a text shorter than
    `length` keeps all; a repeated row is another text, so both lose all; null doc_id stays null. Empty docs: no rows. Other
    columns are not read."""
    prepare(docs.sparkSession)
    k = min(K, max(1, length // 4))
    k1, k2 = row_key("doc_id", "text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text")
    parse = rows.where(F.octet_length("text") >= length).select("k1", "k2", "text").mapInArrow(parser(length, k), PARSE)
    triggers = parse.groupBy("trigger").agg(F.count("*").alias("n"), F.min("phrase").alias("a"), F.max("phrase").alias("b")).where("n > 1")
    shared = written(triggers.select("trigger", "n", (F.col("a") == F.col("b")).alias("same")), "triggers")
    again = written(dealt(parse, shared, ["trigger"], PLACE), "parse")  # little of the parse: triggers that occur again
    mixed = again.where("not same").drop("same")
    dictionary = written(mixed.groupBy("trigger", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "lo", "hi", "at")).alias("one")).withColumn("alone", F.col("n") == 1), "dictionary")
    repeated = dealt(mixed, dictionary.where("not alone").select("trigger", "phrase", "n"), ["trigger", "phrase"], PLACE)
    whole = again.where("same").select("k1", "k2", "lo", "hi").unionByName(repeated.select("k1", "k2", "lo", "hi"))
    asked = dictionary.groupBy("one.k1", "one.k2").agg(F.collect_list(F.struct("one.lo", "one.hi", "one.at", "trigger", "alone")).alias("own"))
    text = rows.mapInArrow(packed, "k1 long, k2 long, doc_id long, z binary")
    pieces = text.join(asked, ["k1", "k2"]).select("k1", "k2", "z", "own").dropDuplicates(["k1", "k2"]).mapInArrow(extractor(length), PIECES_DDL)
    single = _classes(written(pieces, "pieces"), length, CUTS)
    gone = whole.unionByName(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("own")).select("k1", "k2", F.col("own.lo").alias("lo"), F.col("own.hi").alias("hi"))
    return text.join(gone, ["k1", "k2"], "left").select("doc_id", "z", "lo", "hi").mapInArrow(remover(length), "doc_id long, n_bytes long, spans array<long>, kept binary")
