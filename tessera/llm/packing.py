"""Packing into sequences of a fixed length: shallow combinations of lengths by non-negative least squares, then a greedy
fill. Only the histogram of lengths, which has one bin a length, reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import ids_of
from tessera.llm.common import prepare, written

SIZE, END = 2048, 1
#: Steps of the solver at most, and the relative change of the residual at which it has settled.
STEPS, SETTLED = 2000, 1e-4


def combinations(histogram: np.ndarray) -> np.ndarray:
    """Rows of two or three lengths (0: none) that fill a window: all of them whose lengths occur, whatever the data's size
    at most a twelfth of the window's square."""
    size = len(histogram)  # lengths below size, which is the window
    there = np.append(histogram > 0, False)
    lengths = np.flatnonzero(there)
    a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    c = size - a - b
    own = (a <= b) & ((c == 0) | (c >= b))
    a, b, c = a[own], b[own], c[own]
    fits = (c == 0) | there[c]
    return np.stack((a, b, c), 1)[fits].astype(np.int64)


def solve(ways: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """How often to use each combination: min |A x - histogram|, x >= 0, by an accelerated projected gradient that starts
    anew where it overshoots."""
    n, size = len(ways), len(histogram)
    goal = histogram.astype(float)
    goal[0] = 0

    def used(x: np.ndarray) -> np.ndarray:
        out = np.bincount(ways.ravel(), np.repeat(x, 3), minlength=size)
        out[0] = 0
        return out

    v = np.random.default_rng(0).random(n)
    for _ in range(20):  # the largest eigenvalue, by power iteration
        v = used(v / np.linalg.norm(v))[ways].sum(1)
    rate = 1 / (1.05 * np.linalg.norm(v))
    x, y, t, last = np.zeros(n), np.zeros(n), 1.0, np.inf
    for _ in range(STEPS):
        r = used(y) - goal
        after = np.maximum(0, y - rate * r[ways].sum(1))
        now = float(np.linalg.norm(used(after) - goal))
        if now > last:
            y, t, last = x, 1.0, np.inf
            continue
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = after + (t - 1) / t1 * (after - x), after, t1
        if last - now <= SETTLED * last and last < np.inf:
            break
        last = now
    return x


@dataclass
class Plan:
    """Where each document's rest goes, by its length and its rank among rests of that length. For a length, ranks from
    `first` on (one entry a slot of a combination) go to sequences from `sequence` on, at `offset`; ranks from left[length]
    on follow one another in the stream that starts for this length at stream[length]."""

    size: int
    first: dict[int, np.ndarray] = field(default_factory=dict)
    sequence: dict[int, np.ndarray] = field(default_factory=dict)
    offset: dict[int, np.ndarray] = field(default_factory=dict)
    left: np.ndarray | None = None
    stream: np.ndarray | None = None
    #: Where the stream's sequences begin after the last full one (with the stream's end), and ids in use before them.
    tail: np.ndarray | None = None
    combined: int = 0
    full: int = 0

    @property
    def sequences(self) -> int:
        return self.combined + self.full + len(self.tail) - 1

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, offset) of a rest's pieces."""
        if not length:
            return []
        if rank < self.left[length]:
            i = int(np.searchsorted(self.first[length], rank, "right")) - 1
            return [(0, length, int(self.sequence[length][i]) + rank - int(self.first[length][i]), int(self.offset[length][i]))]
        begin = int(self.stream[length]) + (rank - int(self.left[length])) * length
        out, at, end = [], begin, begin + length
        while at < end:
            if at < self.full * self.size:
                k = at // self.size
                low, high = k * self.size, (k + 1) * self.size
            else:
                k = int(np.searchsorted(self.tail, at, "right")) - 1
                low, high, k = int(self.tail[k]), int(self.tail[k + 1]), k + self.full
            stop = min(end, high)
            out.append((at - begin, stop - at, self.combined + k, at - low))
            at = stop
        return out


def plan(histogram: np.ndarray) -> Plan:
    """histogram[l]: rests of l tokens, for l below the window. Rounded counts never use more rests than there are."""
    size = len(histogram)
    free = histogram.astype(np.int64).copy()
    free[0] = 0
    out = Plan(size)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    ways = combinations(free)
    used = np.zeros(size, np.int64)
    sequence = 0
    if len(ways):
        x = solve(ways, free)
        order = np.argsort(-x, kind="stable")
        whole = np.diff(np.floor(np.concatenate(([0.0], np.cumsum(x[order]))) + 0.5)).astype(np.int64)  # rounded so that sums stay
        for i, times in zip(order[whole > 0].tolist(), whole[whole > 0].tolist(), strict=True):
            lengths = [int(v) for v in ways[i] if v]
            for v in set(lengths):
                times = min(times, int(free[v] - used[v]) // lengths.count(v))
            if times <= 0:
                continue
            at = 0
            for v in lengths:
                slots.setdefault(v, []).append((int(used[v]), sequence, at))
                used[v] += times
                at += v
            sequence += times
    for v, s in slots.items():
        out.first[v], out.sequence[v], out.offset[v] = (np.array(c, np.int64) for c in zip(*s, strict=True))
    rest = (free - used) * np.arange(size)
    out.left, out.stream, out.combined = used, np.concatenate(([0], np.cumsum(rest)[:-1])), sequence
    total = int(rest.sum())
    out.full = total // size
    edges = [out.full * size]
    for bit in range(size.bit_length(), -1, -1):  # the last tokens go to sequences of powers of two, which need no padding
        if (total - out.full * size) >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    out.tail = np.array(edges, np.int64)
    return out


TOKENS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("rest", pa.int32()), ("rank", pa.int64()), ("windows", pa.int64()), ("z", pa.binary())])


def tokenised(path: str, size: int, end: int):
    """Rows with each document's ids squeezed, its rest's rank within this task's rests of that length, and the full
    windows of this task's rows before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, squeeze, part = ids_of(path), zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId()
        ranks, windows = np.zeros(size, np.int64), 0
        for batch in batches:
            n, rest, rank, before, z = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.append(tokens.array(text) if text else np.zeros(0, np.uint32), np.uint32(end)).astype(np.uint32)
                r = len(ids) % size
                n.append(len(ids))
                rest.append(r)
                rank.append(int(ranks[r]))
                before.append(windows)
                ranks[r] += 1
                windows += len(ids) // size
                z.append(squeeze.compress((ids.astype("<u2") if ids.max() < 1 << 16 else ids.astype("<u4")).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) if not isinstance(x, pa.Array) else x for x, f in zip((batch.column(0), [part] * len(n), n, rest, rank, before, z), TOKENS, strict=True)], schema=TOKENS)

    return run


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id, offset. Every id
    of every document (its tokens, then `end`) is in exactly one piece; sequences hold `size` ids, and the last ones a power
    of two, so nothing is padded. Null or empty text: the one id `end`. Null doc_id stays null; repeated rows are packed
    each. Empty docs: no rows. Other columns are not read. tokenizer_path is a file on every machine."""
    spark = prepare(docs.sparkSession)
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokenised(tokenizer_path, size, end), "doc_id long, part int, n long, rest int, rank long, windows long, z binary")
    tokens = written(made, "tokens")
    counts = tokens.where("rest > 0").groupBy("rest", "part").agg(F.count("*").alias("c"))
    histogram = np.zeros(size, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("c").alias("c")).collect():  # at most `size` rows
        histogram[r["rest"]] = r["c"]
    shared = spark.sparkContext.broadcast(plan(histogram))
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("rest", "part", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"))
    ranked = tokens.join(base, ["rest", "part"], "left").select("doc_id", "part", "n", "rest", (F.col("rank") + F.coalesce("base", F.lit(0))).alias("rank"), "windows", "z")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, open_up = shared.value, zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc, part, n, rest, rank, windows, z in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                raw = open_up.decompress(z)
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                at = n - rest
                first = own.sequences + (part << 40) + windows
                cuts = [(k * size, size, first + k, 0) for k in range(n // size)] + [(at + s, length, q, o) for s, length, q, o in own.pieces(rest, rank)]
                out += [(doc, s, length, ids[4 * s : 4 * (s + length)], n, q, o) for s, length, q, o in cuts]
            for i in range(0, len(out), 2048):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out[i : i + 2048], strict=True), PIECES, strict=True)], schema=PIECES)

    return ranked.mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
