"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items scans every text once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_batch, prepare, row_key, texts_of, written

WINDOW = 10
#: Bytes of benchmark text in one automaton, which takes about 20 times as many and is sent to all workers. Only a benchmark
#: beyond this is scanned for in blocks, an automaton and a pass each.
BLOCK_BYTES = 1 << 25
#: Words of a stretch, and bytes of a text that are split into words at once.
STRETCH, PART = 64, 1 << 20
_BREAK = np.array([-1], np.int32)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Lower-cases A-Z and makes a space of every ASCII byte that no word has.
NORMAL = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class Automaton:
    """An Aho-Corasick automaton over word numbers, as arrays. Its trie holds each run of up to `width` words of an item;
    nodes are numbered level by level in the order of (parent, word), so the sorted edges need no targets: the node behind
    edge i is i + 1. As the trie holds every run's ends too, the node to fall back to is that of the run without its first
    word. Patterns are the windows, all on the last level, and whole items of fewer words; `shorter` leads from a node to the
    next pattern among those it falls back to. It takes 16 bytes for each different run."""

    def __init__(self, items: list[tuple[object, bytes]], width: int = WINDOW):
        self.width = width
        self.words: dict[bytes, int] = {}
        self.items = sorted({str(i) for i, _ in items})
        number, own, texts = {x: i for i, x in enumerate(self.items)}, [], []
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for part in _parts(text) for w in part]
            if ids:
                own.append(number[str(item)])
                texts.append(np.array(ids, np.int64))
        sizes = np.array([len(x) for x in texts], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.int64)
        w = np.concatenate(texts) if texts else np.zeros(0, np.int64)
        item = np.repeat(np.array(own, np.int64), sizes)
        room = np.minimum(width, np.repeat(starts + sizes, sizes) - np.arange(len(w)))
        node, edges, back = np.zeros(len(w) + 1, np.int64), [], [np.zeros(1, np.int32)]
        nodes, holds, self.levels = 1, [], [0, 1]
        for depth in range(1, width + 1):
            at = np.flatnonzero(room >= depth)
            key, one, place = np.unique(node[at] << 32 | w[at + depth - 1], return_index=True, return_inverse=True)
            back.append(node[at[one] + 1].astype(np.int32) if depth > 1 else np.zeros(len(key), np.int32))
            node = np.zeros(len(w) + 1, np.int64)
            node[at] = nodes + place
            edges.append(key)
            nodes += len(key)
            self.levels.append(nodes)
            whole = at if depth == width else starts[sizes == depth]
            holds.append(np.unique(node[whole] << 32 | item[whole]))
        self.edges, self.back = np.concatenate(edges) if edges else np.zeros(0, np.int64), np.concatenate(back)
        pairs = np.concatenate(holds) if holds else np.zeros(0, np.int64)  # in the order of nodes
        self.patterns, first = np.unique(pairs >> 32, return_index=True)
        self.first, self.held = np.append(first, len(pairs)), (pairs & 0xFFFFFFFF).astype(np.int32)
        self.shorter = None
        if (sizes < width).any():
            is_pattern = np.zeros(nodes, bool)
            is_pattern[self.patterns] = True
            self.shorter = np.zeros(nodes, np.int32)
            for a, b in zip(self.levels[1:], self.levels[2:], strict=False):
                to = self.back[a:b]
                self.shorter[a:b] = np.where(is_pattern[to], to, self.shorter[to])

    def __len__(self) -> int:
        return len(self.edges)

    def word_ids(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words, -1 for words that no item has."""
        if not isinstance(self.words, _Vocabulary):
            self.words = _Vocabulary(self.words)
        return np.concatenate([np.fromiter(map(self.words.__getitem__, part), np.int32, len(part)) for part in _parts(text)])

    def _next(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.zeros(len(state), np.int64)
        lane = np.flatnonzero(word >= 0)
        s, w = state[lane], word[lane].astype(np.int64)
        while len(lane):
            root = s == 0
            out[lane[root]] = w[root] + 1  # the first level has all words, in order
            lane, s, w = lane[~root], s[~root], w[~root]
            key = s << 32 | w
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            goes = self.edges[at] == key
            out[lane[goes]] = at[goes] + 1
            lane, w, s = lane[~goes], w[~goes], self.back[s[~goes]].astype(np.int64)
        return out

    def states(self, words: np.ndarray) -> np.ndarray:
        """The state behind each word. Stretches of STRETCH words run side by side; a state follows from the last `width` words,
        so each begins that many words earlier, less one, at the root."""
        ahead, n = self.width - 1, -(-len(words) // STRETCH)
        padded = np.full(ahead + n * STRETCH, -1, np.int32)
        padded[ahead : ahead + len(words)] = words
        begin, state = np.arange(n) * STRETCH, np.zeros(n, np.int64)
        out = np.empty((STRETCH, n), np.int32)
        for t in range(STRETCH + ahead):
            state = self._next(state, padded[begin + t])
            if t >= ahead:
                out[t - ahead] = state
        return out.T.ravel()[: len(words)]

    def hits(self, states: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first word, end, items) of each pattern that occurs."""
        ends = np.flatnonzero(np.isin(states, self.patterns) | (self.shorter[states] > 0 if self.shorter is not None else False))
        for end in ends.tolist():
            s = int(states[end])
            while s:
                i = int(np.searchsorted(self.patterns, s))
                if i < len(self.patterns) and self.patterns[i] == s:
                    depth = int(np.searchsorted(self.levels, s, "right")) - 1
                    yield end + 1 - depth, end + 1, self.held[self.first[i] : self.first[i + 1]]
                s = int(self.shorter[s]) if self.shorter is not None else 0


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, PART bytes or a little more at a time."""
    text = text.translate(NORMAL)
    a = 0
    while True:
        b = text.find(b" ", a + PART) if len(text) > a + PART else -1
        yield text[a : b if b >= 0 else len(text)].split()
        if b < 0:
            return
        a = b


def scan_all(texts: list[bytes], machine: Automaton) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Of each text the number of words, the runs of hit words (first, end) in order, and the items with a window in it."""
    words = [machine.word_ids(x) for x in texts]
    sizes = [len(x) for x in words]
    if not len(machine):
        return [(n, [], []) for n in sizes]
    line = np.concatenate([x for own in words for x in (own, _BREAK)]) if words else np.zeros(0, np.int32)
    begins = np.cumsum([0, *(n + 1 for n in sizes)])
    out = [(n, [], set()) for n in sizes]
    for first, end, items in machine.hits(machine.states(line)):
        i = int(np.searchsorted(begins, first, "right")) - 1
        out[i][1].append((first - int(begins[i]), end - int(begins[i])))
        out[i][2].update(items.tolist())
    return [(n, _merged(runs), [machine.items[i] for i in sorted(items)]) for n, runs, items in out]


def scan(text: bytes, machine: Automaton) -> tuple[int, list[tuple[int, int]], list[str]]:
    return scan_all([text], machine)[0]


def original_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes of the original text from each run's first word to its last one's end."""
    spans = [m.span() for m in WORD.finditer(text.translate(NORMAL))]
    return [(spans[a][0], spans[b - 1][1]) for a, b in runs]


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


RESULT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
RESULT_DDL = "k1 long, k2 long, doc_id long, n_words long, runs array<long>, spans array<long>, items array<string>"


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark's rows, no more than about block_bytes at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
        yield [(r["item"], r["text"].encode("utf-8", "surrogatepass")) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, runs (first and end word of each hit run, flat), spans (their first and end byte in the original
    text), items (ids as strings, sorted). One row a row of docs. Null text has no words; a null item or null item text is
    no item; an item without words never occurs; of repeated items each id counts once. Empty benchmark: no hits. Other
    columns are not read. A benchmark beyond block_bytes is scanned for block by block, each with an automaton of its own."""
    spark = prepare(docs.sparkSession)
    k1, k2 = row_key("doc_id", "text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text")
    passes = []
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(Automaton(items, width))

        def make(batch: pa.RecordBatch, shared=shared):
            texts, n, runs, spans, found = texts_of(batch.column(3)), [], [], [], []
            for text, (words, hit, which) in zip(texts, scan_all(texts, shared.value), strict=True):
                n.append(words)
                runs.append([x for run in hit for x in run])
                spans.append([x for span in original_spans(text, hit) for x in span] if hit else [])
                found.append(which)
            return batch.column(0), batch.column(1), batch.column(2), n, runs, spans, found

        passes.append(rows.mapInArrow(by_batch(make, RESULT), RESULT_DDL))
    if len(passes) == 1:
        return passes[0].drop("k1", "k2")
    kept = [written(p.where(F.size("runs") > 0) if i else p, "contamination") for i, p in enumerate(passes)]
    more = kept[1]
    for p in kept[2:]:
        more = more.union(p)

    def flat(x):
        pairs = [(int(r[i]), int(r[i + 1])) for r in x for i in range(0, len(r), 2)]
        return [v for run in _merged(pairs) for v in run]

    join_runs, join_spans = F.udf(flat, "array<long>"), F.udf(flat, "array<long>")
    by_doc = more.dropDuplicates(["k1", "k2", "runs", "items"]).groupBy("k1", "k2").agg(F.collect_list("runs").alias("r"), F.collect_list("spans").alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
    both = kept[0].join(by_doc, ["k1", "k2"], "left")
    none = F.array().cast("array<array<long>>")
    all_runs, all_spans = (F.array_append(F.coalesce(F.col(a), none), F.col(b)) for a, b in (("r", "runs"), ("s", "spans")))
    items = F.sort_array(F.array_union("items", F.coalesce("i", F.array().cast("array<string>"))))
    return both.select("doc_id", "n_words", join_runs(all_runs).alias("runs"), join_spans(all_spans).alias("spans"), items.alias("items"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, in whose text no window of an item is. No row moves; a benchmark beyond block_bytes
    takes a pass for each block. Nulls as in contamination()."""
    spark = prepare(docs.sparkSession)
    for i, items in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        hit = _hit(spark.sparkContext.broadcast(Automaton(items, width)))
        docs = (written(docs, "uncontaminated") if i else docs).where(~hit(F.col(text_col)))
    return docs


def _hit(shared):
    @F.pandas_udf("boolean")
    def hit(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([bool(runs) for _, runs, _ in scan_all([(x or "").encode("utf-8", "surrogatepass") for x in s], shared.value)], dtype="bool")

    return hit


def summary(found: DataFrame) -> DataFrame:
    """The digest of contamination(): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    length = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("runs") - 1), lambda i: F.get("runs", i) * F.when(i % 2 == 1, 1).otherwise(-1)), F.lit(0).cast("long"), lambda a, x: a + x)
    n_hit = F.when(F.size("runs") > 0, length).otherwise(F.lit(0).cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))

