"""Toxicity: noisy-channel deobfuscation by Viterbi decoding under a character language model, then a word model."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_batch, prepare, utf8, written
from tessera.llm.quality import held_out_rows, training_sample

# What a written sign may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "á": "a", "à": "a", "â": "a", "ä": "a", "é": "e", "è": "e", "ê": "e", "ë": "e", "í": "i", "ì": "i", "î": "i", "ï": "i", "ó": "o", "ò": "o", "ô": "o", "ö": "o", "ú": "u", "ù": "u", "û": "u", "ü": "u", "ç": "c", "ñ": "n"}
# Letters of other scripts that look like one of these, and signs that take no room.
CONFUSABLE = {"а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ı": "i"}
UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
LEET |= CONFUSABLE
#: Signs between the letters of a word that is spaced out; white space of any kind is a space here.
GAPS = " .-_*~/,"
GAP = re.compile(f"[{re.escape(GAPS)}]+")
LONG_GAP = re.compile(f"[\\s{re.escape(GAPS)}]{{2,}}|[^\\S ]")
#: Symbols of the language model: 0 for all that is no letter, a to z, and one for bytes beyond ASCII.
SYMBOLS, ORDER = 28, 4
CODE = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256)], np.int64)
#: Natural logarithms: what the channel charges for a sign that stands for a letter, for a repeated letter dropped, for a gap
#: dropped, and for a gap that is a boundary of words where it might be none.
COST_LEET, COST_REPEAT, COST_GAP, COST_WORD = 1.0, 0.7, 0.3, 0.2
#: Labelled documents in the training sample at most.
SAMPLE = 6000
#: A clue is so many different words of a document that begin alike, with so many letters. Each clue is in so many toxic
#: documents at least, its share of toxic documents is so many deviations over the sample's and this high, and it covers so
#: many words of toxic documents that no other clue covers.
STEM, TIMES = range(4, 13), (1, 2, 3)
LEAST_DOCS, DEVIATIONS, SHARE, LEAST_WORDS = 6, 5.0, 0.9, 6
#: Rows of one label are copies if they share their least hash of a word of so many letters, and this share of their words.
COPY_LETTERS, COPY_SHARE, SALTS = 8, 0.5, 32
PIECE = 1 << 22


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram int, n long: how often each run of ORDER symbols occurs in all texts, with ORDER - 1 boundaries between texts."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            data, starts = utf8(batch.column(0))
            whole = (data & 0xC0) != 0x80  # a character beyond ASCII is one symbol: its first byte
            starts = np.concatenate(([0], np.cumsum(whole)))[starts]
            edges = np.insert(CODE[data[whole]], np.repeat(starts, ORDER - 1), 0)  # no run goes from one text into the next
            for i in range(0, len(edges), PIECE):
                part = edges[max(0, i - ORDER + 1) : i + PIECE]
                gram = part[: len(part) - ORDER + 1].copy() if len(part) >= ORDER else part[:0]
                for k in range(1, ORDER):
                    gram = gram * SYMBOLS + part[k : len(part) - ORDER + 1 + k]
                total += np.bincount(gram, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], schema=schema)

    return docs.select(text_col).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """log P(symbol | three before), interpolated over shorter contexts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        full = np.zeros(SYMBOLS**ORDER)
        full[grams] = counts
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(1, ORDER + 1):
            c = full.reshape(-1, SYMBOLS**order).sum(0).reshape(-1, SYMBOLS)
            back = np.tile(p.reshape(-1, SYMBOLS), (SYMBOLS, 1))[: len(c)] if order > 1 else p[None, :]
            p = (c + 5 * back) / (c.sum(1, keepdims=True) + 5)
            p = p.reshape(-1)
        self.logs = np.log(p).astype(np.float32)

    def cost(self, context: int, symbol: int) -> float:
        return -float(self.logs[context * SYMBOLS + symbol])


WORD = re.compile(r"[^\W\d_]+")
NO_ROOM = dict.fromkeys(map(ord, UNSEEN))


def plain_gaps(text: str) -> str:
    """A text in lower case, without signs that take no room, each run of gaps one sign: a space if it holds white space,
    else its first. So gaps of any length read alike."""
    return LONG_GAP.sub(lambda m: m[0][0] if m[0].isascii() and not any(map(str.isspace, m[0])) else " ", text.lower().translate(NO_ROOM))


def readings(sign: str) -> list[tuple[str, float]]:
    """What a sign of a lower-cased span may be read as, with the channel's charge; an empty string drops it."""
    out = [(x, COST_LEET) for x in LEET.get(sign, "")]
    if sign.isalpha():
        out.append((sign, 0.0))
    elif sign in GAPS:
        out.append(("", COST_GAP))
    return out or [("", COST_LEET)]


def decode(span: str, model: CharModel, split: bool = False) -> str:
    """The cheapest reading of a lower-cased span as one word: Viterbi over its lattice, states the last three symbols and
    the last letter's run. A letter that repeats the one before may be kept or dropped. With split a gap may also be read
    as the boundary of two words, a space. Of readings that cost the same the first in order stays. Time and memory follow
    the span's length."""
    states: dict[tuple[int, str], tuple[float, tuple | None]] = {(0, ""): (0.0, None)}  # with the path so far, last letter first
    mod = SYMBOLS ** (ORDER - 1)
    for sign in span:
        after: dict[tuple[int, str], tuple[float, tuple | None]] = {}
        for (context, last), (cost, path) in states.items():
            for letter, charge in readings(sign) + ([(" ", COST_WORD)] if split and sign in GAPS else []):
                ways = [(letter, charge)]
                if letter and letter == last:
                    ways.append(("", COST_REPEAT))
                for kept, price in ways:
                    to, total = (context, last), cost + price
                    if kept:
                        code = ord(kept) - 96 if "a" <= kept <= "z" else 0 if kept == " " else 27
                        total += model.cost(context, code)
                        to = (context * SYMBOLS + code) % mod, kept
                    if to not in after or total < after[to][0]:
                        after[to] = total, (kept, path) if kept else path
        states = after
    _, path = min(((cost + model.cost(context, 0), path) for (context, _), (cost, path) in states.items()), key=lambda x: x[0])
    letters = []
    while path is not None:
        letter, path = path
        letters.append(letter)
    return "".join(reversed(letters))


REPEATS = re.compile(r"(.)\1+")


def single(word: str) -> str:
    """A word as the word model knows it: whether a letter was doubled or repeated cannot be told, so runs are one letter."""
    return REPEATS.sub(r"\1", word)


SUSPECT = re.compile(rf"(?<!\S)\S(?:[{re.escape(GAPS)}]\S){{2,}}(?!\S)|\S+")
ODD = re.compile(rf"[^\W\d_]*(?:[0-9@$!|+(€£]|(.)\1\1|\w[{re.escape(GAPS)}]\w|[a-z][{''.join(CONFUSABLE)}]|[{''.join(CONFUSABLE)}][a-z])")


def restored(text: str, model: CharModel, memo: dict[str, str]) -> set[str]:
    """The words of a text, obfuscated spans decoded: signs that stand for letters, letters spaced out, letters repeated."""
    low = plain_gaps(text)
    words = set(WORD.findall(low))
    for m in SUSPECT.finditer(low):
        span = m.group().strip(".,;:?\"'")
        if len(span) > 2 and ODD.match(span) or " " in span:
            if span not in memo:
                if len(memo) > 100_000:
                    memo.clear()
                memo[span] = decode(span, model)
            words.add(memo[span])
    return words


def _class(signs: set[str]) -> str:
    return "[" + "".join(re.escape(x) for x in sorted(signs)) + "]"


def lattice_pattern(stems: list[str]) -> re.Pattern | None:
    """Matches every span whose lattice holds a word that begins with a stem: each letter, or a sign that may stand for
    it, once or more, with or without a gap after any of them (one sign: see plain_gaps), no letter or digit before. It may
    match more: the decoder decides. Runs are never tried again, and of a run of equal first signs only the start counts, so time is linear."""
    if not stems:
        return None
    signs = {c: {c} | {s for s, reads in LEET.items() if c in reads} for w in stems for c in w}
    one_gap = f"[{re.escape(GAPS)}]"
    gap = one_gap + "?"
    ways = []
    for w in sorted(stems, key=lambda w: (-len(w), w)):  # the longest first: a spaced word's span ends with its stem
        runs: list[set[str]] = []
        for c in w:  # letters with a sign in common are one run
            if runs and runs[-1] & signs[c]:
                runs[-1] = runs[-1] | signs[c]
            else:
                runs.append(signs[c])
        x, marks = _class(runs[0]), {s for s in runs[0] if not s.isalnum()}
        start = f"(?<={x})(?<![\\W_]{x}{one_gap}{x})" + (f"(?<![\\W_]{_class(marks)}{x})" if marks else "")
        body = f"(?:{gap}{x})*+" + "".join(f"{gap}{y}(?:{gap}{y})*+" for y in map(_class, runs[1:-1]))
        y = _class(runs[-1])
        last = "" if not runs[1:] else gap + (f"{y}++" if len(runs[-1]) == len(signs[w[-1]]) and w[-1] != w[-2] else f"{y}(?:{gap}{y})*+")  # the next word may begin with the last letter
        ways.append(start + body + last)
    first = _class(set().union(*(signs[w[0]] for w in stems)))
    return re.compile(f"{first}(?<![^\\W_].)(?:" + "|".join(ways) + r")[^\W_]*")  # the first sign by itself lets the scan skip fast


class ToxicWords:
    """Clues (a beginning, and how many different words with it), each one's chance of a toxic document, and that of a
    document without any. Independent causes: a document is clean only if none of its clues, nor anything else, makes it
    toxic."""

    def __init__(self, chars: CharModel, clues: list[tuple[str, int]], chances: np.ndarray, base: float):
        self.chars, self.clues, self.chances, self.base = chars, clues, chances, base
        self.own = [(single(s), k) for s, k in clues]
        self.stems = {s for s, _ in self.own}
        self.sizes = sorted({len(s) for s in self.stems})
        self.pattern = lattice_pattern(sorted(self.stems))
        self.memo: dict[str, list[str]] = {}

    def __getstate__(self):
        return self.chars, self.clues, self.chances, self.base

    def __setstate__(self, state):
        self.__init__(*state)

    def known(self, word: str) -> bool:
        word = single(word)
        return any(word[:n] in self.stems for n in self.sizes)

    def found(self, text: str) -> set[str]:
        """The words with a scored beginning that the text has once its spans are decoded. Only lattices that hold such a
        word are decoded, each whole; where the decoder reads another word the search goes on inside the span."""
        out: set[str] = set()
        low = plain_gaps(text)
        m = self.pattern.search(low) if self.pattern is not None else None
        while m:
            span = m.group()
            own = self.memo.get(span)
            if own is None:
                own = [w for w in self.read(span) if self.known(w)]
                if len(span) <= 64:
                    if len(self.memo) > 100_000:
                        self.memo.clear()
                    self.memo[span] = own
            out.update(own)
            m = self.pattern.search(low, m.end() if own else m.start() + 1)
        return out

    def read(self, span: str) -> list[str]:
        """The words of a span. Where only single letters stand between gaps it is one word; else the decoder chooses."""
        pieces = GAP.split(span)
        if len(pieces) == 1:
            return [span if self.known(span) else decode(span, self.chars)]
        return decode(span, self.chars, any(len(set(x)) > 1 for x in pieces)).split()

    def marks(self, text: str | None) -> np.ndarray:
        """Which clues a text has."""
        words = {single(w) for w in self.found(text or "")}
        n = Counter(w[:i] for w in words for i in self.sizes if w[:i] in self.stems and len(w) >= i)
        return np.array([n[s] >= k for s, k in self.own], bool)

    def score(self, text: str | None) -> float:
        return float(1 - (1 - self.base) * np.prod(1 - self.chances[self.marks(text)]))


def stem_counts(words: set[str], only: set[str] | None = None) -> Counter[str]:
    """How many of the words begin with each stem, or with each of given ones."""
    return Counter(w[:n] for w in words for n in STEM if len(w) >= n and (only is None or w[:n] in only))


def clues_in(words: set[str], only: set[tuple[str, int]] | None = None) -> list[tuple[str, int]]:
    """The clues of a text with these words, or those of given ones."""
    n = stem_counts(words, None if only is None else {s for s, _ in only})
    return [(s, k) for s, c in n.items() for k in TIMES if c >= k and (only is None or (s, k) in only)]


def _cover(good: dict[tuple[str, int], float], left: list[tuple[frozenset, int]]) -> list[tuple[str, int]]:
    """Of good clues (with a fine for the clean documents that have them) one after another that which covers the most words
    that no clue before covers. left: the clues of words, and how many words have just these."""
    gain, chosen = Counter(), []
    for own, n in left:
        for c in own:
            gain[c] += n
    while gain:
        best = max(gain, key=lambda c: (gain[c] - good[c], len(c[0]), -c[1], c[0]))
        if gain[best] < LEAST_WORDS:
            break
        chosen.append(best)
        for own, n in left:
            if best in own:
                for c in own:
                    gain[c] -= n
        left, gain = [(own, n) for own, n in left if best not in own], +gain
    return sorted(chosen)


def _counted(rows: DataFrame, only: set[tuple[str, int]] | None = None) -> DataFrame:
    """stem, times, n: how many rows (words: the different words of a text) have each clue, or each of given ones."""
    schema = pa.schema([("stem", pa.string()), ("times", pa.int32()), ("n", pa.int64())])
    shared = rows.sparkSession.sparkContext.broadcast(only)

    def count(batches):
        own = shared.value
        for batch in batches:
            total: Counter = Counter()
            for words in batch.column(0).to_pylist():
                total.update(clues_in(set(words), own))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in total], pa.string()), pa.array([k for _, k in total], pa.int32()), pa.array(list(total.values()), pa.int64())], schema=schema)

    return rows.select("words").mapInArrow(count, "stem string, times int, n long").groupBy("stem", "times").agg(F.sum("n").alias("n"))


def _without_copies(rows: DataFrame) -> DataFrame:
    """Rows (l_id, y, words) without those that share COPY_SHARE of their words with the first row of their label and least
    hash. A large group of copies is dealt over SALTS tasks, each with the group's first row."""
    long = F.filter("words", lambda w: F.length(w) >= COPY_LETTERS)
    keyed = rows.withColumn("key", F.coalesce(F.array_min(F.transform(long, lambda w: F.xxhash64(w))), -F.size("words").cast("long")))
    first = keyed.groupBy("y", "key").agg(F.min("l_id").alias("f_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = written(keyed.join(F.broadcast(first), ["y", "key"], "left"), "copy-groups")  # as many ids as the sample has rows at most
    heads = marked.where("l_id = f_id").groupBy("y", "key").agg(F.first("words").alias("head")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = marked.where("l_id != f_id").withColumn("salt", F.pmod(F.xxhash64("l_id"), F.lit(SALTS)).cast("int"))
    shared = F.size(F.array_intersect("words", "head"))
    others = salted.join(heads, ["y", "key", "salt"]).where(shared < COPY_SHARE * F.greatest(F.size("words"), F.size("head")))
    return marked.where("f_id is null or l_id = f_id").select("l_id", "y", "words").unionByName(others.select("l_id", "y", "words"))


def telling_clues(rows: DataFrame) -> list[tuple[str, int]]:
    """The clues of rows l_id, y, words. Counts are made where the rows are; the driver sees clues of enough toxic rows, and
    how many words have which good ones."""
    rows = written(_without_copies(rows), "clue-rows")
    toxic, clean = rows.where("y = 1"), rows.where("y = 0")
    n_rows, n_toxic = (int(x or 0) for x in rows.agg(F.count("*"), F.sum("y")).first())
    if not 0 < n_toxic < n_rows:
        return []
    base = n_toxic / n_rows
    has = {(r["stem"], r["times"]): r["n"] for r in _counted(toxic).where(F.col("n") >= LEAST_DOCS).toLocalIterator()}
    other = {(r["stem"], r["times"]): r["n"] for r in _counted(clean, set(has)).toLocalIterator()}
    good = {}
    for c, t in has.items():
        n = t + other.get(c, 0)
        if t > SHARE * n and t - n * base > DEVIATIONS * np.sqrt(n * base * (1 - base)):
            good[c] = 10.0 * (n - t)
    if not good:
        return []
    shared = rows.sparkSession.sparkContext.broadcast(good)
    schema = pa.schema([("own", pa.list_(pa.string())), ("n", pa.int64())])

    def cover(batches):
        good = shared.value
        for batch in batches:
            total: Counter = Counter()
            for words in batch.column(0).to_pylist():
                own = set(clues_in(set(words), set(good)))
                stems = {s for s, _ in own}
                for w in words:
                    mine = frozenset(c for i in STEM if w[:i] in stems and len(w) >= i for k in TIMES if (c := (w[:i], k)) in own)
                    if mine:
                        total[mine] += 1
            yield pa.RecordBatch.from_arrays([pa.array([sorted(f"{k}{s}" for s, k in own) for own in total], schema.field(0).type), pa.array(list(total.values()), pa.int64())], schema=schema)

    found = toxic.select("words").mapInArrow(cover, "own array<string>, n long").groupBy("own").agg(F.sum("n").alias("n"))
    return _cover(good, [(frozenset((x[1:], int(x[0])) for x in r["own"]), r["n"]) for r in found.toLocalIterator()])


def _chances(sample: DataFrame, chars: CharModel, clues: list[tuple[str, int]]) -> ToxicWords:
    """Each clue's share of toxic rows among the sample's rows that have it, found as in scoring, and the share of the rest."""
    model = ToxicWords(chars, clues, np.full(len(clues), 0.5), 0.5)
    shared = sample.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("y", pa.int32()), ("marks", pa.binary())])
    rows = sample.select("y", "text").mapInArrow(by_batch(lambda b: (b.column(0), [np.packbits(shared.value.marks(x)).tobytes() for x in b.column(1).to_pylist()]), schema), "y int, marks binary")
    seen = rows.groupBy("y", "marks").count().collect()  # a row of the sample each at most, a bit a clue
    y, n = np.array([r["y"] for r in seen], float), np.array([r["count"] for r in seen], float)
    has = np.array([np.unpackbits(np.frombuffer(bytes(r["marks"]), np.uint8), count=len(clues)) for r in seen], float).reshape(len(seen), len(clues))
    chances = (has.T @ (y * n) + 0.5) / (has.T @ n + 1)
    rest = ~has.any(1)
    return ToxicWords(chars, clues, chances, float(((y * n)[rest].sum() + 0.5) / (n[rest].sum() + 1)))


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    counts = gram_counts(docs, text_col).toArrow()  # at most SYMBOLS ** ORDER rows
    if not counts.num_rows:
        return CharModel(np.zeros(0, int), np.zeros(0))
    return CharModel(np.asarray(counts.column("gram").combine_chunks()), np.asarray(counts.column("n").combine_chunks()))


def train(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> ToxicWords:
    """The character model counts all texts; the word model is fitted on a bounded sample of rows that are not held out,
    whole texts of any length."""
    prepare(docs.sparkSession)
    chars = char_model(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(chars)
    schema = pa.schema([("l_id", pa.int64()), ("y", pa.int32()), ("words", pa.list_(pa.string()))])
    memo: dict[str, str] = {}

    def make(batch: pa.RecordBatch):
        return batch.column(0), batch.column(2), [sorted(w for w in set(map(single, restored(x or "", shared.value, memo))) if STEM.start <= len(w)) for x in batch.column(1).to_pylist()]

    sample = written(training_sample(docs, labels, "toxic", ~held_out, id_col, text_col, most).withColumn("y", F.col("y").cast("int")), "toxic-sample")
    rows = sample.select("l_id", "text", "y").mapInArrow(by_batch(make, schema), "l_id long, y int, words array<string>")
    return _chances(sample, chars, telling_clues(rows))


def scorer(spark, model: ToxicWords):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for s in texts:
            yield pd.Series([own.score(x) for x in s], dtype="float64")

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 4, which: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted. One row a row of docs; whole texts are scored. Null or empty text: the score of
    a text with no telling word. Null doc_id: not held out, and no label is its own. Of repeated labels the larger counts.
    No labels: every score is 0.5. Labels, lang, source and doc_id are no inputs of a score. Other columns are not read."""
    prepare(docs.sparkSession)
    model = train(docs, labels, held_out_rows("doc_id", parts, which), id_col, text_col)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", held_out_rows("doc_id", parts, which).alias("held_out"), scorer(docs.sparkSession, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
