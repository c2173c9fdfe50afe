"""Token counts by a finite-state transducer compiled from a piece vocabulary.

A BPE encoding is fixed by its adjacent pairs: a sequence of pieces is the encoding of a text exactly if every two
neighbours encode to themselves. So the last piece of every prefix follows from the last pieces of shorter prefixes, no
further back than the longest piece start that the prefix ends with. That gives a deterministic transducer: a state holds
this piece start and the last pieces and relative counts at the places in it; a transition on one character carries the
change of the token count. States are made when first reached and kept in one table.

Every text is cut into chunks of CHUNK characters. A chunk's map takes the state before it to the state behind it and a count.
A space that starts a piece, and a character outside the alphabet, puts the machine into one state from wherever it was, so
behind the first of them the map is a constant, and before it the map is this head's. All chunks of a batch run side by
side, one character a step: first the constant parts, from the state "not known yet"; then, as the scan composes each map
with its neighbour's, the heads, from the state that the chunk before ends in. Only a chunk without such a place has no
constant part; its map is evaluated at the state that the scan brings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_batch, prepare

SPACE = "▁"
#: Entries of a worker's caches and states of its table. When full, they start anew.
MOST_WORDS, MOST_STATES = 100_000, 200_000
#: Characters of a chunk, and of texts that run at once at least; a longer text goes on behind the next boundary.
CHUNK, BLOCK = 192, 1 << 20
#: Columns of the table: what puts the machine back to its start, a space that starts a piece, all characters without a
#: column of their own, and then the characters of the best-scored pieces.
BACK, PIECE, OTHER, COLUMNS = 0, 1, 2, 128
#: An entry is the next state times SHIFT and the change of the count plus half of it.
SHIFT = 256
#: The machine's start, and the state that is not known yet.
START, UNKNOWN = 0, 1
BOUNDARY = re.compile(f"\n|(?<=[^ {SPACE}\n])[ {SPACE}]")


class Transducer:
    def __init__(self, model_path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lib = self.library
        ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in ids}
        self.starts = {p[:k] for p in self.score for k in range(1, len(p))}
        self.alphabet = {c for p in self.score for c in p}
        # A piece with a space further in, a character that is no piece, or another normaliser need more than this machine.
        self.plain = all(c in self.score for c in self.alphabet) and not any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) and p.strip(SPACE) for p in self.score) and lib.normalize(" a  b\t　ﬁ") == f"{SPACE}{SPACE}a{SPACE}{SPACE}b\t　ﬁ" and "\n" not in self.alphabet
        self.pairs: dict[tuple[str, str], bool] = {}
        self.columns = sorted(self.alphabet - {SPACE}, key=lambda c: (-self.score.get(c, -1e9), c))[: COLUMNS - OTHER - 1]
        self.column = np.zeros(0x110000, np.uint8)  # by code point; others put the machine back
        self.column[[ord(c) for c in self.alphabet]] = OTHER
        self.column[[ord(c) for c in self.columns]] = np.arange(OTHER + 1, OTHER + 1 + len(self.columns))
        self.spaced: dict[str, int] = {}
        self._restart()

    def _restart(self) -> None:
        self.space = -1
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.table = np.full((1 << 10, COLUMNS), -1, np.int32)
        self._state(("", (None,), (0,)))
        self._state(("not known", (), ()))
        self.table[UNKNOWN] = UNKNOWN * SHIFT + SHIFT // 2
        self.table[UNKNOWN, BACK] = START * SHIFT + SHIFT // 2
        at, change = self._step(START, SPACE)
        self.space = at * SHIFT + change + SHIFT // 2
        self.table[: len(self.states), PIECE] = self.space

    def _state(self, state: tuple) -> int:
        at = self.ids.setdefault(state, len(self.states))
        if at == len(self.states):
            self.states.append(state)
            self.next.append({})
            if at == len(self.table):
                self.table = np.concatenate((self.table, np.full(self.table.shape, -1, np.int32)))
            self.table[at, BACK] = START * SHIFT + SHIFT // 2
            self.table[at, PIECE] = self.space
        return at

    def _encode(self, text: str) -> list[str]:
        """BPE of a short text by its definition: the best-scored pair is joined first, the left one of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _pair(self, left: str | None, right: str) -> bool:
        key = (left or "", right)
        if key not in self.pairs:
            if len(self.pairs) > MOST_WORDS:
                self.pairs.clear()
            self.pairs[key] = self._encode(key[0] + right) == ([left, right] if left else [right])
        return self.pairs[key]

    def _step(self, at: int, c: str) -> tuple[int, int]:
        start, lasts, counts = self.states[at]
        text = start + c
        for k in range(len(text)):  # the piece that ends here begins at place k of text
            piece = text[k:]
            if piece in self.score and self._pair(lasts[k], piece):
                break
        else:
            raise ValueError(f"no piece ends at {text!r}")
        count = counts[k] + 1
        drop = next(i for i in range(len(text) + 1) if i == len(text) or text[i:] in self.starts)
        # only places from which a longer piece may start tell states apart
        live = [i == len(text) or text[i:] in self.starts for i in range(drop, len(text) + 1)]
        lasts, counts = (*lasts, piece)[drop:], (*counts, count)[drop:]
        made = self._state((text[drop:], tuple(x if y else "" for x, y in zip(lasts, live, strict=True)), tuple(x - count if y else 0 for x, y in zip(counts, live, strict=True)))), count - self.states[at][2][-1]
        self.next[at][c] = made
        return made

    def _entry(self, at: int, c: str) -> int:
        """The table's entry, made if it is not there."""
        to, change = self.next[at].get(c) or self._step(at, c)
        entry = to * SHIFT + change + SHIFT // 2
        if (own := self.column[ord(c)]) > OTHER:
            self.table[at, own] = entry
        return entry

    def run(self, at: int, text: str) -> tuple[int, int]:
        """The state behind a text of alphabet characters that follow one another within a word, and the tokens more."""
        n = 0
        known = self.next
        for c in text:
            try:
                at, change = known[at][c]
            except KeyError:
                at, change = self._step(at, c)
            n += change
        return at, n

    def _advance(self, state: np.ndarray, columns: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One character of each lane: the states behind, and the changes of the counts."""
        entry = self.table.ravel().take(state * COLUMNS + columns)
        if entry.min() < 0:
            missing = np.flatnonzero(entry < 0)
            asked, lane = np.unique(state[missing].astype(np.int64) << 21 | codes[missing], return_inverse=True)
            made = [self._entry(x >> 21, chr(x & 0x1FFFFF)) for x in asked.tolist()]
            entry[missing] = np.array(made, np.int32)[lane]
        return entry // SHIFT, entry % SHIFT - SHIFT // 2

    def _scan(self, columns: np.ndarray, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens of each chunk: a row of columns and codes a place, a column a chunk; first: chunks that begin a text."""
        places, n = columns.shape
        state, tokens = np.full(n, UNKNOWN, np.int32), np.zeros(n, np.int64)
        for t in range(places):  # the constant parts
            state, change = self._advance(state, columns[t], codes[t])
            tokens += change
        fixed = columns <= PIECE
        head = np.where(fixed.any(0), fixed.argmax(0), places)
        begun = np.flatnonzero(first | (np.append(UNKNOWN, state[:-1]) != UNKNOWN))  # the state before is known
        at, lanes = np.where(first[begun], START, np.append(START, state[:-1])[begun]).astype(np.int32), begun
        for t in range(places):  # their heads, from the state that the chunk before ends in
            on = t < head[lanes]
            lanes, at = lanes[on], at[on]
            if not len(lanes):
                break
            at, change = self._advance(at, columns[t, lanes], codes[t, lanes])
            tokens[lanes] += change
        state[lanes] = np.where(head[lanes] == places, at, state[lanes])
        done = np.zeros(n, bool)
        done[begun] = True
        for i in np.flatnonzero(~done):  # behind chunks without a constant part, one after another
            at, more = self.run(int(state[i - 1]), "".join(map(chr, codes[: head[i], i].tolist())))
            tokens[i] += more
            if head[i] == places:
                state[i] = at
        return tokens

    def _pieces(self, texts: list[str]) -> Iterator[list[tuple[int, str]]]:
        """(text, part of it) whose characters are about BLOCK; a part begins where the machine is at its start."""
        own: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            text = f" {text}" if text else ""  # the library's own first space
            a = 0
            while a < len(text):
                m = BOUNDARY.search(text, a + BLOCK) if len(text) - a > BLOCK else None
                b = len(text) if m is None else m.end() if m.group() == "\n" else m.start()
                own.append((i, text[a:b]))
                size += b - a
                a = b
                if size >= BLOCK:
                    yield own
                    own, size = [], 0
        if own:
            yield own

    def _spaces(self, text: str, spaces: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Begin, end and tokens of the parts with several spaces in a row, up to the next space behind another character or
        a text's or line's end: their pieces have equal scores, so the library's order of them decides."""
        after = np.append(spaces[1:], False)
        begins = spaces & ~np.append(False, spaces[:-1])
        begins[ends[:-1]] |= spaces[ends[:-1]]
        after[ends[1:] - 1] = False
        several = np.flatnonzero(begins & after)
        stops = np.union1d(np.flatnonzero(begins), ends)
        found, until = [], []
        for a, b in zip(several.tolist(), stops[np.searchsorted(stops, several, "right")].tolist(), strict=True):
            part = text[a:b].partition("\n")[0]
            n = self.spaced.get(part)
            if n is None:
                n = len(self.library.encode(part[1:].replace(SPACE, " ")))
                if len(part) <= 64:
                    if len(self.spaced) >= MOST_WORDS:
                        self.spaced.clear()
                    self.spaced[part] = n
            found.append(n)
            until.append(a + len(part))
        return several, np.array(until, np.int64), found

    def counts(self, texts: list[str]) -> np.ndarray:
        """The tokens of whole texts, as the library gives them without begin or end."""
        out = np.zeros(len(texts), np.int64)
        if not self.plain:
            out[:] = [len(self.library.encode(x)) for x in texts]
            return out
        for own in self._pieces(texts):
            if len(self.states) > MOST_STATES:
                self._restart()
            joined = "".join(x for _, x in own)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.int32)
            sizes = np.array([len(x) for _, x in own])
            ends = np.concatenate(([0], np.cumsum(sizes)))
            columns = self.column[codes]
            spaces = (codes == 32) | (codes == ord(SPACE))
            tokens = np.where((columns == BACK) & ~spaces, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), 0).astype(np.int64)
            columns[spaces] = PIECE
            begin, end, found = self._spaces(joined, spaces, ends)
            if len(begin):
                step = np.zeros(len(codes) + 1, np.int32)
                step[begin] += 1
                np.subtract.at(step, end, 1)
                inside = np.cumsum(step[:-1]) > 0
                columns[inside], tokens[inside] = BACK, 0
                tokens[begin] = found
            n = -(-sizes // CHUNK)
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            piece = np.repeat(np.arange(len(own)), n)
            start = ends[piece] + (np.arange(len(piece)) - first[piece]) * CHUNK
            place = start[:, None] + np.arange(CHUNK)
            beyond = place >= ends[piece + 1][:, None]
            place[beyond] = 0
            lanes = columns[place]
            lanes[beyond] = BACK
            begins = np.zeros(len(piece), bool)
            begins[first] = True
            total = np.add.reduceat(tokens, ends[:-1]) + np.add.reduceat(self._scan(np.ascontiguousarray(lanes.T).astype(np.int32), np.ascontiguousarray(codes[place].T), begins), first)
            np.add.at(out, [i for i, _ in own], total)
        return out

    def count(self, text: str) -> int:
        return int(self.counts([text])[0])


_MADE: dict[str, Transducer] = {}


def transducer(model_path: str) -> Transducer:
    """One a worker and file."""
    if model_path not in _MADE:
        _MADE[model_path] = Transducer(model_path)
    return _MADE[model_path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). One row a row of docs. Null text is empty: no bytes, no
    tokens; a null doc_id stays null; repeated rows and ties need nothing. Other columns are not read. model_path is a file
    on every machine (a parameter; the vocabulary is not shipped)."""
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def make(batch: pa.RecordBatch):
        return batch.column(0), batch.column(2), transducer(model_path).counts([x or "" for x in batch.column(1).to_pylist()])

    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(by_batch(make, schema), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
