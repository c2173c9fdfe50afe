"""Token ids of the vocabulary files that the tokenizers library reads, by the quickest engine that gives the same ids."""

from __future__ import annotations

import json
import os

import numpy as np

# How the byte-level pre-tokenizer parts a text, and the bytes that stand for themselves in its alphabet.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Both engines are known to part texts of smaller code points alike (tests compare all of them).
KNOWN = "ɐ"


def byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary and the bytes they stand for: the rest follow from 256 on, in order."""
    others = [b for b in range(256) if b not in OWN_BYTES]
    return {chr(b): b for b in OWN_BYTES} | {chr(256 + i): b for i, b in enumerate(others)}


class Ids:
    """The library's ids without special tokens added. A plain byte-level file is also loaded as ranks; texts with a special
    string or characters beyond KNOWN go to the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.quick = self._ranks(spec)

    def _ranks(self, spec: dict):
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        if model.get("type") != "BPE" or not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        alphabet = byte_alphabet()
        special = set(self.special)
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        joined = [m.replace(" ", "", 1) if isinstance(m, str) else "".join(m) for m in model["merges"]]
        if [model["vocab"][x] for x in joined] != list(range(256, 256 + len(joined))) or len(ranks) != 256 + len(joined):
            return None
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> list[int]:
        if self.quick is not None and (text.isascii() or max(text) < KNOWN) and not any(s in text for s in self.special):
            return self.quick.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids

    def array(self, text: str) -> np.ndarray:
        return np.array(self.of(text), np.uint32)


_MADE: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One a worker and file."""
    if path not in _MADE:
        _MADE[path] = Ids(path)
    return _MADE[path]
