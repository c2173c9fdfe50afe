"""Query texts as plans of phrases: strict first, then relaxed ones. This is all that happens on the driver."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from tessera.functions.text import CJK, TERM_BREAK

_CJK = re.compile("[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), CJK) + "]")
_BREAK = re.compile(TERM_BREAK)
_RUN = re.compile(r"[^\W_]+")
#: Variants of a query at most, the strict one included, and characters of a relaxed term at least.
MOST_VARIANTS, LEAST_TERM = 8, 2


@dataclass(frozen=True)
class Phrase:
    """Tokens in a row; of a prefix phrase the last one may go on."""

    tokens: tuple[str, ...]
    prefix: bool


def terms(query: str | None) -> list[str]:
    return [t for t in _BREAK.split(query or "") if t]


def index_tokens(text: str) -> list[str]:
    """What the index makes of a text: see functions.text.tokens."""
    spaced = _CJK.sub(r" \g<0> ", text.lower())
    folded = "".join(unicodedata.normalize("NFKD", c)[0] if 0xC0 <= ord(c) < 0x250 and unicodedata.normalize("NFKD", c)[0].isascii() and unicodedata.normalize("NFKD", c)[0].isalpha() else c for c in spaced)
    return _RUN.findall(folded)


def phrase(term: str, prefix: bool = True) -> Phrase:
    """A term with CJK characters is an exact phrase of what the index makes of it, any other one a prefix."""
    return Phrase(tuple(index_tokens(term)), prefix and not _CJK.search(term))


def strict(query: str | None, prefix: bool = True) -> list[Phrase]:
    """All of these must be found."""
    return [p for p in (phrase(t, prefix) for t in terms(query)) if p.tokens]


def variants(query: str | None, most: int = MOST_VARIANTS) -> list[list[Phrase]]:
    """The strict plan, then plans whose CJK terms lose their ends step by step, evenly picked if there are many, and
    whose other terms are left out. A term stays whole where too little of it would be left."""
    first = strict(query)
    own = [t for t in terms(query) if _CJK.search(t)]
    longest = max(map(len, own), default=0)
    if not first or longest < 3:
        return [first] if first else []
    lengths = list(range(longest - 1, LEAST_TERM - 1, -1))
    if len(lengths) > most - 1:
        lengths = [lengths[i * len(lengths) // (most - 1)] for i in range(most - 1)]
    out = [first]
    for n in lengths:
        cut = longest - n
        plan = [phrase(t[:-cut] if len(t) - cut >= LEAST_TERM else t) for t in own]
        if plan not in out:
            out.append(plan)
    return out
