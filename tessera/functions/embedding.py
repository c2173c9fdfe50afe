"""Embeddings: vectors' arithmetic by expressions, the hashing embedder by a pandas UDF, other backends by registration."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import _col


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product over the common length, summed as doubles in order."""
    a, b = _col(a), _col(b)
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column | str) -> Column:
    """Unit length; a vector of no length stays."""
    a, n = _col(a), norm(a)
    return F.when(n <= 1e-12, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def rounded(c: Column | str, digits: int) -> Column:
    """A double at so many digits as C rounds it: the scaled value, half away from zero; the sign of a zero stays."""
    x = _col(c)
    return F.round(F.abs(x) * F.lit(10.0**digits)) / F.lit(10.0**digits) * F.signum(x)


def pack_vector(vector: list[float]) -> bytes:
    """32-bit floats, little-endian."""
    return struct.pack(f"<{len(vector)}f", *vector)


def unpack_vector(blob: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(blob) // 4}f", blob))


_LATIN, _HAN = re.compile("[A-Za-z0-9]+"), re.compile("[㐀-䶿一-鿿]")


def features(text: str | None) -> Counter[str]:
    """Latin words and Han characters, and pairs of neighbours of either, with their counts."""
    plain = unicodedata.normalize("NFKC", text or "").lower()
    out: Counter[str] = Counter()
    for found, glue in ((_LATIN.findall(plain), "_"), (_HAN.findall(plain), "")):
        out.update(found)
        out.update(map(glue.join, zip(found, found[1:], strict=False)))
    return out


@lru_cache(1 << 17)
def _number(feature: str) -> int:
    """A feature's hash; those that a worker has seen of late are not made again."""
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")


def hashed(text: str | None, dimension: int) -> list[float]:
    """Signed feature hashing with log counts, of unit length."""
    sums = [0.0] * dimension
    for feature, count in features(text).items():
        h = _number(feature)
        gain = 1 + math.log(count) if count > 1 else 1.0
        sums[h % dimension] += gain if h >> 63 else -gain
    vector = np.array(sums)
    length = math.sqrt(float(vector @ vector))
    return (vector / length if length > 1e-12 else vector).tolist()


@dataclass(frozen=True)
class Backend:
    """What an embedder needs to be used: its function over batches of texts, its dimension, and the score below which a
    hit is not one."""

    name: str
    embed: Callable[[list[str]], list[list[float]]]
    dimension: int
    least_score: float = 0.0


def hashing(dimension: int = 512) -> Backend:
    own = max(64, dimension)
    return Backend("hashing", lambda texts: [hashed(t, own) for t in texts], own, 0.25)


BACKENDS: dict[str, Callable[..., Backend]] = {"hashing": hashing}


def register(name: str, make: Callable[..., Backend]) -> None:
    """Adds a backend (an ONNX session, an HTTP service), made on the driver and shipped with the UDF."""
    BACKENDS[name] = make


def backend(name: str = "auto", **options) -> Backend:
    """A backend by name; auto takes the first registered one that can be made, hashing at last."""
    if name != "auto":
        return BACKENDS[name](**options)
    for key in [*(k for k in BACKENDS if k != "hashing"), "hashing"]:
        try:
            return BACKENDS[key](**options)
        except (ImportError, OSError):
            continue
    raise LookupError("no backend")


def embedder(own: Backend):
    """A backend as a UDF that gets batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(own.embed(["" if x is None else x for x in s]))

    return run


def embed_missing(c: Column | str, known: Column | str, own: Backend) -> Column:
    """embed(c) where known is false, null elsewhere: the backend does not see those texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, done in batches:
            made = iter(own.embed(["" if x is None else x for x in texts[~done]]) if not done.all() else ())
            yield pd.Series([None if d else next(made) for d in done], dtype=object)

    return run(c, known)


def embed(c: Column | str, own: Backend) -> Column:
    """array<float> of unit length for each text; a null is an empty text."""
    return embedder(own)(c)


def embedding_text(subject: Column | str, text: Column | str, placeholder: str = "(无主题)") -> Column:
    """The subject on a line of its own before the text, unless it is missing."""
    s = F.coalesce(_col(subject), F.lit(""))
    return F.when((s != "") & (s != placeholder), F.concat(s, F.lit("\n"), _col(text))).otherwise(_col(text))
