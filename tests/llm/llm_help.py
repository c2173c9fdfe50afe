from __future__ import annotations


def docs_of(df, *columns) -> list[tuple]:
    return [tuple(r) for r in df.select(*columns).collect()]


def lower(text: str) -> str:
    """A-Z only."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows) -> list[tuple]:
    """Rows to compare in any order."""
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else tuple(v) if isinstance(v, list) else v for v in r) for r in rows), key=repr)
