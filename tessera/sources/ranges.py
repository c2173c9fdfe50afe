"""Large message files read by the places of their parts: a scan of bounded memory finds the parts, then only some are read."""

from __future__ import annotations

from dataclasses import dataclass
from email.message import Message
from email.parser import BytesHeaderParser
from typing import BinaryIO

#: Bytes of a line, and of a header, that are looked at; text parts of a message that are fetched.
LINE, MOST_HEADER, MOST_TEXTS = 1 << 16, 1 << 20, 4


@dataclass
class Part:
    """A leaf of a message: its header, and where it and its body lie in the file."""

    section: str
    header: Message
    head: int
    begin: int
    end: int = 0

    @property
    def kind(self) -> str:
        return self.header.get_content_type().lower()

    @property
    def disposition(self) -> str:
        return (self.header.get_content_disposition() or "").lower()

    def is_text(self) -> bool:
        from tessera.functions.mime import part_name

        return self.kind.startswith("text/") and self.disposition != "attachment" and not part_name(self.header)


def parts_of(f: BinaryIO) -> list[Part]:
    """The leaf parts of a message file, in order. Lines are read in pieces, bodies not kept; a part without its closing
    boundary ends with the file. What a forwarded message holds stays inside it."""
    out: list[Part] = []
    open_parts: list[list] = []  # boundary, section, children so far
    section, head, lines, kept = "", 0, [], 0
    leaf: Part | None = None
    state, at, fresh = "header", 0, True

    def close(end: int) -> None:
        nonlocal leaf
        if leaf is not None:
            leaf.end = max(leaf.begin, end)
            out.append(leaf)
            leaf = None

    before = 0  # bytes of the line end before this line
    while line := f.readline(LINE):
        marked = fresh and line.startswith(b"--") and next(((i, line.rstrip() == b"--" + b[0] + b"--") for i, b in reversed(list(enumerate(open_parts))) if line.rstrip() in (b"--" + b[0], b"--" + b[0] + b"--")), None)
        if marked:
            i, last = marked
            close(at - before)
            del open_parts[i + 1 :]
            if last:
                open_parts.pop()
                state = "between"
            else:
                open_parts[i][2] += 1
                section = f"{open_parts[i][1]}.{open_parts[i][2]}".lstrip(".")
                state, head, lines, kept = "header", at + len(line), [], 0
        elif state == "header":
            if fresh and not line.strip(b"\r\n"):
                header = BytesHeaderParser().parsebytes(b"".join(lines) + b"\r\n")
                boundary = header.get_boundary()
                if header.get_content_maintype() == "multipart" and boundary:
                    open_parts.append([boundary.encode("utf-8", "surrogateescape"), section, 0])
                    state = "between"
                else:
                    leaf, state = Part(section or "1", header, head, at + len(line)), "body"
            elif kept < MOST_HEADER:
                lines.append(line)
                kept += len(line)
        fresh = line.endswith(b"\n")
        before = 2 if line.endswith(b"\r\n") else 1 if fresh else 0
        at += len(line)
    if state == "header" and lines:
        leaf = Part(section or "1", BytesHeaderParser().parsebytes(b"".join(lines)), head, at)
    close(at)
    return out


def header_of(path: str) -> bytes:
    """A message's header, read line by line up to the first empty one."""
    out, size = [], 0
    with open(path, "rb") as f:
        while (line := f.readline(LINE)).strip(b"\r\n") and size < MOST_HEADER:
            out.append(line)
            size += len(line)
    return b"".join(out) + b"\r\n"


def _row(part: Part) -> dict:
    from tessera.functions.mime import part_name

    return {"section": part.section, "content_type": part.kind, "encoding": (part.header.get("Content-Transfer-Encoding") or "7bit").strip().upper(), "size": part.end - part.begin, "lines": 0, "filename": part_name(part.header) or "", "disposition": part.disposition}


def fetched(path: str, most: int | None) -> tuple[bytes, list[dict] | None]:
    """A whole message; or, with most given, its header and the first text parts of so many bytes at most as a message of
    their own, and all its parts. A range of the file is read for each; the rest stays where it is."""
    with open(path, "rb") as f:
        if most is None:
            return f.read(), None
        parts = parts_of(f)
        texts = [p for p in parts if p.is_text() and p.end - p.begin <= most][:MOST_TEXTS]
        mark = b"=_parts"
        own = [line for line in _folded(header_of(path)) if not line.lower().startswith((b"content-type:", b"content-transfer-encoding:", b"content-disposition:", b"mime-version:"))]
        out = [*own, b"MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=\"" + mark + b"\"\r\n\r\n"]
        while any(mark in p for p in (f.seek(t.begin) and f.read(t.end - t.begin) or b"" for t in texts)):
            mark += b"_"
            out[-1] = b"MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=\"" + mark + b"\"\r\n\r\n"
        for t in texts:
            f.seek(t.begin)
            names = ("content-type", "content-transfer-encoding", "content-disposition")
            head = b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogateescape") for k, v in t.header.items() if k.lower() in names)
            out += [b"--" + mark + b"\r\n" + head + b"\r\n", f.read(t.end - t.begin), b"\r\n"]
        return b"".join([*out, b"--" + mark + b"--\r\n"]), [_row(p) for p in parts]


def _folded(header: bytes) -> list[bytes]:
    """A header's fields, each with the lines that it goes on in."""
    out: list[bytes] = []
    for line in header.rstrip(b"\r\n").splitlines(keepends=True):
        if line[:1] in (b" ", b"\t") and out:
            out[-1] += line
        else:
            out.append(line)
    if out and not out[-1].endswith(b"\n"):
        out[-1] += b"\r\n"
    return out
