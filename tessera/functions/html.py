"""HTML by its tree: cleaning, Markdown and text. A tree cannot be had from expressions, so these are pandas UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that go with all they hold, styles that hide, and addresses of tracking images.
DROP = (
    "script", "style", "head", "meta", "link", "title", "noscript", "iframe", "frame", "frameset", "object", "embed", "applet", "form", "input", "button", "select", "textarea",
    "svg", "canvas", "video", "audio", "base", "o:smarttagtype", "xml", "v:shapetype", "v:shape", "w:worddocument",
)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:[;\s]|$)|max-height\s*:\s*0|font-size\s*:\s*0|mso-hide\s*:\s*all", re.I)
TRACKERS = ("open.aspx", "track", "beacon", "pixel.gif", "1x1.gif", "spacer.gif", "blank.gif", "transparent.gif")
BAD_ATTRIBUTES = ("srcdoc", "formaction", "xlink:href")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("p div tr li h1 h2 h3 h4 h5 h6".split())
SHELL = frozenset("tr td th tbody thead tfoot".split())
#: Characters of an inline image address from which on the image goes, and the name of a table that is no more.
LONG_DATA, LAYOUT = 4096, "#layout"


class Node:
    """An element (name and attributes) or a text (name "")."""

    __slots__ = ("name", "attrs", "children", "text")

    def __init__(self, name: str = "", attrs: dict[str, str] | None = None, text: str = ""):
        self.name, self.attrs, self.children, self.text = name, attrs or {}, [], text

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order, without recursion."""
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting.extend(reversed(node.children))

    def inner_text(self) -> str:
        return "".join(n.text for n in self.walk() if not n.name)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(Node(text=data))


def tree(html: str) -> Node:
    """Comments and declarations are not in it."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _pixels(node: Node, name: str) -> int | None:
    digits = re.search(r"\d+", node.attrs.get(name, ""))
    return int(digits.group()) if digits else None


def hidden(node: Node) -> bool:
    return "hidden" in node.attrs or bool(HIDING.search(node.attrs.get("style", "")))


def tracking(node: Node) -> bool:
    width, height = _pixels(node, "width"), _pixels(node, "height")
    tiny = width is not None and height is not None and max(width, height) <= 1
    return node.name == "img" and (tiny or any(t in node.attrs.get("src", "").lower() for t in TRACKERS))


def image_source(node: Node, cids: dict[str, str]) -> str | None:
    """Where the image is to be had; None if it goes."""
    src = node.attrs.get("src", "").strip()
    if src.lower().startswith("cid:"):
        return cids.get(src[4:].strip().strip("<>"))
    return None if not src or src.startswith("data:image") and len(src) > LONG_DATA else src


def is_data_table(table: Node) -> bool:
    """At least three columns and two rows, less than half of the cells empty."""
    rows = [n for n in table.walk() if n.name == "tr"]
    cells = [n for n in table.walk() if n.name in ("td", "th")]
    widest = max((sum(c.name in ("td", "th") for c in r.children) for r in rows), default=0)
    return bool(cells) and widest >= 3 and len(rows) >= 2 and sum(not c.inner_text().strip() for c in cells) < len(cells) / 2


def _replace(root: Node, change) -> None:
    """Every node's children become what change(child) gives for each, top down."""
    waiting = [root]
    while waiting:
        node = waiting.pop()
        node.children = [x for c in node.children for x in change(c)]
        waiting.extend(node.children)


def _opened(table: Node) -> list[Node]:
    """What a table's cells hold, in order."""
    out, waiting = [], list(reversed(table.children))
    while waiting:
        node = waiting.pop()
        if node.name in SHELL:
            waiting.extend(reversed(node.children))
        else:
            out.append(node)
    return out


def _without_layout(root: Node) -> None:
    """Layout tables give way to what their cells hold: one pass from the leaves up, so a table is judged by what its own inner
    tables have become."""
    for node in reversed(list(root.walk())):
        node.children = [x for c in node.children for x in (c.children if c.name == LAYOUT else [c])]
        if node.name == "table" and not is_data_table(node):
            node.name, node.children = LAYOUT, _opened(node)


def cleaned(html: str | None, cids: dict[str, str] | None = None) -> Node:
    """The tree without what is dangerous, hidden, tracking or layout; content-id images point to local files."""
    root = tree(html or "")
    drop = set(DROP)
    _replace(root, lambda c: [] if c.name and (c.name in drop or hidden(c) or tracking(c)) else [c])
    _without_layout(root)
    for node in root.walk():
        node.attrs = {k: v for k, v in node.attrs.items() if not k.startswith("on") and k not in BAD_ATTRIBUTES}

    def image(node: Node) -> list[Node]:
        if node.name == "img":
            source = image_source(node, cids or {})
            if source is None:
                return []
            node.attrs["src"] = source
        return [node]

    _replace(root, image)
    return root


def written(node: Node) -> str:
    """The tree as HTML."""
    out: list[str] = []
    waiting: list[Node | str] = [node]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.name:
            out.append(escape(x.text, quote=False))
        else:
            if x.name != "#root":
                out.append("<" + x.name + "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items()) + ">")
                if x.name not in VOID:
                    waiting.append(f"</{x.name}>")
            waiting.extend(reversed(x.children))
    return "".join(out)


def _squeezed(text: str) -> str:
    text = re.sub(r"[ \t]+", " ", text.replace("\xa0", " ").replace("\u200b", ""))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_text(html: str | None) -> str:
    """br and the ends of blocks are line ends."""
    out: list[str] = []
    waiting: list[Node | str] = [tree(html or "")]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.name == "br":
            out.append("\n")
        else:
            out.append(x.text)
            if x.name in BLOCKS:
                waiting.append("\n")
            waiting.extend(reversed(x.children))
    return _squeezed("".join(out))


def _mark_up(node: Node, depth: int, lists: list[int]) -> str:
    name = node.name
    if not name:
        return re.sub(r"\s+", " ", node.text)
    inner = "".join(_mark_up(c, depth + 1, lists) for c in node.children) if depth < 400 else node.inner_text()
    body = inner.strip()
    if name in ("b", "strong"):
        return f"**{body}**" if body else ""
    if name in ("i", "em"):
        return f"*{body}*" if body else ""
    if name == "code":
        return f"`{body}`" if body else ""
    if name == "a":
        href = node.attrs.get("href", "")
        return f"[{body}]({href})" if href and body else body
    if name == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')})"
    if name == "br":
        return "  \n"
    if name == "hr":
        return "\n\n---\n\n"
    if name[0] == "h" and name[1:] in tuple("123456"):
        return f"\n\n{'#' * int(name[1])} {body}\n\n" if body else ""
    if name == "pre":
        return f"\n\n```\n{node.inner_text().strip()}\n```\n\n"
    if name == "blockquote":
        return "\n\n" + "\n".join(f"> {line}" for line in body.split("\n")) + "\n\n" if body else ""
    if name in ("ul", "ol"):
        items = [re.sub(r"\n", "\n  ", x) for x in ("".join(_mark_up(c, depth + 1, lists) for c in li.children).strip() for li in node.children if li.name == "li")]
        return "\n\n" + "\n".join(f"{'-' if name == 'ul' else f'{i}.'} {x}" for i, x in enumerate(items, 1)) + "\n\n"
    if name == "table":
        rows = [[re.sub(r"\s*\n\s*", " ", _mark_up(c, depth + 1, lists).strip()) for c in r.children if c.name in ("td", "th")] for r in node.walk() if r.name == "tr"]
        rows = [r for r in rows if r]
        if not rows:
            return inner
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        return "\n\n" + "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]]) + "\n\n"
    return f"\n\n{body}\n\n" if name in ("p", "div", "li") and body else inner


def to_markdown(html: str | None, cids: dict[str, str] | None = None) -> str:
    """Cleaned HTML with ATX headings and - lists; what has no mark keeps its text."""
    if not html or not html.strip():
        return ""
    text = _mark_up(cleaned(html, cids), 0, [])
    text = re.sub(r"[ \t]+\n", "\n", text.replace("\xa0", " "))
    text = re.sub(r"!\[\]\(\s*\)|(?<!!)\[\]\(\s*\)", "", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def batched(function, kind: str = "string"):
    """A function of one value as a UDF that gets batches."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(function, na_action=None)

    return run


def clean_html(c: Column | str) -> Column:
    return batched(lambda x: written(cleaned(x)))(c)


def html_to_markdown(c: Column | str) -> Column:
    return batched(to_markdown)(c)


def html_to_text(c: Column | str) -> Column:
    return batched(to_text)(c)


def html_to_markdown_with(c: Column | str, cids: Column | str) -> Column:
    """cids: map of content id to local path."""

    @F.pandas_udf("string")
    def run(html: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([to_markdown(h, dict(p) if p is not None else {}) for h, p in zip(html, paths, strict=True)])

    return run(c, cids)
