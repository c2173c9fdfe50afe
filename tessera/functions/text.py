"""Text functions as column expressions: segmentation, tokens, snippets, redaction, names and formats.

All are native expressions, so they stay in generated code and reach the scan as projections. Null text gives null unless
a docstring says otherwise.
"""

from __future__ import annotations

import operator
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts whose characters are words by themselves, and signs that part the terms of a query.
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}"
TERM_BREAK = "[\\s,，。；;、！!？?：:（）()\\[\\]{}<>\"'“”‘’/\\\\|@#$%^&*+=~`\\-_]+"
#: White space as Unicode has it, for Java's expressions.
SPACE = r"(?U)\s"
#: The same, as signs.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _folds() -> tuple[str, str]:
    """Latin letters with marks and the letters without them, by Unicode's decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(c)) != chr(c) and unicodedata.normalize("NFKD", chr(c))[0].isascii() and unicodedata.normalize("NFKD", chr(c))[0].isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(c: Column | str) -> Column:
    """Without white space of any script at the ends; what lies between is not searched."""
    return F.btrim(_col(c), F.lit(BLANKS))


def replaced(c: Column | str, pattern: str, by: str, *signs: str) -> Column:
    """regexp_replace(c, pattern, by). signs: strings one of which is in whatever the pattern matches; a text that has none of
    them is searched for these only."""

    def rewrite(x: Column) -> Column:
        return F.when(reduce(operator.or_, [x.contains(s) for s in signs]), F.regexp_replace(x, pattern, by)).otherwise(x)

    return let(_col(c), rewrite)


def flattened(c: Column | str) -> Column:
    """On one line: every run of white space is a space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?U)\s+", " "), "^ | $", "")


def segment_cjk(c: Column | str) -> Column:
    """Each CJK character by itself between spaces, other runs as they are."""
    c = _col(c)
    split = F.regexp_replace(F.regexp_replace(c, f"([{CJK}])", " $1 "), f"(?<=[{CJK}])  (?=[{CJK}])", " ")
    edges = F.regexp_replace(F.regexp_replace(split, f"^ (?=[{CJK}])", ""), f"(?<=[{CJK}]) $", "")
    return F.when(c == "", "").otherwise(edges)


def tokens(c: Column | str) -> Column:
    """Index tokens: lower-cased runs of letters and digits without marks, CJK characters one by one. Null: none."""
    low = F.lower(F.coalesce(_col(c), F.lit("")))
    spaced = F.regexp_replace(F.translate(low, FOLD_FROM, FOLD_TO), f"([{CJK}])", " $1 ")
    return F.regexp_extract_all(F.when(low.rlike(r"[^\x00-\x7f]"), spaced).otherwise(low), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def query_terms(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), TERM_BREAK), lambda t: t != "")


def estimate_tokens(c: Column | str) -> Column:
    """A model's tokens, roughly: one a CJK character, 1.3 a Latin word, a quarter any other character, and one."""
    c = _col(c)

    def count(rest: Column) -> Column:
        """rest: the text with each Latin word as one w."""
        other = F.replace(rest, F.lit("w"), F.lit(""))
        cjk = F.when(F.octet_length(other) == F.length(other), 0).otherwise(F.length(other) - F.length(F.regexp_replace(other, f"[{CJK}]", "")))
        return F.floor(cjk + (F.length(rest) - F.length(other)) * F.lit(1.3) + (F.length(other) - cjk) * F.lit(0.25)) + 1

    return F.when(c == "", 0).otherwise(let(F.regexp_replace(c, "[A-Za-z0-9]+", "w"), count)).cast("int")


def snippet(text: Column | str, terms: list[str], length: int = 200) -> Column:
    """About `length` characters around the earliest exact hit of any term; the head if there is none."""

    def cut(flat: Column) -> Column:
        places = F.array(*[F.instr(flat, F.lit(t)) for t in terms]) if terms else F.array().cast("array<int>")
        head = F.concat(F.rtrim(F.substring(flat, 1, length)), F.lit("…"))

        def around(at: Column) -> Column:
            end = F.least(F.length(flat), F.greatest(F.lit(0), at - length // 2) + length)
            begin = F.greatest(F.lit(0), end - length)
            body = F.btrim(F.substring(flat, begin + 1, end - begin))
            return F.concat(F.when(begin > 0, "…").otherwise(""), body, F.when(end < F.length(flat), "…").otherwise(""))

        hit = F.array_min(F.filter(places, lambda p: p > 0)) - 1
        return F.when(F.length(flat) <= length, flat).otherwise(let(hit, lambda at: F.when(at.isNull(), head).otherwise(around(at))))

    return F.when(_col(text).isNull(), "").otherwise(let(flattened(text), cut))


#: Names before a secret in key-value form, and what stands for a secret.
SECRET_KEYS = "auth_code|authorization|password|passwd|secret|token|api_key|apikey|access_key|credential"
HIDDEN = "***REDACTED***"


def redact(c: Column | str, secrets: tuple[str, ...] = ()) -> Column:
    """Hides given secrets (four characters or more), bearer tokens, key-value secrets and long runs, in this order. Words
    end where ASCII letters, digits and _ do, so a secret beside a letter of another script is found, and white space is
    ASCII's: as the query's SQL has it, which Java's \\b and \\s are not."""
    out = _col(c)
    for secret in secrets:
        if len(secret) >= 4:
            out = F.replace(out, F.lit(secret), F.lit(HIDDEN))
    before, after, space = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])", r"\t\n\f\r "
    out = F.regexp_replace(out, rf"{before}(?iu)(bearer[{space}]+)([A-Za-z0-9._\-+/=]{{8,}})", f"$1{HIDDEN}")
    out = F.regexp_replace(out, rf"{before}(?iu:({SECRET_KEYS})){after}[{space}]*[:=][{space}]*(['\"]?)([^{space}'\",;)}}\]]+)\2", f"$1={HIDDEN}")
    return F.regexp_replace(out, f"{before}[A-Za-z0-9]{{24,}}{after}", HIDDEN)


def log_line(c: Column | str, limit: int = 200) -> Column:
    """On one line, cut to limit with a note of the whole length; null is empty."""
    flat = stripped(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "\r\n|\n", " "))
    note = F.concat(F.substring(flat, 1, limit), F.lit("…（已截断，共 "), F.length(flat).cast("string"), F.lit(" 字符）"))
    return F.when(F.length(flat) <= limit, flat).otherwise(note)


def clip(c: Column | str, limit: int = 120) -> Column:
    flat = stripped(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 1), F.lit("…")))


def mask_address(c: Column | str) -> Column:
    """ab***@domain; a***@domain for a short name; *** without an @."""
    c = _col(c)
    name = F.substring_index(c, "@", 1)
    domain = F.substring(c, F.instr(c, "@"), F.length(c))
    shown = F.when(F.length(name) > 2, F.substring(name, 1, 2)).otherwise(F.substring(name, 1, 1))
    return F.when(F.instr(c, "@") > 0, F.concat(shown, F.lit("***"), domain)).otherwise("***")


def human_size(c: Column | str) -> Column:
    """512B, 2.0KB, 5.0MB; half a tenth goes to the even one, as C and Python print it (1.25 is 1.2)."""
    size = _col(c).cast("long")
    out = F.concat(size.cast("string"), F.lit("B"))
    ways = [(4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")]
    chain = None
    for power, unit in ways:
        one = F.lit(1024**power).cast("long")
        rest = size % one * 10
        down, over = F.call_function("div", size, one) * 10 + F.call_function("div", rest, one), rest % one * 2
        tenths = down + F.when((over > one) | ((over == one) & (down % 2 == 1)), 1).otherwise(0)
        shown = F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))
        chain = F.when(size >= one, shown) if chain is None else chain.when(size >= one, shown)
    return chain.otherwise(out)


def duration(c: Column | str) -> Column:
    """m:ss, or h:mm:ss from an hour on; null is --."""
    s = F.floor(F.greatest(_col(c).cast("double"), F.lit(0.0))).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(_col(c).isNull(), "--").when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", minutes, rest))


#: Device names that cannot be file names.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]


def byte_prefix(c: Column | str, most: int) -> Column:
    """The longest beginning of at most `most` UTF-8 bytes that ends between characters."""
    c = _col(c)

    def cut(raw: Column) -> Column:
        # a byte that goes on with a character (10xxxxxx) cannot begin what is cut off: back to one that does not
        begins = lambda i: ~F.substring(F.hex(F.substring(raw, i + 1, F.lit(1))), 1, 1).isin("8", "9", "A", "B")
        ends = F.filter(F.sequence(F.lit(max(0, most - 3)), F.lit(most)), begins)
        return F.decode(F.substring(raw, F.lit(1), F.array_max(ends)), "utf-8")

    return F.when(F.octet_length(c) <= most, c).otherwise(let(F.substring(F.encode(c, "utf-8"), 1, most + 1), cut))


def safe_filename(c: Column | str, most: int = 180, otherwise: str = "untitled") -> Column:
    """A name that any file system takes: signs that none allows become _, no dots or blanks at the ends, device names get
    a _ in front, and no more than `most` bytes."""
    text = F.regexp_replace(_col(c), r'[<>:"/\\|?*\x00-\x1f]', "_")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"(?U)^[.\s]+|[.\s]+$", "")
    free = let(text, lambda t: F.when(F.upper(F.substring_index(t, ".", 1)).isin(RESERVED), F.concat(F.lit("_"), t)).otherwise(t))
    short = F.regexp_replace(let(free, lambda t: byte_prefix(t, most)), "[. ]+$", "")
    return let(short, lambda t: F.when(t.isNull() | (t == ""), otherwise).otherwise(t))


def safe_path(parts: Column | str) -> Column:
    """Path parts, each safe by itself; blanks, . and .. go; INBOX if nothing is left."""
    split = F.flatten(F.transform(_col(parts), lambda p: F.split(p, r"[/\\]")))
    named = F.transform(F.filter(F.transform(split, stripped), lambda p: ~p.isin("", ".", "..")), lambda p: safe_filename(p, 80, "folder"))
    return F.when(F.size(named) > 0, F.array_join(named, "/")).otherwise("INBOX")


def file_stamp(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(_col(ts), "yyyyMMdd_HHmmss"), F.lit("00000000_000000"))


def archive_name(ts: Column | str, subject: Column | str, uid: Column | str) -> Column:
    """stamp_subject_uid.md"""
    return F.concat_ws("_", file_stamp(ts), safe_filename(subject, 80), F.concat(_col(uid).cast("string"), F.lit(".md")))


def fingerprint(subject: Column | str, body: Column | str) -> Column:
    """sha256 of subject, a zero byte, and body."""
    return F.sha2(F.concat(F.coalesce(_col(subject), F.lit("")), F.lit("\0"), F.coalesce(_col(body), F.lit(""))), 256)


def chunk_hash(message_id: Column | str, index: Column | str, text: Column | str) -> Column:
    """Positional: the same text at another index has another hash."""
    return F.sha2(F.concat(_col(message_id).cast("string"), F.lit("|"), _col(index).cast("string"), F.lit("|"), _col(text)), 256)


def is_digest(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.btrim(_col(c))).rlike("^[0-9a-f]{64}$"), F.lit(False))


def blob_path(digest: Column | str) -> Column:
    d = _col(digest)
    return F.when(is_digest(d), F.concat_ws("/", F.lit("blobs"), F.substring(d, 1, 2), F.substring(d, 3, 2), d))


#: What replies and forwards put before a subject.
REPLY = r"(?i)^(?:\s*(?:(?:转发|回复|答复|回覆|转|回)\s*[:：]|(?:re|fwd?|fw|aw|sv)\s*[:：])\s*)+"


def bare_subject(c: Column | str) -> Column:
    return stripped(F.regexp_replace(_col(c), REPLY, ""))


def bare_address(c: Column | str) -> Column:
    c = _col(c)
    return F.lower(F.btrim(F.when(c.rlike("<[^>]+>"), F.regexp_extract(c, "<([^>]+)>", 1)).otherwise(c)))


def display_name(c: Column | str) -> Column:
    return F.btrim(F.btrim(F.btrim(F.regexp_extract(_col(c), r"^(.*?)\s*<[^>]+>$", 1)), F.lit('"')))


def message_id(c: Column | str) -> Column:
    return F.substring(F.btrim(F.btrim(F.btrim(_col(c)), F.lit("<>"))), 1, 512)


#: Endings of inline images.
EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/bmp": ".bmp", "image/svg+xml": ".svg", "image/tiff": ".tiff"}


def extension(content_type: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, _col(content_type)), F.lit(".bin"))


def mail_date(c: Column | str) -> Column:
    """RFC 2822 dates; without a zone they are UTC; what cannot be read is null."""
    plain = F.btrim(F.regexp_replace(F.regexp_replace(_col(c), r"^\s*[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", ""))
    zoned = F.regexp_replace(F.regexp_replace(plain, r"\s(GMT|UT|UTC|Z)$", " +0000"), r"\s+", " ")
    return F.coalesce(F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")), F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss")))
