"""Functions over a few literal rows, with the rows that they must give as SQL: for what only a tree, a mail or an awkward
text can show. The catalogue has queries of the same functions over tables (plans/rules.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import chunking, cleaning, embedding, html, mime, text
from tessera.functions.chunking import ChunkPolicy
from tessera.functions.cleaning import CleanPolicy
from tessera.functions.registry import register
from tessera.operators import match
from tessera.operators.filters import Filters
from tessera.plans.views import Catalog
from tessera.sources import archive as files

CATALOG = Catalog()
query = CATALOG.add

KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return "[" + ", ".join(map(literal, value)) + "]" if isinstance(value, list) else repr(value)


def rows_sql(schema: str, rows: list[tuple]) -> str:
    """The rows as SQL. schema: name and kind of each column, as Spark has it."""
    columns = [c.split(" ", 1) for c in schema.split(", ")]
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {KINDS[k]}) AS {n}' for n, k in columns)} FROM (VALUES {values}) AS t({', '.join(n for n, _ in columns)})"


def scalar(name: str, kind: str, function: Callable[..., Column], cases: list[tuple], given: str = "a string") -> None:
    """A query that applies a function to each case's inputs: n, out."""
    inputs = [c[0] if isinstance(c[0], tuple) else (c[0],) for c in cases]
    names = [c.split(" ", 1)[0] for c in given.split(", ")]

    def run(spark, sf_dir):
        rows = spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], f"n int, {given}")
        return rows.select("n", function(*map(F.col, names)).cast(kind).alias("out"))

    run.__name__ = name
    query(rows_sql(f"n int, out {kind}", [(i, c[1]) for i, c in enumerate(cases)]))(run)


# cleaning

scalar("clean_html_tree", "string", html.clean_html, [
    ('<p onclick="x()">Hi</p><script>a</script><!-- c -->', "<p>Hi</p>"),
    ('<div style="display:none">x</div><b>y</b><i hidden>z</i>', "<b>y</b>"),
    ('<a href="u" srcdoc="q" ONLOAD="w">t</a>', '<a href="u">t</a>'),
    ("<head><title>t</title></head><body>b<form>f</form></body>", "<body>b</body>"),
    ("", ""),
    (None, ""),
])
scalar("tracking_pixel", "string", html.clean_html, [
    ('<img src="http://t.example/open.aspx?x=1">a', "a"),
    ('<img src="a.png" width="1" height="1">b', "b"),
    ('<img src="a.png" width="10" height="1">c', '<img src="a.png" width="10" height="1">c'),
    ('<img src="http://x/PIXEL.GIF">d', "d"),
    ('<img alt="none">e', "e"),
])
scalar("unwrap_layout_tables", "string", html.clean_html, [
    ("<table><tr><td>a</td><td>b</td></tr></table>", "ab"),
    ("<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>", "<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"),
    ("<table><tr><td>a</td><td></td><td></td></tr><tr><td></td><td></td><td>z</td></tr></table>", "az"),
    ("<table><tr><td><table><tr><td>in</td></tr></table></td></tr></table>", "in"),
])
scalar("html_tree_to_markdown", "string", html.html_to_markdown, [
    ("<h2>T</h2><p>a <b>b</b> <em>c</em></p>", "## T\n\na **b** *c*"),
    ("<ul><li>x</li><li>y</li></ul>", "- x\n- y"),
    ("<ol><li>x</li><li>y</li></ol>", "1. x\n2. y"),
    ('<a href="http://l">k</a>', "[k](http://l)"),
    ("<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>", "| a | b | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |"),
    ("", ""),
])
scalar("html_tree_to_text", "string", html.html_to_text, [("a<br>b<p>c</p>d&nbsp;e", "a\nbc\nd e"), ("<ul><li>x</li><li>y</li></ul>", "x\ny"), (None, "")])
scalar("cid_to_path", "string", lambda a, b: html.html_to_markdown_with(a, F.create_map(F.lit("p@x"), b)), [(('<img src="cid:p@x" alt="A">', "attachments/p.png"), "![A](attachments/p.png)"), (('<p>t<img src="cid:other"></p>', "q"), "t"), (('<img src="cid:&lt;p@x&gt;">', "z.png"), "![](z.png)")], "a string, b string")
scalar("markdown_in_order", "string", cleaning.normalize_markdown, [("a  \r\nb\n\n\n\nc\n| --- | :-: |\n[]( )![]()", "a\nb\n\nc"), ("x\n| a | | |\ny", "x\n| a |\ny"), ("\xa0a", "a"), (None, "")])
scalar("text_to_markdown_ish", "string", cleaning.paragraphs_only, [("a\nb\n\n\nc", "a\nb\n\nc"), ("  \n\n x ", "x"), ("", "")])
scalar("strip_noise_markdown", "string", lambda c: cleaning.strip_noise_markdown(c, CleanPolicy(quoted_history=True)), [("a\n\n> q\n> r\n\nb", "a\n\nb"), ("a\n> kept not\nb", "a\nb"), ("x\n-- \nme", "x")])
scalar("noise_cut_markers", "string", cleaning.strip_noise, [("hello\nworld\n-- \nJohn\n555", "hello\nworld"), ("hello\n发自我的iPhone", "hello"), ("hi\nSent from my phone", "hi"), ("a\n=====\nb\n\n\n\nc", "a\nb\n\nc"), ("one\nThis message and any attachments are confidential", "one"), (" \n ", ""), (None, "")])
scalar("bare_subject", "string", text.bare_subject, [("Re: 转发: Fwd: plan", "plan"), ("Reply", "Reply"), ("回复：x", "x"), ("re:RE: y", "y"), ("AW: SV: z", "z"), ("", "")])
scalar("salvage_body", "string", cleaning.salvage, [(("**发件人：**Li**主题：**Plan for spring the whole text", "Re: Plan for spring"), "the whole text"), (("> quoted\nplain", ""), "quoted\nplain"), (("**From:** a **Subject:** other", "plan"), "")], "a string, b string")
scalar("body_mostly_lost", "boolean", cleaning.mostly_lost, [(("x" * 39, ""), False), (("x" * 40, ""), True), (("x" * 100, "x" * 29), True), (("x" * 100, "x" * 30), False), (("x" * 200, "x" * 49), True), (("x" * 200, "x" * 50), False), ((None, None), False)], "a string, b string")
scalar("compose_body_plain", "string", lambda a, b, c: cleaning.compose_body(a, b, c)["plain"], [(("plain\n\n\ntext", None, ""), "plain\n\ntext"), (("plain", "# Html", ""), "Html"), (("a\n-- \nb", None, ""), "a"), (("one\n\none\n\ntwo", None, ""), "one\n\ntwo")], "a string, b string, c string")
scalar("markdown_to_plain", "string", cleaning.markdown_to_plain, [("# T", "T"), ("see [l](u)", "see l"), ("a\\_b", "a_b"), ("**b** `c`", "b c"), ("![i](s)x", "x"), ("> > q", "q")])
scalar("redact_given_secrets", "string", lambda c: text.redact(c, ("s3cret1", "abc")), [("key s3cret1 x abc", "key ***REDACTED*** x abc"), ("token: 'q w", "token: 'q w"), ("token: 'q' w", "token=***REDACTED*** w"), ("Bearer abcdefghi", "Bearer ***REDACTED***"), ("A1" * 12, "***REDACTED***"), ("A1" * 11, "A1" * 11)])
scalar("log_line", "string", lambda c: text.log_line(c, 10), [("0123456789abc", "0123456789…（已截断，共 13 字符）"), ("a\nb", "a b"), (None, ""), ("  x ", "x")])

# names, formats

scalar("duration", "string", text.duration, [(5.0, "0:05"), (65.0, "1:05"), (3661.0, "1:01:01"), (None, "--"), (0.0, "0:00"), (59.9, "0:59"), (-3.0, "0:00")], "a double")
scalar("safe_relative_path", "string", lambda c: text.safe_path(F.array(c)), [("客户/2024/发票", "客户/2024/发票"), ("../..", "INBOX"), ("a\\b/./c:d", "a/b/c_d"), ("", "INBOX")])
scalar("safe_names", "string", text.safe_filename, [("", "untitled"), ("...", "untitled"), ("CON.txt", "_CON.txt"), ("a/b:c*d", "a_b_c_d"), ("  x \t y . ", "x _ y"), (None, "untitled"), ("财" * 70, "财" * 60)])
scalar("guess_extension", "string", text.extension, [("image/png", ".png"), ("image/jpeg", ".jpg"), ("image/svg+xml", ".svg"), ("text/plain", ".bin"), (None, ".bin")])
scalar("message_id_bare", "string", text.message_id, [(" <a@b> ", "a@b"), ("c@d", "c@d"), ("", "")])
scalar("bare_address", "string", text.bare_address, [("Li <Li@X.com>", "li@x.com"), ("A@B.c", "a@b.c"), ("", "")])
scalar("display_name", "string", text.display_name, [('"Li Lei" <Li@X.com>', "Li Lei"), ("a@b.c", ""), ("Han <h@x>", "Han")])
scalar("mail_date", "timestamp", text.mail_date, [("Fri, 01 Mar 2024 10:00:00 +0800", "2024-03-01 02:00:00"), ("1 Mar 2024 10:00:00", "2024-03-01 10:00:00"), ("Fri, 1 Mar 2024 10:00 GMT", "2024-03-01 10:00:00"), ("Fri, 1 Mar 2024 10:00:00 -0500 (EST)", "2024-03-01 15:00:00"), ("no date", None)])
scalar("archive_name", "string", lambda a, b, c: text.archive_name(a.cast("timestamp"), b, c), [(("2024-03-01 10:00:00", "a/b", 7), "20240301_100000_a_b_7.md"), ((None, "x", 1), "00000000_000000_x_1.md")], "a string, b string, c long")
scalar("digest_test", "boolean", text.is_digest, [("a" * 64, True), ("A" * 64, True), ("a" * 63, False), (" " + "0" * 64 + " ", True), ("g" * 64, False), (None, False)])

# queries

scalar("query_term_split", "array<string>", text.query_terms, [("a,b c_d e-f@g.h", ["a", "b", "c", "d", "e", "f", "g.h"]), ("报销；发票（x）", ["报销", "发票", "x"]), ("", []), (" ?! ", [])])


@query(rows_sql("variant int, phrase int, tokens string, prefix boolean", [(0, 0, "报 销 发 票 流 程", False), (0, 1, "invoice", True), (1, 0, "报 销 发 票 流", False), (2, 0, "报 销 发 票", False), (3, 0, "报 销 发", False), (4, 0, "报 销", False)]))
def progressive_relaxation(spark, sf_dir):
    plan = match.variants("报销发票流程 invoice")
    return spark.createDataFrame([(v, i, " ".join(p.tokens), p.prefix) for v, phrases in enumerate(plan) for i, p in enumerate(phrases)], "variant int, phrase int, tokens string, prefix boolean")


@query(rows_sql("n int, tokens string, prefix boolean", [(0, "café"[:3] + "e", True), (0, "報", False), (1, "a b", True), (2, "2024", True)]))
def match_builder(spark, sf_dir):
    """What a query's terms become: folded prefixes, and phrases of all characters."""
    plans = [match.strict("Café 報"), match.strict("a.b"), match.strict("2024 !!")]
    return spark.createDataFrame([(i, " ".join(p.tokens), p.prefix) for i, own in enumerate(plans) for p in own], "n int, tokens string, prefix boolean")


@query(rows_sql("n int, asked boolean", [(0, False), (1, False), (2, True), (3, True), (4, True)]))
def filter_non_empty(spark, sf_dir):
    own = [Filters(), Filters(include_deleted=True), Filters(folder=("a",)), Filters(has_attachments=False), Filters(subject="x")]
    return spark.createDataFrame([(i, f.any()) for i, f in enumerate(own)], "n int, asked boolean")


# chunks and vectors

scalar("sentence_units", "array<string>", chunking.sentences, [("a. b! 好。吗？", ["a.", "b!", "好。", "吗？"]), ("no end", ["no end"]), ("one\ntwo", ["one", "two"]), ("v1.2 is out. yes", ["v1.2 is out.", "yes"])])
scalar("chunk_units", "array<string>", lambda c: chunking.units(c, 5), [("abc\n\ndef", ["abc", "def"]), ("ab. cd.", ["ab.", "cd."]), ("abcdefgh", ["abcde", "fgh"]), ("", []), (None, [])])
scalar("split_text_packing", "array<string>", lambda c: chunking.chunk_texts(c, ChunkPolicy(8, 3, 2)), [("\n\n".join(x * 2 for x in "abcdefgh"), ["aa\n\nbb\n\ncc\n\ndd", "dd\n\nee\n\nff\n\ngg", "gg\n\nhh"]), ("one", ["one"]), ("", []), ("x " * 12 + "\n\nend", [("x " * 12).strip(), "end"])])


@query(rows_sql("chunk_index int, text string, token_count int, subject string", [(0, "aa\n\nbb\n\ncc\n\ndd", 7, "s"), (1, "dd\n\nee", 4, "s")]))
def split_with_metadata(spark, sf_dir):
    own = spark.createDataFrame([(1, "m", "s", "aa\n\nbb\n\ncc\n\ndd\n\nee"), (2, "n", "t", "")], "message_pk long, message_id string, subject string, body_text string")
    return chunking.chunks(own, policy=ChunkPolicy(8, 3, 2)).select("chunk_index", "text", "token_count", "subject")


scalar("embedding_text", "string", embedding.embedding_text, [(("s", "t"), "s\nt"), (("(无主题)", "t"), "t"), (("", "t"), "t"), ((None, "t"), "t")], "a string, b string")
scalar("budgeted_body", "string", lambda c: chunking.budgeted(c, 4), [("报销abc", "报"), ("abcdef", "abcd"), ("ab", "ab"), ("🙂x", "🙂"), ("a🙂", "a")])


@query(rows_sql("feature string, n long", [("the", 2), ("cat", 1), ("the_cat", 1), ("cat_the", 1), ("报", 1), ("销", 1), ("报销", 1), ("2", 1), ("the_2", 1)]))
def hash_features(spark, sf_dir):
    """Half-width forms, in lower case; neighbours make pairs within each script."""
    return spark.createDataFrame(list(embedding.features("The ＣＡＴ the 报销 2").items()), "feature string, n long")


@query(rows_sql("n int, place int, value double", [(0, 47, -1.0), (1, 31, -1.0)]))
def hash_bucket(spark, sf_dir):
    """Where blake2b of eight bytes puts a word of 64 places, and its sign."""
    own = spark.createDataFrame([(0, "cat"), (1, "dog")], "n int, t string").select("n", F.posexplode(embedding.embed("t", embedding.hashing(64))).alias("place", "value"))
    return own.where("value != 0").select("n", "place", F.col("value").cast("double").alias("value"))


scalar("l2_normalize", "array<double>", lambda c: F.transform(embedding.l2_normalize(c), lambda x: F.round(x, 9)), [([3.0, 4.0], [0.6, 0.8]), ([0.0, 0.0], [0.0, 0.0]), ([-2.0], [-1.0])], "a array<double>")
scalar("dot_over_common_length", "double", embedding.dot, [(([1.0, 2.0], [3.0]), 3.0), (([1.0, 2.0], [3.0, 4.0]), 11.0), (([], [1.0]), 0.0)], "a array<double>, b array<double>")


@query(rows_sql("n int, packed string, back array<double>", [(0, "0000003f000000c0", [0.5, -2.0]), (1, "", []), (2, "0000803f", [1.0])]))
def pack_vectors(spark, sf_dir):
    own = [[0.5, -2.0], [], [1.0]]
    return spark.createDataFrame([(i, embedding.pack_vector(v).hex(), embedding.unpack_vector(embedding.pack_vector(v))) for i, v in enumerate(own)], "n int, packed string, back array<double>")


@query(rows_sql("name string, dimension int, least double", [("hashing", 512, 0.25), ("hashing", 64, 0.25)]))
def create_embedder(spark, sf_dir):
    own = [embedding.backend("hashing"), embedding.backend("hashing", dimension=10)]
    return spark.createDataFrame([(b.name, b.dimension, b.least_score) for b in own], "name string, dimension int, least double")


@query(rows_sql("markdown string, plain string, size int, chunks long", [("**x**", "a b", 512, 1)]))
def registered_functions(spark, sf_dir):
    """The functions that SQL can call."""
    register(spark)
    words = "One sentence. " * 60
    return spark.sql(f"SELECT html_to_markdown('<b>x</b>') AS markdown, html_to_text('a <i>b</i>') AS plain, size(embed_text('x')) AS size, (SELECT count(*) FROM chunks('{words}')) AS chunks")


# mail

def _mail(headers: str, body: str = "body", charset: str = "utf-8") -> bytes:
    return headers.replace("\n", "\r\n").encode() + b"\r\n\r\n" + body.replace("\n", "\r\n").encode(charset)


_PLAIN = _mail('Subject: =?utf-8?B?5oql6ZSA?= report\nFrom: =?gbk?B?wO7A1w==?= <Li.Lei@Corp.com>\nTo: a@x.com, "B, C" <b@x.com>\nCc: c@x.com\nDate: Fri, 01 Mar 2024 10:00:00 +0800\nMessage-ID: <msg-1@corp.com>\nContent-Type: text/plain; charset=utf-8', "hello body")
_BARE = _mail("From: someone@x.com\nDate: whenever", "")
_WRONG = _mail("Subject: x\nContent-Type: text/plain; charset=utf-8", "发票内容很多", "gb18030")
_MIXED = _mail("""Subject: files
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="B\"""".replace('\\"', '"'), """--B
Content-Type: multipart/alternative; boundary="A"

--A
Content-Type: text/plain; charset=utf-8

plain
--A
Content-Type: text/html; charset=utf-8

<p>html</p>
--A--
--B
Content-Type: application/pdf; name="=?utf-8?B?5oql?="
Content-Transfer-Encoding: base64

QUJD
--B
Content-Type: application/octet-stream
Content-Disposition: attachment; filename*=utf-8''%E6%8A%A5.bin
Content-Transfer-Encoding: base64

QUJDRA==
--B
Content-Type: image/png
Content-ID: <pic@x>
Content-Disposition: inline
Content-Transfer-Encoding: base64

UE5H
--B
Content-Type: message/rfc822

Subject: inner

inner body
--B--
""")
_MAILS = [(0, _PLAIN), (1, _BARE), (2, _WRONG), (3, _MIXED)]
_RAW = "n int, content binary"


def _mails(spark):
    return spark.createDataFrame([(n, bytearray(raw)) for n, raw in _MAILS], _RAW)


@query(rows_sql("n int, subject string, sender string, sender_name string, recipients string, cc string, message_id string, date_utc timestamp", [
    (0, "报销 report", "li.lei@corp.com", "李雷", "a@x.com, B, C <b@x.com>", "c@x.com", "msg-1@corp.com", "2024-03-01 02:00:00"),
    (1, "(无主题)", "someone@x.com", "", "", "", "", None),
    (2, "x", "", "", "", "", "", None),
    (3, "files", "", "", "", "", "", None),
]))
def mime_headers(spark, sf_dir):
    """Encoded words, character sets, addresses, dates and ids."""
    return mime.messages(_mails(spark)).select("n", "subject", "sender", "sender_name", "recipients", "cc", "message_id", "date_utc")


@query(rows_sql("n int, subject string, sender string, message_id string", [(0, "报销 report", "li.lei@corp.com", "msg-1@corp.com"), (1, "(无主题)", "someone@x.com", ""), (2, "x", "", ""), (3, "files", "", "")]))
def fetch_envelopes(spark, sf_dir):
    return mime.envelopes(_mails(spark)).select("n", "subject", "sender", "message_id")


@query(rows_sql("n int, body_text string, has_attachments boolean", [(0, "hello body", False), (1, "(此邮件无正文内容)", False), (2, "发票内容很多", False), (3, "html", True)]))
def mime_bodies(spark, sf_dir):
    return mime.messages(_mails(spark)).select("n", "body_text", "has_attachments")


@query(rows_sql("part_index int, filename string, content_type string, size_bytes long, content_id string, is_inline boolean, downloaded boolean, skip_reason string", [
    (1, "报", "application/pdf", 3, None, False, True, None),
    (2, "报.bin", "application/octet-stream", 4, None, False, False, "超过大小阈值 0MB（实际 0.0MB）"),
    (3, "inline_pic@x.png", "image/png", 3, "pic@x", True, True, None),
    (4, "forwarded_4.eml", "message/rfc822", 26, None, False, False, "超过大小阈值 0MB（实际 0.0MB）"),
]))
def mime_attachments(spark, sf_dir):
    """Named, unnamed, inline and forwarded parts, and the policy on their size."""
    own = mime.messages(_mails(spark), most=3).where("n = 3").select(F.explode("attachments").alias("a"))
    return own.select("a.part_index", "a.filename", "a.content_type", "a.size_bytes", "a.content_id", "a.is_inline", "a.downloaded", "a.skip_reason")


_STRUCTURE = b'1 (UID 7 BODYSTRUCTURE ((("text" "plain" ("charset" "utf-8") NIL NIL "base64" 120 3 NIL NIL NIL)("text" "html" NIL NIL NIL "7bit" 400 9) "alternative")("application" "pdf" ("name" "=?utf-8?B?5oql?=") NIL NIL "base64" 99999999 NIL ("attachment" ("filename" "x.pdf")))("message" "rfc822" NIL NIL NIL "7bit" 50 NIL ("text" "plain" NIL NIL NIL "7bit" 5 1)) "mixed"))'


@query(rows_sql("section string, content_type string, encoding string, size long, lines long, filename string, disposition string", [
    ("1.1", "text/plain", "BASE64", 120, 3, "", ""), ("1.2", "text/html", "7BIT", 400, 9, "", ""), ("2", "application/pdf", "BASE64", 99999999, 0, "报", "attachment"), ("3", "message/rfc822", "7BIT", 50, 0, "", ""), ("3.1", "text/plain", "7BIT", 5, 1, "", ""),
]))
def fetch_bodystructure(spark, sf_dir):
    own = spark.createDataFrame([(bytearray(_STRUCTURE),)], "s binary").select(F.explode(mime.body_structure("s")).alias("p"))
    return own.select("p.*")


@query(rows_sql("n int, plan string, sections array<string>, left_out array<string>", [(1, "partial", ["1.1", "1.2", "3.1"], ["报", "attachment_2"]), (2, "full", ["1.1", "1.2", "3.1"], ["报", "attachment_2"]), (3, "full", [], [])]))
def plan_fetch(spark, sf_dir):
    """Whether a message is fetched whole, which text sections else, and which attachments are then left out."""
    rows = [(1, bytearray(_STRUCTURE), 10**9), (2, bytearray(_STRUCTURE), 1000), (3, None, 10**9)]
    own = spark.createDataFrame(rows, "n int, s binary, size long").withColumn("parts", mime.body_structure("s"))
    names = F.transform(mime.parts_not_fetched("parts"), lambda a: a["filename"])
    return own.select("n", mime.fetch_plan("size", "parts").alias("plan"), mime.text_sections("parts").alias("sections"), names.alias("left_out"))


# parameters and made-up mail

@query(rows_sql("messages long, subjects boolean, folders boolean, same boolean", [(12, True, True, True)]))
def demo_mail(spark, sf_dir):
    """Made-up mail is the same for the same seed, of known subjects and folders."""
    from tessera.functions.mime import messages

    own = messages(files.demo_mail(spark, 12))
    again = files.demo_mail(spark, 12).exceptAll(files.demo_mail(spark, 12)).isEmpty()
    facts = own.agg(F.count("*"), F.every(F.col("subject").isin(files.DEMO_SUBJECTS)), F.every(F.col("folder").isin(files.DEMO_FOLDERS))).first()
    return spark.createDataFrame([(*facts, again)], "messages long, subjects boolean, folders boolean, same boolean")


@query(rows_sql("name string, value string", [("search.rrf_k", "7"), ("search.default_limit", "3"), ("sync.exclude_folders", "Spam"), ("embedding.chunk_size", "500"), ("embedding.chunk_overlap", "80")]))
def configuration(spark, sf_dir):
    """Defaults, a mapping, the environment, and what overrides them all."""
    from tessera.sources.config import load

    own = load({"search": {"rrf_k": 5, "default_limit": 9}, "sync": {"exclude_folders": ["Spam"]}}, {"TESSERA_SEARCH__RRF_K": "6", "TESSERA_SEARCH__DEFAULT_LIMIT": "3", "TESSERA_EMBEDDING__CHUNK_SIZE": "500"}, {"search": {"rrf_k": 7}})
    rows = [("search.rrf_k", own.search.rrf_k), ("search.default_limit", own.search.default_limit), ("sync.exclude_folders", ",".join(own.sync.exclude_folders)), ("embedding.chunk_size", own.embedding.chunk_size), ("embedding.chunk_overlap", own.embedding.chunk_overlap)]
    return spark.createDataFrame([(n, str(v)) for n, v in rows], "name string, value string")
