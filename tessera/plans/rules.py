"""Queries of the rules for HTML, text, names, chunks and mail over whole tables.

Each document takes one of a function's cases, by its number. A case is an awkward frame around what the document has: § is
its text (letters only, the words parted by single spaces), ¶ a word of its own, ‡ two letters of its own. What a function
must give is stated in the same way, so the SQL puts the same text into what is stated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import chunking, cleaning, embedding, html, mime, text
from tessera.functions.chunking import ChunkPolicy
from tessera.functions.cleaning import CleanPolicy
from tessera.functions.registry import register
from tessera.operators import match
from tessera.operators.postings import keyword_hits
from tessera.plans.views import Catalog, table

CATALOG = Catalog()
query = CATALOG.add

PHRASE_SQL = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))"
WORD_SQL, PAIR_SQL = "'w' || doc_id", "'k' || chr(CAST(97 + doc_id % 26 AS INTEGER))"
OWN_SQL = f"own AS (SELECT *, CASE WHEN {PHRASE_SQL} = '' THEN 'none' ELSE {PHRASE_SQL} END AS phrase, {WORD_SQL} AS word, {PAIR_SQL} AS pair FROM documents)"


def filled_sql(value: str) -> str:
    return f"replace(replace(replace({value}, '§', phrase), '¶', word), '‡', pair)"


def own(spark, sf_dir) -> DataFrame:
    phrase = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(phrase == "", "none").otherwise(phrase).alias("phrase"), F.concat(F.lit("w"), "doc_id").alias("word"), F.concat(F.lit("k"), F.chr(F.lit(97) + F.col("doc_id") % 26)).alias("pair"))


def filled(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("§"), F.col("phrase")), F.lit("¶"), F.col("word")), F.lit("‡"), F.col("pair"))


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return "[" + ", ".join(map(literal, value)) + "]" if isinstance(value, list) else repr(value)


def framed(name: str, function: Callable[..., Column], cases: list[tuple]) -> None:
    """A query that applies a function of texts to each document's case: doc_id, out. A case: its input or inputs, and what
    comes out (a text, a list of texts or a truth)."""
    inputs = [c[0] if isinstance(c[0], tuple) else (c[0],) for c in cases]
    width, listed = len(inputs[0]), isinstance(cases[0][1], list)

    def run(spark, sf_dir):
        rows = own(spark, sf_dir)
        at = (F.col("doc_id") % len(cases) + 1).cast("int")
        given = [filled(F.element_at(F.array(*[F.lit(x[i]) for x in inputs]), at)) for i in range(width)]
        return rows.select("doc_id", *[g.alias(f"a{i}") for i, g in enumerate(given)]).select("doc_id", function(*[F.col(f"a{i}") for i in range(width)]).alias("out"))

    run.__name__, run.__doc__ = name, f"{len(cases)} cases."
    out = f"list_transform(out, lambda x: {filled_sql('x')})" if listed else "out" if isinstance(cases[0][1], bool) else filled_sql("out")
    rows = ", ".join(f"({i}, {literal(c[1])})" for i, c in enumerate(cases))
    query(f"WITH {OWN_SQL}, cases(n, out) AS (VALUES {rows})\nSELECT doc_id, {out} AS out FROM own JOIN cases ON n = doc_id % {len(cases)}")(run)


# HTML

framed("clean_html_tree", html.clean_html, [
    ('<p onclick="x()">§</p><script>a</script><!-- c -->', "<p>§</p>"),
    ('<div style="display:none">§</div><b>¶</b><i hidden>z</i>', "<b>¶</b>"),
    ('<a href="¶" srcdoc="q" ONLOAD="w">§</a>', '<a href="¶">§</a>'),
    ("<head><title>t</title></head><body>§<form>f</form></body>", "<body>§</body>"),
])
framed("tracking_pixel", html.clean_html, [
    ('<img src="http://t.example/open.aspx?x=¶">§', "§"),
    ('<img src="¶.png" width="1" height="1">§', "§"),
    ('<img src="¶.png" width="10" height="1">§', '<img src="¶.png" width="10" height="1">§'),
    ('<img src="http://x/PIXEL.GIF">§', "§"),
    ('<img alt="none">§', "§"),
])
framed("unwrap_layout_tables", html.clean_html, [
    ("<table><tr><td>§</td><td>¶</td></tr></table>", "§¶"),
    ("<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>¶</td><td>2</td><td>3</td></tr></table>", "<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>¶</td><td>2</td><td>3</td></tr></table>"),
    ("<table><tr><td>¶</td><td></td><td></td></tr><tr><td></td><td></td><td>z</td></tr></table>", "¶z"),
    ("<table><tr><td><table><tr><td>§</td></tr></table></td></tr></table>", "§"),
])
framed("html_tree_to_markdown", html.html_to_markdown, [
    ("<h2>¶</h2><p>§ <b>b</b> <em>c</em></p>", "## ¶\n\n§ **b** *c*"),
    ("<ul><li>§</li><li>¶</li></ul>", "- §\n- ¶"),
    ("<ol><li>§</li><li>¶</li></ol>", "1. §\n2. ¶"),
    ('<a href="http://¶">§</a>', "[§](http://¶)"),
    ("<table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>¶</td><td>2</td><td>3</td></tr></table>", "| a | b | c |\n| --- | --- | --- |\n| ¶ | 2 | 3 |"),
])
framed("html_tree_to_text", html.html_to_text, [("§<br>b<p>c</p>d&nbsp;¶", "§\nbc\nd ¶"), ("<ul><li>§</li><li>¶</li></ul>", "§\n¶")])
framed("cid_to_path", lambda a, b: html.html_to_markdown_with(a, F.create_map(F.lit("p@x"), b)), [(('<img src="cid:p@x" alt="A">', "attachments/¶.png"), "![A](attachments/¶.png)"), (('<p>§<img src="cid:other"></p>', "q"), "§"), (('<img src="cid:&lt;p@x&gt;">', "¶.png"), "![](¶.png)")])

# texts

framed("markdown_in_order", cleaning.normalize_markdown, [("§  \r\nb\n\n\n\nc\n| --- | :-: |\n[]( )![]()", "§\nb\n\nc"), ("x\n| ¶ | | |\ny", "x\n| ¶ |\ny"), ("\xa0§", "§")])
framed("text_to_markdown_ish", cleaning.paragraphs_only, [("§\nb\n\n\nc", "§\nb\n\nc"), ("  \n\n § ", "§")])
framed("strip_noise_markdown", lambda c: cleaning.strip_noise_markdown(c, CleanPolicy(quoted_history=True)), [("§\n\n> q\n> r\n\nb", "§\n\nb"), ("§\n> kept not\nb", "§\nb"), ("§\n-- \nme", "§")])
framed("noise_cut_markers", cleaning.strip_noise, [("hello\n§\n-- \nJohn\n555", "hello\n§"), ("§\n发自我的iPhone", "§"), ("§\nSent from my phone", "§"), ("§\n=====\nb\n\n\n\nc", "§\nb\n\nc"), ("§\nThis message and any attachments are confidential", "§")])
framed("bare_subject", text.bare_subject, [("Re: 转发: Fwd: §", "§"), ("Reply §", "Reply §"), ("回复：§", "§"), ("re:RE: §", "§"), ("AW: SV: §", "§")])
framed("salvage_body", cleaning.salvage, [(("**发件人：**Li**主题：**Plan for ¶ §", "Re: Plan for ¶"), "§"), (("> quoted\n§", ""), "quoted\n§"), (("**From:** a **Subject:** other", "¶"), "")])
framed("compose_body_plain", lambda a, b, c: cleaning.compose_body(a, b, c)["plain"], [(("§\n\n\ntext", None, ""), "§\n\ntext"), (("plain", "# §", ""), "§"), (("§\n-- \nb", None, ""), "§"), (("§\n\n§\n\ntwo", None, ""), "§\n\ntwo")])
framed("markdown_to_plain", cleaning.markdown_to_plain, [("# §", "§"), ("see [§](u)", "see §"), ("¶\\_b", "¶_b"), ("**§** `c`", "§ c"), ("![i](s)§", "§"), ("> > §", "§")])
framed("redact_given_secrets", lambda c: text.redact(c, ("s3cret1", "abc")), [("key s3cret1 ¶ abc", "key ***REDACTED*** ¶ abc"), ("token: '¶ w", "token: '¶ w"), ("token: '¶' w", "token=***REDACTED*** w"), ("Bearer ‡cdefghi", "Bearer ***REDACTED***"), ("‡" * 12, "***REDACTED***"), ("‡" * 11, "‡" * 11)])
framed("log_line", lambda c: text.log_line(c, 10), [("‡23456789ab", "‡23456789…（已截断，共 12 字符）"), ("‡\nb", "‡ b"), ("  ¶ ", "¶")])


@query("SELECT doc_id, length(s) >= 40 AND length(s) * 0.25 > length(k) OR length(s) >= 40 AND length(k) < 30 AS lost FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS s, regexp_replace(substr(coalesce(text, ''), 1, CAST(doc_id % 97 AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS k FROM documents)")
def body_mostly_lost(spark, sf_dir):
    """What is left of a text: its first characters, so many as its number says."""
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.mostly_lost("text", F.substring("text", F.lit(1), (F.col("doc_id") % 97).cast("int"))).alias("lost"))


# names, formats

@query("SELECT click_id, CASE WHEN value IS NULL THEN '--' WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS out FROM (SELECT click_id, value, CAST(floor(greatest(value * 90, 0)) AS BIGINT) AS s FROM clicks)")
def duration(spark, sf_dir):
    return table(spark, sf_dir, "clicks").select("click_id", text.duration(F.col("value") * 90).alias("out"))


framed("safe_relative_path", lambda c: text.safe_path(F.array(c)), [("客户/¶/发票", "客户/¶/发票"), ("../¶/..", "¶"), ("¶\\b/./c:d", "¶/b/c_d")])
framed("safe_names", text.safe_filename, [("CON.¶", "_CON.¶"), ("¶/b:c*d", "¶_b_c_d"), ("  ¶ \t y . ", "¶ _ y"), ("...¶", "¶")])
framed("guess_extension", text.extension, [("image/png", ".png"), ("image/jpeg", ".jpg"), ("image/svg+xml", ".svg"), ("text/¶", ".bin")])
framed("message_id_bare", text.message_id, [(" <¶@b> ", "¶@b"), ("c@¶", "c@¶")])
framed("bare_address", text.bare_address, [("§ <Li@¶.COM>", "li@¶.com"), ("¶@B.c", "¶@b.c")])
framed("display_name", text.display_name, [('"§" <Li@X.com>', "§"), ("¶@b.c", ""), ("¶ <h@x>", "¶")])
framed("archive_name", lambda a, b, c: text.archive_name(a.cast("timestamp"), b, c.cast("long")), [(("2024-03-01 10:00:00", "a/¶", "7"), "20240301_100000_a_¶_7.md"), ((None, "¶", "1"), "00000000_000000_¶_1.md")])


@query("SELECT sale_id, date_trunc('second', sold_at) - to_hours(CASE sale_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 0 ELSE -5 END) AS out FROM sales")
def mail_date(spark, sf_dir):
    """Times of sales as headers of mail have them, in three zones."""
    written = F.concat(F.date_format("sold_at", "EEE, dd MMM yyyy HH:mm:ss"), F.element_at(F.array(F.lit(" +0800"), F.lit(" GMT"), F.lit(" -0500 (EST)")), (F.col("sale_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "sales").select("sale_id", text.mail_date(written).cast("timestamp_ntz").alias("out"))


@query("SELECT doc_id, doc_id % 4 < 2 AS out FROM documents")
def digest_test(spark, sf_dir):
    """Digests of the texts, in capitals, cut short, and with a sign that is none of theirs."""
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    return table(spark, sf_dir, "documents").select("doc_id", text.is_digest(F.element_at(F.array(h, F.concat(F.lit(" "), F.upper(h)), F.substring(h, 1, 63), F.concat(F.substring(h, 1, 63), F.lit("g"))), (F.col("doc_id") % 4 + 1).cast("int"))).alias("out"))


# queries

framed("query_term_split", text.query_terms, [("¶,b c_¶ e-f@g.h", ["¶", "b", "c", "¶", "e", "f", "g.h"]), ("报销；¶（x）", ["报销", "¶", "x"]), (" ?! ", [])])

_TITLES = ["报销发票流程", "报销发票流", "报销发票", "Cafés 報告 x", "cafe 公報"]


def _titled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("doc_id") % len(_TITLES) + 1).cast("int")).alias("title"))


@query("SELECT doc_id, CAST(2 AS INTEGER) AS variant FROM documents WHERE doc_id % 5 < 2")
def progressive_relaxation(spark, sf_dir):
    """No title has the whole question; without its last sign, and then without its last two, some have."""
    plan = match.variants("报销发票流畅吗")
    hits = keyword_hits(_titled(spark, sf_dir), "doc_id", ["title"], plan)
    first = hits.agg(F.min("variant").alias("first"))
    return hits.join(F.broadcast(first), F.col("variant") == F.col("first")).select("doc_id", "variant")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 > 2")
def match_builder(spark, sf_dir):
    """A question's terms are folded beginnings of words, and phrases of signs."""
    return keyword_hits(_titled(spark, sf_dir), "doc_id", ["title"], [match.strict("CAFÉ 報")]).select("doc_id")


# chunks and vectors

framed("sentence_units", chunking.sentences, [("¶. b! 好。吗？", ["¶.", "b!", "好。", "吗？"]), ("no end ¶", ["no end ¶"]), ("§\ntwo", ["§", "two"]), ("v1.2 is ¶. yes", ["v1.2 is ¶.", "yes"])])
framed("chunk_units", lambda c: chunking.units(c, 5), [("‡c\n\ndef", ["‡c", "def"]), ("‡. cd.", ["‡.", "cd."]), ("‡cdefgh", ["‡cde", "fgh"])])
framed("split_text_packing", lambda c: chunking.chunk_texts(c, ChunkPolicy(8, 3, 2)), [("\n\n".join(["‡", *(x * 2 for x in "bcdefgh")]), ["‡\n\nbb\n\ncc\n\ndd", "dd\n\nee\n\nff\n\ngg", "gg\n\nhh"]), ("‡e", ["‡e"]), ("x " * 12 + "\n\n‡", [("x " * 12).strip(), "‡"])])


@query(f"WITH {OWN_SQL} SELECT doc_id, i AS chunk_index, CASE i WHEN 0 THEN pair || chr(10) || chr(10) || 'bb' || chr(10) || chr(10) || 'cc' || chr(10) || chr(10) || 'dd' ELSE 'dd' || chr(10) || chr(10) || 'ee' END AS text, CASE i WHEN 0 THEN 7 ELSE 4 END AS token_count, word AS subject FROM own, (VALUES (0), (1)) v(i)")
def split_with_metadata(spark, sf_dir):
    rows = own(spark, sf_dir).select(F.col("doc_id").alias("message_pk"), F.col("word").alias("message_id"), F.col("word").alias("subject"), F.concat("pair", F.lit("\n\nbb\n\ncc\n\ndd\n\nee")).alias("body_text"))
    return chunking.chunks(rows, policy=ChunkPolicy(8, 3, 2)).select(F.col("message_pk").alias("doc_id"), "chunk_index", "text", "token_count", "subject")


framed("embedding_text", embedding.embedding_text, [(("¶", "§"), "¶\n§"), (("(无主题)", "§"), "§"), (("", "§"), "§"), ((None, "§"), "§")])
framed("budgeted_body", lambda c: chunking.budgeted(c, 4), [("报销‡", "报"), ("‡cdef", "‡cd"), ("‡", "‡"), ("🙂‡", "🙂")])


@query("SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 3 / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * 9 * CAST(y AS DOUBLE)))), 6)) AS unit FROM embeddings")
def l2_normalize(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(embedding.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)), lambda x: embedding.rounded(x, 6)).alias("unit"))


@query("SELECT vec_id, round(list_dot_product(CAST(embedding[1:10] AS DOUBLE[]), CAST(list_reverse(embedding)[1:10] AS DOUBLE[])), 6) AS score FROM embeddings")
def dot_over_common_length(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", embedding.rounded(embedding.dot(F.slice("embedding", 1, 10), F.reverse("embedding")), 6).alias("score"))


@query(f"WITH {OWN_SQL} SELECT doc_id, '**' || word || '**' AS markdown, 'a ' || word AS plain, 512 AS size, TRUE AS chunked FROM own")
def registered_functions(spark, sf_dir):
    """The functions that SQL can call, over a table; every text gives chunks, each a row."""
    register(spark)
    own(spark, sf_dir).createOrReplaceTempView("own_words")
    return spark.sql("SELECT doc_id, html_to_markdown(concat('<b>', word, '</b>')) AS markdown, html_to_text(concat('a <i>', word, '</i>')) AS plain, size(embed_text(word)) AS size, EXISTS (SELECT 1 FROM own_words w, LATERAL chunks(w.word) c WHERE w.doc_id = o.doc_id) AS chunked FROM own_words o")


# mail

_HEAD = "\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=\"B\"\n\n--B\nContent-Type: multipart/alternative; boundary=\"A\"\n\n--A\nContent-Type: text/plain; charset=utf-8\n\nplain\n--A\nContent-Type: text/html; charset=utf-8\n\n<p>§</p>\n--A--\n"
_MAILS = [
    "Subject: =?utf-8?B?5oql6ZSA?= ¶\nFrom: =?gbk?B?wO7A1w==?= <Li.Lei@¶.com>\nTo: a@x.com, \"B, C\" <b@x.com>\nCc: ¶@x.com\nDate: Fri, 01 Mar 2024 10:00:00 +0800\nMessage-ID: <¶@corp.com>\nContent-Type: text/plain; charset=utf-8\n\n§",
    "From: ¶@x.com\nDate: whenever\n\n",
    "Subject: files" + _HEAD + "--B\nContent-Type: application/pdf; name=\"=?utf-8?B?5oql?=\"\nContent-Transfer-Encoding: base64\n\nQUJD\n--B\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename*=utf-8''%E6%8A%A5¶.bin\nContent-Transfer-Encoding: base64\n\nQUJDRA==\n--B\nContent-Type: image/png\nContent-ID: <¶@x>\nContent-Disposition: inline\nContent-Transfer-Encoding: base64\n\nUE5H\n--B--\n",
]


def framed_mails(spark, sf_dir) -> DataFrame:
    """Documents inside of awkward mail: doc_id, content."""
    raw = filled(F.element_at(F.array(*[F.lit(m.replace("\n", "\r\n")) for m in _MAILS]), (F.col("doc_id") % len(_MAILS) + 1).cast("int")))
    return own(spark, sf_dir).select("doc_id", F.encode(raw, "utf-8").alias("content"))


def _mail_sql(columns: dict[str, tuple]) -> str:
    """A row a document; of each column what the mails give, in order."""
    cases = lambda own: " ".join(f"WHEN {i} THEN {filled_sql(literal(v)) if isinstance(v, str) else literal(v)}" for i, v in enumerate(own))
    return f"WITH {OWN_SQL} SELECT doc_id, " + ", ".join(f"CASE doc_id % {len(_MAILS)} {cases(v)} END AS {c}" for c, v in columns.items()) + " FROM own"


@query(_mail_sql({"subject": ("报销 ¶", "(无主题)", "files"), "sender": ("li.lei@¶.com", "¶@x.com", ""), "sender_name": ("李雷", "", ""), "recipients": ("a@x.com, B, C <b@x.com>", "", ""), "cc": ("¶@x.com", "", ""), "message_id": ("¶@corp.com", "", ""), "dated": (True, False, False)}))
def mime_headers(spark, sf_dir):
    """Encoded words, character sets, addresses, dates and ids."""
    return mime.messages(framed_mails(spark, sf_dir)).select("doc_id", "subject", "sender", "sender_name", "recipients", "cc", "message_id", F.col("date_utc").isNotNull().alias("dated"))


@query(_mail_sql({"subject": ("报销 ¶", "(无主题)", "files"), "sender": ("li.lei@¶.com", "¶@x.com", ""), "message_id": ("¶@corp.com", "", "")}))
def fetch_envelopes(spark, sf_dir):
    return mime.envelopes(framed_mails(spark, sf_dir)).select("doc_id", "subject", "sender", "message_id")


@query(_mail_sql({"body_text": ("§", "(此邮件无正文内容)", "§"), "has_attachments": (False, False, True)}))
def mime_bodies(spark, sf_dir):
    return mime.messages(framed_mails(spark, sf_dir)).select("doc_id", "body_text", "has_attachments")


@query(f"""WITH {OWN_SQL} SELECT doc_id, n AS part_index, {filled_sql('name')} AS filename, kind AS content_type, CAST(size AS BIGINT) AS size_bytes, {filled_sql('cid')} AS content_id, inl AS is_inline, size <= 3 AS downloaded FROM own, (VALUES
  (1, '报', 'application/pdf', 3, NULL, FALSE), (2, '报¶.bin', 'application/octet-stream', 4, NULL, FALSE), (3, 'inline_¶@x.png', 'image/png', 3, '¶@x', TRUE)) v(n, name, kind, size, cid, inl) WHERE doc_id % 3 = 2""")
def mime_attachments(spark, sf_dir):
    """Named and inline parts, and the policy on their size."""
    rows = mime.messages(framed_mails(spark, sf_dir), most=3).select("doc_id", F.explode("attachments").alias("a"))
    return rows.select("doc_id", "a.part_index", "a.filename", "a.content_type", "a.size_bytes", "a.content_id", "a.is_inline", "a.downloaded")


_STRUCTURE = '1 (UID 7 BODYSTRUCTURE ((("text" "plain" ("charset" "utf-8") NIL NIL "base64" 120 3 NIL NIL NIL)("text" "html" NIL NIL NIL "7bit" 400 9) "alternative")("application" "pdf" ("name" "¶.pdf") NIL NIL "base64" 99999999 NIL ("attachment" ("filename" "x.pdf"))) "mixed"))'


def _structures(spark, sf_dir):
    return own(spark, sf_dir).select("doc_id", F.encode(filled(F.lit(_STRUCTURE)), "utf-8").alias("s")).withColumn("parts", mime.body_structure("s"))


@query(f"""WITH {OWN_SQL} SELECT doc_id, section, content_type, encoding, CAST(size AS BIGINT) AS size, {filled_sql('filename')} AS filename, disposition FROM own, (VALUES
  ('1.1', 'text/plain', 'BASE64', 120, '', ''), ('1.2', 'text/html', '7BIT', 400, '', ''), ('2', 'application/pdf', 'BASE64', 99999999, '¶.pdf', 'attachment')) v(section, content_type, encoding, size, filename, disposition)""")
def fetch_bodystructure(spark, sf_dir):
    return _structures(spark, sf_dir).select("doc_id", F.explode("parts").alias("p")).select("doc_id", "p.section", "p.content_type", "p.encoding", "p.size", "p.filename", "p.disposition")


@query(f"WITH {OWN_SQL} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'full' ELSE 'partial' END AS plan, ['1.1', '1.2'] AS sections, [word || '.pdf'] AS left_out FROM own")
def plan_fetch(spark, sf_dir):
    """Whether a message is fetched whole, which text sections else, and which attachments are then left out."""
    size = F.when(F.col("doc_id") % 2 == 0, 1000).otherwise(10**9)
    names = F.transform(mime.parts_not_fetched("parts"), lambda a: a["filename"])
    return _structures(spark, sf_dir).select("doc_id", mime.fetch_plan(size, F.col("parts")).alias("plan"), mime.text_sections("parts").alias("sections"), names.alias("left_out"))
