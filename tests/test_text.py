from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import chunking, cleaning, embedding, html, text
from tessera.functions.cleaning import CleanPolicy
from tessera.functions.chunking import ChunkPolicy


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given_", "want"), [("邮件abc", "邮 件 abc"), ("报告2024 Q1", "报 告 2024 Q1"), ("", ""), ("abc def", "abc def"), ("a报b", "a 报 b")])
def test_segment(spark, given_, want):
    assert one(spark, text.segment_cjk(F.lit(given_))) == want


def test_sizes_and_durations(spark):
    sizes = [one(spark, text.human_size(F.lit(n))) for n in (0, 512, 2048, 5 * 1024**2, 3 * 1024**3)]
    assert sizes == ["0B", "512B", "2.0KB", "5.0MB", "3.0GB"]
    halves = [one(spark, text.human_size(F.lit(n))) for n in (5 * 2**18, 7 * 2**18, 1280, 1792, 1075, 1076, 2**20 - 1, 5 * 2**28, None)]
    assert halves == ["1.2MB", "1.8MB", "1.2KB", "1.8KB", "1.0KB", "1.1KB", "1024.0KB", "1.2GB", None]
    assert [one(spark, text.duration(F.lit(s))) for s in (5, 65, 3661)] == ["0:05", "1:05", "1:01:01"]


@pytest.mark.parametrize(("name", "want"), [("", "untitled"), ("...", "untitled"), ("CON.txt", "_CON.txt"), ("季度财报Q1.xlsx", "季度财报Q1.xlsx"), ("a/b:c*d", "a_b_c_d"), ("  x \t y . ", "x _ y"), (None, "untitled")])
def test_safe_names(spark, name, want):
    assert one(spark, text.safe_filename(F.lit(name).cast("string"))) == want


@given(st.text(alphabet="aé报🙂 ", max_size=40), st.integers(1, 30))
@settings(max_examples=30, deadline=None)
def test_byte_prefix(spark, value, most):
    want = value.encode()[:most].decode("utf-8", "ignore")
    assert one(spark, text.byte_prefix(F.lit(value), most)) == want


def test_paths(spark):
    assert one(spark, text.safe_path(F.array(F.lit("客户/2024/发票")))) == "客户/2024/发票"
    assert one(spark, text.safe_path(F.array(F.lit("../.."), F.lit("a\\b")))) == "a/b"
    assert one(spark, text.safe_path(F.array().cast("array<string>"))) == "INBOX"
    digest = "ab" + "c" * 62
    assert one(spark, text.blob_path(F.lit(digest))) == f"blobs/ab/cc/{digest}" and one(spark, text.blob_path(F.lit("x"))) is None


def test_estimates_agree(spark):
    for t in ("", "hello world", "报销发票", "café 2024!!", "\n\n"):
        assert one(spark, text.estimate_tokens(F.lit(t))) == chunking.tokens_of(t)


def test_redaction(spark):
    out = one(spark, text.redact(F.lit("Authorization: Bearer abcdefghijk password='x y' token=abc; s3cret1 " + "a1" * 13), ("s3cret1",)))
    assert "abcdefghijk" not in out and "token=***REDACTED***" in out and "s3cret1" not in out and "a1a1" not in out
    assert one(spark, text.log_line(F.lit("a\nb" * 200), 10)).startswith("a ba ba ba") and one(spark, text.log_line(F.lit(None).cast("string"))) == ""
    assert one(spark, text.clip(F.lit("x" * 200), 10)) == "x" * 9 + "…"


@pytest.mark.parametrize(("given_", "want"), [("é" + "Ab1" * 9 + "报", "é" + text.HIDDEN + "报"), ("报token: x", "报token=" + text.HIDDEN), ("éBearer abcdefgh1", "éBearer " + text.HIDDEN), ("ſpa\u017f\u017fword=abc", "ſpa\u017f\u017fword=" + text.HIDDEN), ("token\x0b=abc", "token\x0b=abc"), ("token=a\x0bb", "token=" + text.HIDDEN), ("my_token=a", "my_token=a")])
def test_redaction_beside_other_scripts(spark, given_, want):
    assert one(spark, text.redact(F.lit(given_))) == want


def test_rounding_keeps_the_sign_of_zero(spark):
    from math import copysign

    got = one(spark, F.transform(F.array(*map(F.lit, (-4e-7, 4e-7, -0.0, 0.0, 2.5e-6, -2.5e-6, 1.0000005))), lambda x: embedding.rounded(x, 6)))
    assert got == [0.0, 0.0, 0.0, 0.0, 3e-6, -3e-6, 1.000001 if 1.0000005 * 1e6 >= 1000000.5 else 1.0]
    assert [copysign(1, x) for x in got[:4]] == [-1, 1, -1, 1]


def test_addresses_and_headers(spark):
    assert [one(spark, text.mask_address(F.lit(a))) for a in ("abc@d.e", "ab@d.e", "nothing")] == ["ab***@d.e", "a***@d.e", "***"]
    assert one(spark, text.bare_address(F.lit("Li <Li@X.com>"))) == "li@x.com" and one(spark, text.display_name(F.lit('"Li" <Li@X.com>'))) == "Li"
    assert one(spark, text.bare_subject(F.lit("Re: 转发: Fwd: plan"))) == "plan"
    assert one(spark, text.message_id(F.lit(" <a@b> "))) == "a@b"
    assert str(one(spark, text.mail_date(F.lit("Fri, 01 Mar 2024 10:00:00 +0800")))) == "2024-03-01 02:00:00"
    assert one(spark, text.mail_date(F.lit("no date"))) is None


def test_snippets(spark):
    long = "x " * 200 + "needle" + " y" * 200
    out = one(spark, text.snippet(F.lit(long), ["nothing", "needle"], 50))
    assert "needle" in out and out[0] == out[-1] == "…" and len(out) <= 52
    assert one(spark, text.snippet(F.lit(long), ["absent"], 50)) == ("x " * 25).rstrip() + "…"
    assert one(spark, text.snippet(F.lit("a \n b"), ["b"])) == "a b"


def test_noise(spark):
    strip = lambda t, p=CleanPolicy(): one(spark, cleaning.strip_noise(F.lit(t), p))
    assert strip("hello\nworld\n-- \nJohn\n555") == "hello\nworld"
    assert strip("hello\n发自我的iPhone") == "hello"
    assert strip("one\nTHIS MESSAGE and any attachments are confidential") == "one\nTHIS MESSAGE and any attachments are confidential".split("\n")[0]
    assert strip("-- \nall of it") == "-- \nall of it".replace("-- ", "--")
    long = "\n".join(["-- "] + [f"line {i}" for i in range(60)])
    assert "line 59" in strip(long)
    history = "answer\n\nOn Monday Li wrote:\n> quoted\nFrom: a\nTo: b"
    assert "quoted" in strip(history) and strip(history, CleanPolicy(quoted_history=True)) == "answer"
    assert strip("a\n=====\nb\n\n\n\nc") == "a\nb\n\nc" and strip(" \n ") == ""


def test_markdown(spark):
    assert one(spark, cleaning.normalize_markdown(F.lit("a  \r\nb\n\n\n\nc\n| --- | :-: |\n[]( )![]()"))) == "a\nb\n\nc"
    assert one(spark, cleaning.normalize_markdown(F.lit("x\n| a | | |\ny"))) == "x\n| a |\ny"
    assert one(spark, cleaning.dedupe_paragraphs(F.lit("a b\n\nc\n\na  b\n\nd"))) == "a b\n\nc\n\nd"
    assert one(spark, cleaning.markdown_to_plain(F.lit("# T\n> > q [l](u) ![i](s) **b** zj\\_x@y.z"))) == "T\nq l   b zj_x@y.z".replace("   ", " ")


def body(spark, plain, markdown, subject=""):
    return one(spark, cleaning.compose_body(F.lit(plain), F.lit(markdown).cast("string"), F.lit(subject)))


def test_bodies(spark):
    assert body(spark, "plain\n\n\ntext", None)["plain"] == "plain\n\ntext"
    assert body(spark, "plain", "# Html")["markdown"] == "# Html"
    forwarded = "keep this short start\n-- \n**发件人：**Li**主题：**Plan for spring the whole text of the body that must not get lost at all"
    assert "must not get lost" in body(spark, "", forwarded, "Re: Plan for spring")["plain"]
    assert one(spark, cleaning.mostly_lost(F.lit("x" * 39), F.lit(""))) is False and one(spark, cleaning.mostly_lost(F.lit("x" * 100), F.lit("x" * 29))) is True


HTML = """<html><head><title>t</title></head><body><script>bad()</script><style>p{}</style><!-- c --><p onclick="x()">Hello <b>world</b></p>
<div style="display:none">hidden</div><img src="http://t/pixel.gif"><img src="a.png" width="1" height="1"><img src="cid:one@x" alt="pic"><img src="cid:two">
<table><tr><td>layout <table><tr><td>in</td></tr></table></td></tr></table><table><tr><th>a</th><th>b</th><th>c</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>
<ul><li>x</li><li>y</li></ul><a href="http://l">link</a></body></html>"""


def test_html_tree():
    out = html.written(html.cleaned(HTML, {"one@x": "attachments/one.png"}))
    for gone in ("bad()", "hidden", "onclick", "pixel.gif", "a.png", "cid:", "<!--", "title"):
        assert gone not in out
    assert "attachments/one.png" in out and out.count("<table>") == 1 and "layout" in out and "in" in out
    md = html.to_markdown(HTML, {"one@x": "attachments/one.png"})
    for part in ("Hello **world**", "- x\n- y", "[link](http://l)", "![pic](attachments/one.png)", "| a | b | c |", "| 1 | 2 | 3 |"):
        assert part in md
    assert "| layout" not in md
    assert html.to_text("a<br>b<p>c</p>d&nbsp;e") == "a\nbc\nd e"
    assert html.to_markdown("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html.to_markdown(None) == "" and html.to_text("") == ""


def test_html_columns(spark):
    rows = spark.createDataFrame([(HTML,), (None,), ("",)], "h string")
    assert [bool(r[0]) for r in rows.select(html.html_to_markdown("h")).collect()] == [True, False, False]
    plain = one(spark, cleaning.html_to_text_regex(F.lit(HTML)))
    assert "bad()" not in plain and "Hello world" in plain
    clean = one(spark, cleaning.clean_html_regex(F.lit(HTML)))
    assert "onclick" not in clean and "<script" not in clean and 'data-removed="1"' in clean


units = st.lists(st.text(alphabet="ab cd报。. ", min_size=1, max_size=60).map(str.strip).filter(bool), max_size=40)


@given(units, st.integers(50, 120), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_packing_keeps_units(parts, size, overlap):
    out = chunking.packed(parts, ChunkPolicy(size, overlap))
    assert len(out) <= len(parts) + 1
    joined = "\n".join(out)
    lost = [u for u in parts if u not in joined]
    assert not lost or chunking.tokens_of("\n\n".join(lost)) < 16 + max(map(chunking.tokens_of, lost)) or set(lost) <= {parts[-1]}
    assert all(chunking.tokens_of(c) <= size * 1.6 + overlap + 40 for c in out)


def test_chunks(spark):
    paragraph = "This is one sentence of a paragraph that says something. " * 3
    own = spark.createDataFrame([(1, "m1", "\n\n".join(f"{i} {paragraph}" for i in range(60))), (2, "m2", ""), (3, "m3", None), (4, "m4", "short")], "message_pk long, message_id string, body_text string")
    rows = chunking.chunks(own).collect()
    mine = [r for r in rows if r["message_pk"] == 1]
    assert [r["chunk_index"] for r in mine] == list(range(len(mine))) and sum(300 <= r["token_count"] <= 500 for r in mine) > len(mine) / 2
    assert {r["message_pk"] for r in rows} == {1, 4}
    import hashlib

    assert mine[1]["content_hash"] == hashlib.sha256(f"m1|1|{mine[1]['text']}".encode()).hexdigest()
    with pytest.raises(ValueError):
        ChunkPolicy(50, 50)
    assert one(spark, chunking.units(F.lit("a. b! 好。吗？" + "x" * 450))) == ["a.", "b!", "好。", "吗？", "x" * 200, "x" * 200, "x" * 50]


def test_embeddings(spark):
    v = embedding.hashed("the quick brown fox 报销", 128)
    assert len(v) == 128 and abs(sum(x * x for x in v) - 1) < 1e-9 and v == embedding.hashed("The quick brown fox 报销", 128)
    assert embedding.hashed("", 64) == [0.0] * 64
    assert embedding.unpack_vector(embedding.pack_vector([0.5, -2.0])) == [0.5, -2.0]
    out = spark.createDataFrame([("a b",), (None,)], "t string").select(embedding.embed("t", embedding.backend("auto")).alias("v")).collect()
    assert len(out[0]["v"]) == 512 and set(out[1]["v"]) == {0.0}
    assert one(spark, embedding.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, embedding.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0)))) == 3.0
    assert one(spark, embedding.embedding_text(F.lit("s"), F.lit("t"))) == "s\nt" and one(spark, embedding.embedding_text(F.lit("(无主题)"), F.lit("t"))) == "t"


@pytest.mark.parametrize("value", ["", " a　", "\x1c a \x1c\n", "a  ", "x \n\n\n\n y\r\n| |\n--- \n*b* \\* [c](d) ![e](f)", "| a |  |\t|\n[]( )\xa0", "# h\n> q\n\ta  b_c_`d`", None])
def test_guarded_expressions_give_what_the_plain_ones_give(spark, value):
    c = F.lit(value).cast("string")
    assert one(spark, text.stripped(c)) == one(spark, F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    for name, rule in cleaning.MARKS.items():
        assert one(spark, text.replaced(c, *rule, *cleaning.SIGNS[name])) == one(spark, F.regexp_replace(c, *rule))
    assert chunking.units_of(value) == one(spark, chunking.units(c))


def test_what_has_a_vector_is_not_embedded(spark):
    from tessera.operators import incremental

    def embed(texts):
        assert not any("known" in t for t in texts)
        return [[float(len(t))] for t in texts]

    fresh = spark.createDataFrame([(1, "s", "known", "h1"), (2, "s", "other", "h2"), (3, "s", None, "h3")], "message_pk long, subject string, text string, embed_hash string")
    old = spark.createDataFrame([(1, "h1", [7.0], "m"), (2, "h2", [8.0], "another model")], "message_pk long, embed_hash string, embedding array<float>, model string")
    got = incremental.with_vectors(fresh, old, embedding.Backend("m", embed, 1))
    assert {r["message_pk"]: (r["embedding"], r["reused"]) for r in got.collect()} == {1: ([7.0], True), 2: ([7.0], False), 3: ([0.0], False)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
