from __future__ import annotations

import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.text import segment_cjk
from tessera.operators import match, search, vectors
from tessera.operators.filters import Filters, all_terms, condition
from tessera.operators.keyword_index import KeywordIndex
from tessera.operators.match import Phrase
from tessera.operators.postings import build_postings, index_hits, keyword_hits, token_columns, write_index

ROWS = [
    (1, "Invoice march", "please pay the invoice for march, invoice 2024"),
    (2, "发票报销流程", "报销发票需要填写表格，invoice attached"),
    (3, "Server plan", "server expansion and the pay plan; the the the"),
    (4, "", "expense: 发票 已经 报销"),
    (5, "Résumé café", "the café pays the invoices of MARCH"),
    (6, "empty", ""),
    (7, "the", "the the the invoice"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, subject string, body string").repartition(2)


@pytest.fixture(scope="module")
def fts(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(subject, body, tokenize=\"unicode61 remove_diacritics 2\")")
    segmented = spark.createDataFrame(ROWS, "id long, subject string, body string").select("id", segment_cjk("subject"), segment_cjk("body")).collect()
    db.executemany("INSERT INTO f(rowid, subject, body) VALUES (?, ?, ?)", [tuple(r) for r in segmented])
    return db


def expression(phrases, column=None):
    text = " AND ".join('"' + " ".join(p.tokens) + '"' + ("*" if p.prefix else "") for p in phrases)
    return f"{column} : ({text})" if column else text


@pytest.mark.parametrize(
    ("phrases", "column"),
    [
        ([Phrase(("invoice",), False)], None),
        ([Phrase(("inv",), True)], None),
        ([Phrase(("the",), False)], None),
        ([Phrase(("发", "票"), False)], None),
        ([Phrase(("invoice",), False), Phrase(("pay",), True)], None),
        ([Phrase(("pay", "the", "inv"), True)], None),
        ([Phrase(("invoice",), False)], "subject"),
        ([Phrase(("the", "the"), False)], "body"),
        ([Phrase(("cafe",), False)], None),
        ([Phrase(("nowhere",), False)], None),
    ],
)
def test_bm25_equals_fts5(docs, fts, phrases, column):
    want = {r[0]: r[1] for r in fts.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (expression(phrases, column),))}
    got = {r["doc_id"]: r["score"] for r in keyword_hits(docs, "id", ["subject", "body"], [phrases], column).collect()}
    assert got == pytest.approx(want, abs=1e-9)


def test_written_index_gives_the_same(docs, spark, tmp_path):
    write_index(docs, "id", ["subject", "body"], str(tmp_path / "i"), 3)
    plan = [[Phrase(("发", "票"), False), Phrase(("inv",), True)], [Phrase(("the", "invoice"), True)]]
    own = index_hits(spark.read.parquet(str(tmp_path / "i/postings")), spark.read.parquet(str(tmp_path / "i/lengths")), plan)
    key = lambda rows: sorted((r["variant"], r["doc_id"], round(r["score"], 9)) for r in rows)
    assert key(own.collect()) == key(keyword_hits(docs, "id", ["subject", "body"], plan).collect()) != []
    assert build_postings(docs, "id", ["subject"]).count() == sum(len(match.index_tokens(r[1])) for r in ROWS)


def test_match_plans():
    assert match.strict("发票 报销") == [Phrase(("发", "票"), False), Phrase(("报", "销"), False)]
    assert match.strict("invoi") == [Phrase(("invoi",), True)]
    assert match.strict("mail corp.com") == [Phrase(("mail",), True), Phrase(("corp", "com"), True)]
    assert match.variants("，，。") == [] and match.variants(None) == []
    assert len(match.variants("invoice")) == 1
    relaxed = match.variants("报销发票怎么弄")
    assert [Phrase(tuple("报销发票"), False)] in relaxed and relaxed[-1] == [Phrase(("报", "销"), False)]
    assert len(match.variants("一二三四五六七八九十甲乙丙丁戊")) == 8
    assert match.variants("报销发票 ok 流程")[1] == [Phrase(("报", "销", "发"), False), Phrase(("流", "程"), False)]
    assert match.strict("报告2024") == [Phrase(("报", "告", "2024"), False)]


@given(st.text(alphabet="ab1 é报告-.", max_size=12))
@settings(max_examples=40, deadline=None)
def test_query_tokens_are_index_tokens(spark, text):
    from tessera.functions.text import tokens

    own = spark.range(1).select(tokens(F.lit(text)).alias("t")).first()["t"]
    assert own == match.index_tokens(text)


def message(pk, **over):
    base = {"message_pk": pk, "account": "a", "folder": "INBOX", "message_id": f"m{pk}", "subject": f"subject {pk}", "sender": "x@corp.com", "sender_name": "Xu", "recipients": "me@corp.com", "cc": "", "body_text": "nothing", "date_utc": f"2024-03-{pk:02d} 00:00:00", "size_bytes": 1, "has_attachments": False, "deleted_at": None, "local_markdown_path": f"{pk}.md", "uid": str(pk)}
    return base | over


SCHEMA = "message_pk long, account string, folder string, message_id string, subject string, sender string, sender_name string, recipients string, cc string, body_text string, date_utc string, size_bytes long, has_attachments boolean, deleted_at string, local_markdown_path string, uid string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("date_utc", F.to_timestamp("date_utc")).withColumn("deleted_at", F.to_timestamp("deleted_at"))


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, message_pk long, chunk_index int, text string, subject string, sender string, embedding array<float>")


@pytest.fixture(scope="module")
def mails(spark):
    return frame(
        spark,
        [
            message(1, subject="budget talk", body_text="numbers"),
            message(2, sender="budget@corp.com", body_text="other"),
            message(3, recipients="budget@corp.com", body_text="third"),
            message(4, cc="budget@corp.com", body_text="fourth"),
            message(5, body_text="the budget is here", folder="Sent"),
            message(6, body_text="budget gone", deleted_at="2024-04-01 00:00:00"),
            message(7, sender_name="Budget Team", body_text="x"),
        ],
    )


@pytest.mark.parametrize(("scope", "want"), [("subject", {1}), ("sender", {2}), ("recipient", {3}), ("cc", {4}), ("body", {5})])
def test_field_scopes_do_not_leak(mails, scope, want):
    assert {r["message_pk"] for r in search.field_search(mails, "budget", scope).collect()} == want


def test_sender_names_are_found_as_substrings(mails):
    assert {r["message_pk"] for r in search.field_search(mails, "udget tea", "sender").collect()} == {7}


def test_keyword_channel_prefers_chunks_and_falls_back(spark, mails):
    chunks = chunk_frame(spark, [(50, 5, 0, "the budget is here", "subject 5", "x", None), (60, 6, 0, "budget gone", "s", "x", None)])
    hits = search.keyword_channel(mails, chunks, "budget").collect()
    assert [(h["granularity"], h["id"]) for h in hits] == [("chunk", 50)]  # chunk hits stand before message hits
    none = search.keyword_channel(mails, chunks, "udge").collect()
    assert {h["message_pk"] for h in none} == {1, 5} and {h["score"] for h in none} == {0.0}
    assert [h["message_pk"] for h in none] == [5, 1]  # the newest first
    assert search.keyword_channel(mails, chunks, "量子").collect() == []


def test_relaxed_variants_find_what_strict_ones_do_not(spark):
    rows = frame(spark, [message(1, body_text="请先报销发票。"), message(2, body_text="会议纪要")])
    hits = search.keyword_channel(rows, None, "报销发票怎么弄").collect()
    assert [h["message_pk"] for h in hits] == [1]


def test_filters(mails):
    keys = lambda f: {r["message_pk"] for r in mails.where(condition(f)).collect()}
    assert keys(Filters()) == {1, 2, 3, 4, 5, 7}
    assert keys(Filters(include_deleted=True)) == {1, 2, 3, 4, 5, 6, 7}
    assert keys(Filters(folder=("Sent",))) == {5}
    assert keys(Filters(sender="BUDGET")) == {2, 7}
    assert keys(Filters(recipient="budget")) == {3, 4}
    from datetime import datetime

    assert keys(Filters(date_from=datetime(2024, 3, 2), date_to=datetime(2024, 3, 4))) == {2, 3, 4}
    assert not Filters(include_deleted=True).any() and Filters(has_attachments=False).any()
    assert {r["message_pk"] for r in mails.where(all_terms(["budget", "talk"], ["subject", "body_text"])).collect()} == {1}


def ranking(spark, ids):
    return spark.createDataFrame([(i, n, 0.0) for n, i in enumerate(ids, 1)], "id long, rank int, score double")


def test_rrf(spark):
    own = {"keyword": ranking(spark, [1, 2, 3]), "vector": ranking(spark, [1, 4])}
    fused = {r["id"]: r["fused"] for r in search.rrf(own, ["id"]).collect()}
    assert fused == pytest.approx({1: 2 / 61, 2: 1 / 62, 3: 1 / 63, 4: 1 / 62})
    assert {r["id"] for r in search.rrf(own, ["id"], weights={"vector": 0}).collect()} == {1, 2, 3}
    weighted = {r["id"]: r["fused"] for r in search.rrf(own, ["id"], weights={"vector": 2}).collect()}
    assert weighted[1] == pytest.approx(3 / 61)
    assert search.rrf(own, ["id"], weights={"vector": 0, "keyword": 0}).collect() == []


@given(st.lists(st.integers(1, 8), unique=True, max_size=6), st.lists(st.integers(1, 8), unique=True, max_size=6), st.integers(1, 80))
@settings(max_examples=10, deadline=None)
def test_rrf_is_the_sum_over_channels(spark, a, b, k):
    want = {i: sum(1 / (k + x.index(i) + 1) for x in (a, b) if i in x) for i in {*a, *b}}
    got = {r["id"]: r["fused"] for r in search.rrf({"a": ranking(spark, a), "b": ranking(spark, b)}, ["id"], k=k).collect()}
    assert got == pytest.approx(want)


def test_hybrid_and_hydrate(spark, mails):
    chunks = chunk_frame(spark, [(50, 5, 0, "the budget is here", "subject 5", "x", [1.0, 0.0]), (10, 1, 0, "numbers", "budget talk", "x", [0.0, 1.0]), (60, 6, 0, "budget gone", "s", "x", [1.0, 0.0])])
    hits = search.hybrid(mails, chunks, "budget", [1.0, 0.0], limit=2)
    rows = hits.collect()
    assert rows[0]["fused"] == pytest.approx(1 / 61 + 1 / 62)  # each is first in one channel; a tie goes to the keyword channel
    assert {r["message_pk"] for r in rows} == {5, 1}  # a deleted message has no hit though its chunk is near
    full = {r["message_pk"]: r for r in search.hydrate(hits, mails, chunks, "budget").collect()}
    assert full[5]["sender"] == "Xu <x@corp.com>" and "budget" in full[5]["snippet"]
    with pytest.raises(ValueError):
        search.hybrid(mails, chunks, "x", [1.0], mode="none")


def test_vectors(spark):
    own = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 5.0])], "vec_id long, embedding array<float>")
    top = [(r["vec_id"], round(r["score"], 6)) for r in vectors.top_k(own, [1.0, 0.0], 3).collect()]
    assert top == [(1, 1.0), (4, 1.0), (2, 0.6)]
    assert vectors.threshold(vectors.top_k(own, [1.0, 0.0], 4), 0.0, 0.5).count() == 3
    assert vectors.threshold(vectors.top_k(own, [1.0, 0.0], 4), 0.7).count() == 2
    flat = own.where("vec_id < 4")
    batch = vectors.batch_top_k(flat, flat.select(F.col("vec_id").alias("query_id"), "embedding"), 2).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in batch} == {(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 3), (3, 1, 3), (3, 2, 2)}


def test_batch_in_blocks(spark, monkeypatch):
    own = spark.range(40).select(F.col("id").alias("vec_id"), F.array(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)) / 1000).cast("float") for i in range(4)]).alias("embedding"))
    asked = own.withColumnRenamed("vec_id", "query_id")
    found = lambda: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in vectors.batch_top_k(own, asked, 3).collect())
    whole = found()
    monkeypatch.setattr(vectors, "MOST_QUERY_BYTES", 40 * 4 * 8 // 3)
    assert len(whole) == 120 and found() == whole


def test_calibration(spark):
    own = spark.createDataFrame([("relevant", 0.6), ("relevant", 0.5), ("irrelevant", 0.2), ("irrelevant", 0.3)], "kind string, score double")
    r = vectors.calibration(own).first()
    assert r["separable"] and r["suggested"] == pytest.approx(0.4) and r["lenient"] == pytest.approx(0.48)


def test_listing(mails):
    page = search.page(mails, limit=2, offset=1)
    assert [r["message_pk"] for r in page.collect()] == [5, 4] and page.first()["total"] == 6
    stats = {(r["folder"]): (r["total"], r["live"]) for r in search.folder_statistics(mails).collect()}
    assert stats == {"INBOX": (6, 5), "Sent": (1, 1)}
    assert search.resolve(mails, "<m3>").first()["message_pk"] == 3 and search.resolve(mails, "3").first()["message_pk"] == 3
    assert [r["message_pk"] for r in search.sort_rows(mails.where("message_pk in (1, 2)"), "subject", True).collect()] == [2, 1]


def test_index_is_kept_up(spark, tmp_path, docs):
    from tessera.operators.keyword_index import KeywordIndex

    index = KeywordIndex(spark, str(tmp_path / "k"), "id", ["subject", "body"])
    plan = [[Phrase(("invoice",), False)], [Phrase(("the", "inv"), True)], [Phrase(("pay",), False), Phrase(("m",), True)]]
    assert index.hits(plan).count() == 0 and index.counts() == (0, 0)

    def same(rows):
        own = spark.createDataFrame(rows, "id long, subject string, body string")
        want = {(r["variant"], r["doc_id"]): r["score"] for r in keyword_hits(own, "id", ["subject", "body"], plan).collect()}
        got = {(r["variant"], r["doc_id"]): r["score"] for r in index.hits(plan).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert index.counts()[0] == len(rows)

    index.add(docs)
    same(ROWS)
    changed = [(1, "nothing", "here now"), (8, "pay march", "the invoice, the inventory")]
    index.add(spark.createDataFrame(changed, "id long, subject string, body string"))
    now = [r for r in ROWS if r[0] != 1] + changed
    same(now)
    index.add(spark.createDataFrame([(8, "pay", "march")], "id long, subject string, body string"))
    index.remove(spark.createDataFrame([(3,), (99,)], "id long"))
    now = [r for r in now if r[0] not in (3, 8)] + [(8, "pay", "march")]
    same(now)
    assert not index.is_old() or index.counts()[0]
    index.add(docs, fresh=True)
    same(ROWS)
    assert not index.is_old()


def test_like_comes_only_after_the_index(spark, tmp_path):
    from tessera.operators.keyword_index import KeywordIndex

    rows = [(1, "Alpha", "a@x", "b@x", "one two", None), (2, "Beta", "a@x", "b@x", "xonex", None), (3, "one", "a@x", "b@x", "", "2024-01-01")]
    own = spark.createDataFrame(rows, "message_pk long, subject string, sender string, recipients string, body_text string, gone string").withColumns({"deleted_at": F.col("gone").cast("timestamp"), "date_utc": F.lit("2024-01-01").cast("timestamp"), "sender_name": F.lit(""), "cc": F.lit("")})
    index = KeywordIndex(spark, str(tmp_path / "k"), "message_pk", search.MESSAGE_COLUMNS)
    index.add(own)
    indexes = search.Indexes(messages=index)
    for query in ("one", "nex", "zzz", "two one"):
        a = [tuple(r) for r in search.keyword_channel(own, None, query, indexes=indexes).collect()]
        b = [tuple(r) for r in search.keyword_channel(own, None, query).collect()]
        assert a == b, query
    assert [r["message_pk"] for r in search.field_search(own, "one", "subject", indexes=indexes).collect()] == [r["message_pk"] for r in search.field_search(own, "one", "subject").collect()]


def test_tops_over_batches():
    import numpy as np

    r = np.random.default_rng(1)
    queries, rows = r.integers(-3, 4, (9, 5)).astype(float), r.integers(-3, 4, (400, 5)).astype(float)
    keys = r.permutation(400)
    for k, step in ((1, 7), (5, 1), (5, 400), (500, 33)):
        tops = vectors.Tops(queries, k)
        for i in range(0, 400, step):
            tops.offer(keys[i : i + step], rows[i : i + step])
        got = [(q, c, s) for q, c, s in zip(tops.rows.tolist(), tops.keys.tolist(), tops.scores.tolist(), strict=True)]
        want = [(q, c, -s) for q in range(9) for s, c in sorted((-float(queries[q] @ x), int(c)) for c, x in zip(keys, rows, strict=True))[:k]]
        assert got == want


def test_vector_store(spark, tmp_path):
    from tessera.operators.vector_store import register, vector_store

    def broken(spark, path):
        raise ImportError("not here")

    register("broken", broken)
    own = vector_store(spark, str(tmp_path / "v"))
    assert own.count() == 0 and own.query([1.0, 0.0], 3).count() == 0
    rows = lambda *x: spark.createDataFrame(x, "chunk_id long, model string, message_pk long, embedding array<float>")
    own.upsert(rows((1, "a", 1, [1.0, 0.0]), (2, "a", 1, [0.0, 1.0]), (2, "b", 1, [1.0, 1.0])))
    assert own.count() == 3 and own.count("a") == 2 and [r["chunk_id"] for r in own.query([0.0, 1.0], 1, "a").collect()] == [2]
    held = own.rows()
    assert own.rows() is held
    own.upsert(rows((1, "a", 1, [0.0, 2.0])))
    assert own.rows() is not held and [tuple(r) for r in own.query([0.0, 1.0], 1, "a").collect()] == [(1, 2.0)]
    own.delete(spark.createDataFrame([(2,), (9,)], "chunk_id long"))
    assert own.count() == 1 and own.query([1.0, 0.0], 5, where=F.col("message_pk") == 7).count() == 0
    own.reset()
    assert own.count() == 0
    with pytest.raises(ImportError):
        vector_store(spark, str(tmp_path / "w"), "broken")


@pytest.fixture(scope="module")
def pruned_index(spark, tmp_path_factory):
    """Rows of very unlike lengths; one word that two fifths have, some words that few have."""
    r = random.Random(8)
    rows = [(i, " ".join([f"w{r.randint(0, 300)}" for _ in range(r.choice([3, 10, 40, 200]))] + ["common"] * r.choice([0, 0, 0, 1, 2]) + ["comet"] * (i % 9 == 0) + ["rare"] * (i % 400 == 7)), f"head {i % 5}") for i in range(2500)]
    index = KeywordIndex(spark, str(tmp_path_factory.mktemp("pruned") / "i"), "id", ["body", "head"])
    index.add(spark.createDataFrame(rows, "id long, body string, head string").repartition(3), fresh=True)
    return index


PRUNED = [("common", False), ("common w7", False), ("com", True), ("rare", False), ("common rare", False), ("w1 w2 w3", True), ("nowhere", False), ("common nowhere", False)]


def same_top(index, text, prefix, n, allowed=None):
    plan = match.strict(text, prefix)
    full = index.hits([plan]).select("doc_id", "score")
    want = (full if allowed is None else full.join(allowed, "doc_id", "left_semi")).orderBy("score", "doc_id").limit(n).collect()
    rows, report = index.pruned(plan, n, allowed)
    assert [(i, round(s, 9)) for i, s in rows] == [(r["doc_id"], round(r["score"], 9)) for r in want], text
    assert [r["doc_id"] for r in index.top(plan, n, allowed).collect()] == [r["doc_id"] for r in want]
    return report


@pytest.mark.parametrize(("text", "prefix"), PRUNED)
def test_pruned_searches_equal_full_ones(pruned_index, text, prefix):
    for n in (1, 20):
        same_top(pruned_index, text, prefix, n)


def test_a_common_term_is_not_read_whole(pruned_index, spark):
    report = same_top(pruned_index, "common", False, 10)
    assert report["postings"] > 900 and report["read"] < 0.5 * report["postings"] and report["ranges_read"] < report["ranges"]
    few = spark.range(0, 2500, 83).select(F.col("id").alias("doc_id"))
    assert same_top(pruned_index, "common", False, 10, few)["read"] <= report["postings"]


def test_pruned_searches_after_changes(spark, tmp_path):
    """Several segments, rows that are gone or changed, and what is left after a vacuum."""
    rows = [(i, "common " * (i % 4) + f"w{i % 7} " * (i % 30), "h") for i in range(700)]
    index = KeywordIndex(spark, str(tmp_path / "i"), "id", ["body", "head"])
    frame = lambda own: spark.createDataFrame(own, "id long, body string, head string")
    index.add(frame(rows), fresh=True)
    index.add(frame([(i, "common thing", "h") for i in range(0, 700, 5)] + [(900, "common", "h")]))
    index.remove(spark.createDataFrame([(i,) for i in range(0, 700, 3)], "id long"))
    for text, prefix in (("common", False), ("w3", False), ("common w", True), ("thing", False)):
        same_top(index, text, prefix, 15)
    before = {tuple(r) for r in index.hits([match.strict("common")]).collect()}
    now = [(900, "common", "h"), *[(r[0], "common thing" if r[0] % 5 == 0 else r[1], "h") for r in rows if r[0] % 3]]
    index.add(frame(now), fresh=True)
    assert index.vacuum() == [1, 2, 3] and index.vacuum() == []
    assert len(list((tmp_path / "i" / "postings").glob("segment=*"))) == 1
    after = {tuple(r) for r in index.hits([match.strict("common")]).collect()}
    assert {(a, b, round(c, 9)) for a, b, c in before} == {(a, b, round(c, 9)) for a, b, c in after}
    same_top(index, "common", False, 15)
    index.remove(spark.createDataFrame([(r[0],) for r in now], "id long"))
    assert index.pruned(match.strict("common"), 5)[0] == []


def test_postings_of_like_rows_are_one(spark, tmp_path):
    """Rows of like length share their postings of a term: a row a term and range, not one a token; what it says is the same."""
    texts = ["Édition licensed under the licensed licence", "licensed 报销2024 under the İstanbul", "", None, "the the under_licensed xy ǅ ½", "a" * 50 + " licensed under the"]
    docs = spark.createDataFrame([(i, texts[i % 6], "src") for i in range(600)], "id long, text string, source string")
    index = KeywordIndex(spark, str(tmp_path / "i"), "id", ["text", "source"])
    index.add(docs)
    whole = token_columns(docs, "id", ["text", "source"])
    assert index.counts() == (600, whole.agg(F.sum("len")).first()[0])
    want = whole.select("doc_id", "len", F.explode("cols").alias("c")).select("doc_id", F.col("c.col").alias("col"), "len", F.posexplode("c.tokens").alias("pos", "term")).collect()
    rows = spark.read.parquet(str(tmp_path / "i/postings")).withColumn("segment", F.lit(1))
    assert sorted(map(tuple, index._occurrences(rows).select("doc_id", "col", "len", "pos", "term").collect())) == sorted(map(tuple, want))
    assert rows.count() < len(want) / 20
    plan = [[Phrase(("licensed", "under", "the"), False)], [Phrase(("licen",), True)]]
    assert sorted(map(repr, index.hits(plan).collect())) == sorted(map(repr, keyword_hits(docs, "id", ["text", "source"], plan).collect()))


def test_rare_terms_cost_rows_by_size(spark, tmp_path):
    """An index of words that one row has each keeps few rows of postings, and finds each word, its beginnings and phrases."""
    docs = spark.range(2000).select("id", F.concat_ws(" ", F.lit("every"), *[F.sha2(F.concat("id", F.lit(f"-{i}")), 256) for i in range(5)], F.lit("゛Ωµ")).alias("text"), (F.col("id") * -(1 << 52)).alias("key"))
    index = KeywordIndex(spark, str(tmp_path / "i"), "key", ["text"])
    index.add(docs)
    assert spark.read.parquet(str(tmp_path / "i/postings")).count() < 2000
    word, other = docs.where("id = 77").select(F.split("text", " ")[3], F.split("text", " ")[4]).first()
    plan = [[Phrase((word,), False)], [Phrase((word, other), False)], [Phrase((other, word), False)], [Phrase((word[:9],), True)], [Phrase(("every",), False)]]
    found = sorted(map(repr, index.hits(plan).collect()))
    assert found == sorted(map(repr, keyword_hits(docs, "key", ["text"], plan).collect())) and len(found) == 3 + 2000
    same_top(index, f"every {word}", False, 3)
