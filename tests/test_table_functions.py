"""Functions over tables and aggregates that SQL can call."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.registry import register
from tessera.operators import match
from tessera.operators.match import Phrase
from tessera.operators.postings import keyword_hits
from tessera.operators.table_functions import bm25_statement, facts_statement, occurrences, tokens_of

TEXTS = [
    "The licence of the GNU project", "gnu gnu gnus; licensed under the GNU general terms", "", None, "Œuvre ÉCOLE école naïve", "报销流程 and 报销 2024", "x" * 5000 + " gnu " + "licensed " * 300,
    "snake_case a-b z ½ İstanbul Straße ǅ", "licensed", "gnu", "licensed gnu", "licensed gnu", "it's 'quoted' \\ gnu licensed",
]


def _rows(spark):
    return spark.createDataFrame([(i, t, None if i % 3 == 0 else f"src{i}", i / 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, weight double")


def _scores(frame):
    return sorted((r["doc_id"], round(r["score"], 9)) for r in frame.collect())


def test_tokens_are_those_of_the_index(spark):
    register(spark)
    for r in _rows(spark).select("text", text.tokens("text").alias("t"), F.expr("index_tokens(text)").alias("sql")).collect():
        assert tokens_of(r["text"]) == list(r["t"]) == list(r["sql"]), r["text"]


def test_occurrences():
    words = "a b a b ab a b".split()
    assert occurrences(words, Phrase(("a", "b"), False)) == 3 and occurrences(words, Phrase(("a",), True)) == 4
    assert occurrences(words, Phrase(("b", "a"), True)) == 2 and occurrences([], Phrase(("a",), False)) == 0


@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("query", ["licensed gnu", "报销", "gnu", "école", "nowhere", "it's", "gnu 报销流程", "流程 lic"])
def test_bm25_of_a_table(spark, query, prefix):
    """Over several partitions, some of them empty, it is the search that the library has."""
    register(spark)
    rows = _rows(spark).repartition(7)
    rows.createOrReplaceTempView("some_rows")
    plan = match.strict(query, prefix)
    want = _scores(keyword_hits(rows, "doc_id", ["text", "source"], [plan]))
    assert _scores(spark.sql(bm25_statement("some_rows", query, ["text", "source"], prefix))) == want
    only = _scores(keyword_hits(rows, "doc_id", ["text"], [plan]))
    found = spark.sql(bm25_statement("SELECT weight, doc_id, text FROM some_rows", query, ["text"], prefix))
    assert _scores(found) == only and found.columns == ["weight", "doc_id", "text", "score"]


def test_bm25_of_no_rows_and_wrong_calls(spark):
    register(spark)
    _rows(spark).createOrReplaceTempView("some_rows")
    assert spark.sql(bm25_statement("SELECT * FROM some_rows WHERE doc_id < 0", "gnu", ["text"])).count() == 0
    assert spark.sql(bm25_statement("some_rows", "; ,", ["text"])).count() == 0
    for relation, columns, reason in [("SELECT *, 1 AS Score FROM some_rows", ["text"], "score"), ("some_rows", ["weight"], "columns of texts")]:
        with pytest.raises(AnalysisException, match=reason):
            spark.sql(bm25_statement(relation, "gnu", columns)).count()
    for arguments, reason in [("'some_rows', 'gnu', map(-2, 1L)", "TABLE"), ("TABLE(some_rows), 'gnu', 5", "map")]:
        with pytest.raises(AnalysisException, match=reason):
            spark.sql(f"SELECT * FROM bm25({arguments})").count()


def test_columns_are_all_texts_unless_named(spark):
    register(spark)
    _rows(spark).createOrReplaceTempView("some_rows")
    facts = "(" + facts_statement("some_rows", "gnu", ["text", "source"]) + ")"
    assert _scores(spark.sql(f"SELECT * FROM bm25(TABLE(some_rows), 'gnu', {facts})")) == _scores(spark.sql(bm25_statement("some_rows", "gnu", ["text", "source"])))


def test_facts_stay_out_of_python_and_rows_out_of_shuffles(spark, tmp_path):
    """The scan that counts reads the searched columns alone; the one that finds deals no rows out anew."""
    register(spark)
    _rows(spark).write.parquet(str(tmp_path / "t"))
    spark.read.parquet(str(tmp_path / "t")).createOrReplaceTempView("stored_rows")
    plan = spark.sql(facts_statement("stored_rows", "gnu", ["text"]))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<text:string>" in plan and "Python" not in plan
    plan = spark.sql("SELECT * FROM bm25(TABLE(stored_rows), 'gnu', map(-2, 5L, -1, 9L, 0, 1L))")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPythonUDTF" in plan and "Exchange" not in plan


def test_rrf_aggregate(spark):
    register(spark)
    rows = [("a", 1, 1.0), ("a", 3, 0.5), ("b", 2, 1.0), ("b", None, 1.0), ("c", 1, 0.0), ("c", 1, None), ("d", 1, -1.0)]
    spark.createDataFrame(rows, "k string, rank int, weight double").createOrReplaceTempView("ranked")
    got = {r[0]: r[1] for r in spark.sql("SELECT k, rrf(rank, weight) AS s FROM ranked GROUP BY k").collect()}
    assert got == pytest.approx({"a": 1 / 61 + 0.5 / 63, "b": 1 / 62, "c": 0.0, "d": 0.0})


def test_functions_over_batches(spark):
    register(spark)
    rows = spark.createDataFrame([("<b>x</b>",), (None,), ("",)], "h string").repartition(1)
    rows.createOrReplaceTempView("html_rows")
    got = spark.sql("SELECT html_to_markdown(h) m, html_to_text(h) t, clean_html(h) c, size(embed_text(h)) n FROM html_rows").collect()
    assert sorted(r["m"] for r in got) == ["", "", "**x**"] and {r["n"] for r in got} == {512} and sorted(r["t"] for r in got) == ["", "", "x"]
    plan = rows.select(F.expr("html_to_markdown(h)"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
