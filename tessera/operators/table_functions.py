"""Functions over tables for SQL: BM25 of a table's rows, which a query names as an argument, and reciprocal rank fusion.

    SELECT * FROM bm25(TABLE(documents), 'licensed gnu', (SELECT map(-2, count(*), …) FROM documents), columns => 'text')

bm25_statement() writes this. The statistics of the table are an aggregate of built-in functions, two numbers and one a phrase;
the table function then sees each partition by itself, so no row is shuffled. The texts are read twice; KeywordIndex reads none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.functions.text import CJK, FOLD_FROM, FOLD_TO
from tessera.operators.match import Phrase, strict
from tessera.operators.postings import K1, LEAST_IDF, B

#: Keys of a table's facts beside the phrases, which are numbered from 0: its rows, and their tokens.
ROWS, TOKENS = -2, -1
RRF_K = 60

_FOLDS = str.maketrans(FOLD_FROM, FOLD_TO)
_CJK = re.compile("([" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), CJK) + "])")
_ASCII = re.compile("[a-z0-9]+")
_RUN = re.compile("(?:[^\\W_]|[\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd])+")


def tokens_of(text: str | None) -> list[str]:
    """What functions.text.tokens gives for a text."""
    low = (text or "").lower()
    return _ASCII.findall(low) if low.isascii() else _RUN.findall(_CJK.sub(r" \1 ", low.translate(_FOLDS)))


def occurrences(tokens: list[str], phrase: Phrase) -> int:
    """How often a phrase begins in a text's tokens."""
    *whole, last = phrase.tokens
    if not whole:
        return sum(t.startswith(last) for t in tokens) if phrase.prefix else tokens.count(last)
    n, found = len(whole), 0
    for i in range(len(tokens) - n):
        if tokens[i] == whole[0] and tokens[i : i + n] == whole:
            found += tokens[i + n].startswith(last) if phrase.prefix else tokens[i + n] == last
    return found


def _texts(table: StructType, columns: str | None) -> list[str]:
    """The columns to search: those named, else all of texts."""
    own = [f.name for f in table.fields if isinstance(f.dataType, StringType)]
    wanted = [c.strip() for c in columns.split(",")] if columns else own
    if not wanted or not set(wanted) <= set(own):
        raise ValueError(f"the table's columns of texts are {own}, not {wanted}")
    return wanted


class Bm25:
    """bm25(table, query, facts, columns, prefix): the table's columns and score (lower is better) of the rows that have all
    phrases of the query in the columns (none named: in all of texts). facts: those of the rows that count for the statistics."""

    def __init__(self):
        self.plan: list[Phrase] | None = None

    @staticmethod
    def analyze(table: AnalyzeArgument, query: AnalyzeArgument, facts: AnalyzeArgument, columns: AnalyzeArgument | None = None, prefix: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument is a table: TABLE(name) or TABLE(SELECT …)")
        if not query.isConstantExpression:
            raise ValueError("the query is a constant")
        if not isinstance(facts.dataType, MapType):
            raise ValueError("facts is a map, as bm25_statement() has it")
        if "score" in (f.name.lower() for f in table.dataType.fields):
            raise ValueError("the table has a column score of its own: TABLE(SELECT …) names it anew")
        _texts(table.dataType, columns.value if columns else None)
        return AnalyzeResult(StructType([*table.dataType.fields]).add("score", DoubleType(), False))

    def eval(self, table: Row, query: str, facts: dict[int, int], columns: str | None = None, prefix: bool | None = None) -> Iterator[tuple]:
        if self.plan is None:
            self.plan = strict(query, prefix is not False)
            self.names = [c.strip() for c in columns.split(",")] if columns else None
        own = [tokens_of(table[c]) for c in self.names] if self.names else [tokens_of(x) for x in table if isinstance(x, str)]
        length, found = sum(map(len, own)), [sum(occurrences(t, p) for t in own) for p in self.plan]
        if found and all(found):
            n, mean = facts[ROWS], facts[TOKENS] / facts[ROWS]
            score = 0.0
            for i, tf in enumerate(found):
                idf = math.log((n - facts[i] + 0.5) / (facts[i] + 0.5))
                score -= (idf if idf > 0 else LEAST_IDF) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            yield *table, score


@F.arrow_udf(DoubleType())
def rrf(rank: pa.Array, weight: pa.Array) -> float:
    """rrf(rank, weight): what a row's ranks in some channels are worth together. A group has as many rows as there are
    channels. Null ranks and weights of 0 or less count for nothing."""
    return sum(w / (RRF_K + r) for r, w in zip(rank.to_pylist(), weight.to_pylist(), strict=True) if r is not None and w is not None and w > 0)


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _has(phrase: Phrase) -> str:
    """Whether any column's tokens t of c have the phrase."""
    *whole, last = map(_quoted, phrase.tokens)
    n = len(whole)
    at = f"startswith(t[i + {n}], {last})" if phrase.prefix else f"t[i + {n}] = {last}"
    if n:
        return f"exists(c, t -> size(t) > {n} AND exists(sequence(0, greatest(size(t) - {n + 1}, 0)), i -> slice(t, i + 1, {n}) = array({', '.join(whole)}) AND {at}))"
    return f"exists(c, t -> exists(t, w -> startswith(w, {last})))" if phrase.prefix else f"exists(c, t -> array_contains(t, {last}))"


def facts_statement(relation: str, query: str, columns: list[str], prefix: bool = True) -> str:
    """The SQL of a relation's facts for a query: rows, tokens and rows with each phrase, as a map."""
    own = f"SELECT array({', '.join(f'index_tokens(`{c}`)' for c in columns)}) AS c FROM ({relation if ' ' in relation else f'SELECT * FROM {relation}'})"
    counts = "".join(f", {i}, count_if({_has(p)})" for i, p in enumerate(strict(query, prefix)))
    return f"SELECT map({ROWS}, count(*), {TOKENS}, coalesce(sum(aggregate(c, 0L, (n, t) -> n + size(t))), 0L){counts}) FROM ({own})"


def bm25_statement(relation: str, query: str, columns: list[str], prefix: bool = True) -> str:
    """The SQL that searches columns of a relation (a name, or a SELECT): all its columns, and score."""
    facts = facts_statement(relation, query, columns, prefix)
    return f"SELECT * FROM bm25(TABLE({relation}), {_quoted(query)}, facts => ({facts}), columns => {_quoted(', '.join(columns))}, prefix => {str(prefix).lower()})"


def register(spark: SparkSession) -> None:
    """bm25 (a table function over tables), index_tokens (SQL's own form of functions.text.tokens) and rrf (an aggregate)."""
    low, folded = "lower(coalesce(t, ''))", f"translate(lower(coalesce(t, '')), '{FOLD_FROM}', '{FOLD_TO}')"
    spaced = f"if({low} RLIKE r'[^\\x00-\\x7f]', regexp_replace({folded}, r'([{CJK}])', ' $1 '), {low})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION index_tokens(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all({spaced}, r'[\\p{{L}}\\p{{N}}\\p{{Co}}]+', 0)")
    spark.udtf.register("bm25", F.udtf(Bm25))
    spark.udf.register("rrf", rrf)
