"""Full-text retrieval: postings with positions, phrases and prefixes, BM25 over the whole index."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import CJK, FOLD_FROM, FOLD_TO, tokens
from tessera.operators.match import Phrase

K1, B = 1.2, 0.75
#: The weight of a phrase that more than half of the rows have.
LEAST_IDF = 1e-6


def token_columns(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, cols (array of struct col, tokens), len (tokens of all columns)."""
    own = docs.select(F.col(key).alias("doc_id"), F.array(*[F.struct(F.lit(c).alias("col"), tokens(c).alias("tokens")) for c in columns]).alias("cols"))
    return own.withColumn("len", F.aggregate("cols", F.lit(0), lambda n, c: n + F.size(c["tokens"])))


_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_CJK = re.compile("([" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), CJK) + "])")
_PRIVATE = "\ue000-\uf8ff\U000f0000-\U000ffffd\U00100000-\U0010fffd"
_WORD = re.compile(rf"[^\W_]|[{_PRIVATE}]")
_ASCII = bytes(i if chr(i).isascii() and chr(i).isalnum() else 32 for i in range(256))


class _Tokens(dict):
    """What each character of a lower-cased text becomes, for str.translate: found out once a character."""

    def __missing__(self, code: int) -> int | str:
        c = chr(code).translate(_FOLD)
        self[code] = 32 if not _WORD.match(c) else f" {c} " if _CJK.match(c) else ord(c)
        return self[code]


_TOKENS = _Tokens()


def token_list(text: str | None) -> list[str]:
    """The tokens of functions.text.tokens."""
    low = (text or "").lower()
    return (low.encode().translate(_ASCII).decode() if low.isascii() else low.translate(_TOKENS)).split()


def token_line(text: str | None) -> str:
    """The same, parted by spaces."""
    return " ".join(token_list(text))


def token_lines(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """doc_id, len (tokens of all columns), lines (of each column the tokens, parted by spaces). As token_columns(), at a
    fraction of its time where many texts have letters with marks."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, lens = [], []
            for row in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                own = [token_list(t) for t in row]
                lines.append([" ".join(t) for t in own])
                lens.append(sum(map(len, own)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int32()), pa.array(lines, pa.list_(pa.string()))], names=["doc_id", "len", "lines"])

    return own.mapInArrow(run, "doc_id long, len int, lines array<string>")


def build_postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """doc_id, col, pos, term, len: one row a token. Written sorted by term, it is an index that prunes by statistics."""
    own = token_columns(docs, key, columns)
    return own.select("doc_id", "len", F.explode("cols").alias("c")).select("doc_id", F.col("c.col").alias("col"), "len", F.posexplode("c.tokens").alias("pos", "term"))


def write_index(docs: DataFrame, key: str, columns: list[str], path: str, partitions: int = 64) -> None:
    """The postings and each row's length as Parquet, postings range-partitioned and sorted by term."""
    build_postings(docs, key, columns).repartitionByRange(partitions, "term").sortWithinPartitions("term", "doc_id", "pos").write.parquet(f"{path}/postings")
    token_columns(docs, key, columns).select("doc_id", "len").write.parquet(f"{path}/lengths")


def _slots(plan: list[list[Phrase]]) -> Column:
    """Every token that the plan asks for: variant, phrase, slot in the phrase, of how many, and whether it may go on."""
    rows = [(v, p, s, len(ph.tokens), t, ph.prefix and s == len(ph.tokens) - 1) for v, phrases in enumerate(plan) for p, ph in enumerate(phrases) for s, t in enumerate(ph.tokens)]
    names = ("variant", "phrase", "slot", "size", "token", "prefix")
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows])


def _wanted(term: Column, slots: Column) -> Column:
    return F.filter(slots, lambda s: (s["token"] == term) | (s["prefix"] & term.startswith(s["token"])))


def _occurrences(postings: DataFrame, plan: list[list[Phrase]]) -> DataFrame:
    """doc_id, len, col, variant, phrase: a row each time a phrase occurs within one column."""
    hits = postings.select("doc_id", "len", "col", "pos", F.explode(_wanted(F.col("term"), _slots(plan))).alias("s"))
    placed = hits.select("doc_id", "len", "col", "s.variant", "s.phrase", "s.size", "s.slot", (F.col("pos") - F.col("s.slot")).alias("begin"))
    if all(len(p.tokens) == 1 for phrases in plan for p in phrases):
        return placed
    whole = placed.groupBy("doc_id", "len", "col", "variant", "phrase", "size", "begin").agg(F.count_distinct("slot").alias("n")).where("n = size")
    return whole.drop("n")


def _scored(found: DataFrame, facts: DataFrame, plan: list[list[Phrase]], column: str | None) -> DataFrame:
    if column is not None:
        found = found.where(F.col("col") == column)
    tf = found.groupBy("doc_id", "len", "variant", "phrase").agg(F.count("*").alias("tf"))
    df = tf.groupBy("variant", "phrase").agg(F.count("*").alias("df"))
    counts = F.create_map(*[F.lit(x) for v, p in enumerate(plan) for x in (v, len(p))])
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf > 0, idf).otherwise(LEAST_IDF)
    gain = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    # df has a row a phrase of the plan and facts has one row
    joined = tf.join(F.broadcast(df), ["variant", "phrase"]).join(F.broadcast(facts))
    all_of = joined.groupBy("variant", "doc_id").agg(F.sum(-gain).alias("score"), F.count("*").alias("phrases"))
    return all_of.where(F.col("phrases") == F.element_at(counts, F.col("variant"))).drop("phrases")


def keyword_hits(docs: DataFrame, key: str, columns: list[str], plan: list[list[Phrase]], column: str | None = None) -> DataFrame:
    """variant, doc_id, score (lower is better) of the rows that have all phrases of a variant, within `column` if given.
    Statistics are over all rows of docs, whatever is filtered later. Tokens that the plan does not ask for never leave
    the scan's stage. An empty plan finds nothing."""
    if not plan or not all(plan):
        return docs.sparkSession.createDataFrame([], "variant int, doc_id long, score double")
    asked = _asked(plan)
    places = F.flatten(F.transform("cols", lambda c: F.filter(F.transform(c["tokens"], lambda t, i: F.when(asked(t), F.struct(c["col"].alias("col"), i.alias("pos"), t.alias("term")))), lambda p: p.isNotNull())))
    # Texts are read once: what is left of a row, dealt by its key, serves the statistics and the hits, whose sums need it
    # so. Both uses must ask for the same columns of the same rows to share it: the count names the places, and the outer
    # explode keeps the optimizer from filtering rows by them before they are dealt.
    own = token_columns(docs, key, columns).select("doc_id", "len", places.alias("places")).repartition("doc_id")
    facts = own.agg(F.count_if(F.size("places") >= 0).alias("n"), F.avg("len").alias("avgdl"))
    postings = own.select("doc_id", "len", F.explode_outer("places").alias("p")).where("p is not null").select("doc_id", "len", "p.*")
    return _scored(_occurrences(postings, plan), facts, plan, column)


def _asked(plan: list[list[Phrase]]):
    """Whether any phrase asks for a term: a function of a term's column."""
    slots = asked_terms(plan)
    whole, begun = sorted(t for t, prefix in slots if not prefix), sorted(t for t, prefix in slots if prefix)
    tests = [lambda c, x=x: c.startswith(x) for x in begun] + ([lambda c: c.isin(whole)] if whole else [])
    return lambda c: reduce(operator.or_, [t(c) for t in tests])


def index_hits(postings: DataFrame, lengths: DataFrame, plan: list[list[Phrase]], column: str | None = None) -> DataFrame:
    """keyword_hits() over a written index: only the row groups of the plan's terms are read."""
    if not plan or not all(plan):
        return postings.sparkSession.createDataFrame([], "variant int, doc_id long, score double")
    facts = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    return _scored(_occurrences(postings.where(_asked(plan)(F.col("term"))), plan), facts, plan, column)


def asked_terms(plan: list[list[Phrase]]) -> set[tuple[str, bool]]:
    """The plan's terms, and whether each may go on."""
    return {(t, p.prefix and i == len(p.tokens) - 1) for phrases in plan for p in phrases for i, t in enumerate(p.tokens)}


def scored_hits(postings: DataFrame, n: int, length: int, plan: list[list[Phrase]], column: str | None = None) -> DataFrame:
    """keyword_hits() over postings of n rows that have `length` tokens together."""
    facts = postings.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(length / n if n else 0.0).alias("avgdl"))
    return _scored(_occurrences(postings.where(_asked(plan)(F.col("term"))), plan), facts, plan, column)
