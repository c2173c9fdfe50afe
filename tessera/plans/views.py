"""The driver's tables seen as an archive: documents are messages, embeddings their vectors; in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.keyword_index import KeywordIndex
from tessera.sources.scratch import fresh_path
from tessera.sources.tables import read as table

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries by name, with their SQL where SQL can express them."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages. A label of quality 0 stands for a deletion, any label for an index run, a toxic one for a
    change after it."""
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    return d.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("message_pk"), F.col("lang").alias("account"), F.col("source").alias("folder"), F.lit(1).cast("long").alias("uidvalidity"), F.col("doc_id").cast("string").alias("uid"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("@corpus")).alias("message_id"), F.get(F.split("text", "\n"), F.lit(0)).alias("subject"), F.concat("source", F.lit("@example.com")).alias("sender"),
        F.upper("lang").alias("sender_name"), F.concat("lang", F.lit("@example.org")).alias("recipients"), F.lit("").alias("cc"), F.col("text").alias("body_text"), F.col("n_chars").alias("size_bytes"), when.alias("date_utc"),
        (F.col("n_chars") > 2000).alias("has_attachments"), F.when(F.col("quality") == 0, when).alias("deleted_at"), F.when(F.col("toxic").isNotNull(), when).alias("indexed_at"),
        F.when(F.col("toxic") == 1, F.timestamp_seconds(F.lit(1704067260) + F.col("doc_id") * 3600)).otherwise(when).alias("updated_at"), F.lit(None).cast("long").alias("duplicate_of"),
        F.concat_ws("/", F.lit("archive"), F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("local_markdown_path"),
    )


MESSAGES = """messages AS (
  SELECT d.doc_id AS message_pk, lang AS account, source AS folder, CAST(1 AS BIGINT) AS uidvalidity, CAST(d.doc_id AS VARCHAR) AS uid,
    'doc-' || d.doc_id || '@corpus' AS message_id, string_split(text, chr(10))[1] AS subject, source || '@example.com' AS sender,
    upper(lang) AS sender_name, lang || '@example.org' AS recipients, '' AS cc, text AS body_text, n_chars AS size_bytes,
    make_timestamp((1704067200 + d.doc_id * 3600) * 1000000) AS date_utc, n_chars > 2000 AS has_attachments,
    CASE WHEN quality = 0 THEN make_timestamp((1704067200 + d.doc_id * 3600) * 1000000) END AS deleted_at,
    CASE WHEN toxic IS NOT NULL THEN make_timestamp((1704067200 + d.doc_id * 3600) * 1000000) END AS indexed_at,
    make_timestamp(((CASE WHEN toxic = 1 THEN 1704067260 ELSE 1704067200 END) + d.doc_id * 3600) * 1000000) AS updated_at,
    'archive/' || source || '/' || d.doc_id || '.md' AS local_markdown_path
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the vectors of the messages with the same number, one chunk each."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("message_pk"), F.lit(0).alias("chunk_index"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """A stored vector stands for an embedded query."""
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0]) if row else []


_WRITTEN: dict[tuple[str, str, str], KeywordIndex] = {}


def keyword_index(spark: SparkSession, sf_dir: str, name: str, key: str, columns: list[str], rows: Callable[[], DataFrame]) -> KeywordIndex:
    """The written index over columns of rows, as an archive keeps it: made when a session first asks for it."""
    place = spark.sparkContext.applicationId, sf_dir, name
    if place not in _WRITTEN:
        index = KeywordIndex(spark, fresh_path(spark, f"index-{name}"), key, columns)
        index.add(rows(), fresh=True)
        _WRITTEN[place] = index
    return _WRITTEN[place]


QUERY_VECTOR = "q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0)"


def tokens_sql(source: str, key: str, columns: list[str]) -> str:
    """CTEs tok, pos, len and facts of an index over columns of a relation."""
    parts = "\n  UNION ALL ".join(f"SELECT {key} AS doc_id, '{c}' AS col, regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+') AS t FROM {source}" for c in columns)
    return f"""tok AS ({parts}),
pos AS (SELECT doc_id, col, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM tok),
len AS (SELECT doc_id, sum(len(t)) AS len FROM tok GROUP BY doc_id),
facts AS (SELECT count(*) AS n, avg(len) AS avgdl FROM len)"""


def bm25_sql(plan: list[list], column: str | None = None) -> str:
    """CTE hits(variant, doc_id, score) after tokens_sql."""
    parts = []
    for v, phrases in enumerate(plan):
        for p, ph in enumerate(phrases):
            test = lambda i, t, ph=ph: f"starts_with(p{i}.term, '{t}')" if ph.prefix and i == len(ph.tokens) - 1 else f"p{i}.term = '{t}'"
            joins = " ".join(f"JOIN pos p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.col = p0.col AND p{i}.pos = p0.pos + {i} AND {test(i, t)}" for i, t in enumerate(ph.tokens) if i)
            where = test(0, ph.tokens[0]) + (f" AND p0.col = '{column}'" if column else "")
            parts.append(f"SELECT {v} AS variant, {p} AS phrase, p0.doc_id FROM pos p0 {joins} WHERE {where}")
    sizes = " ".join(f"WHEN {v} THEN {len(p)}" for v, p in enumerate(plan))
    return f"""occ AS ({" UNION ALL ".join(parts)}),
tf AS (SELECT variant, phrase, doc_id, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT variant, phrase, count(*) AS df FROM tf GROUP BY ALL),
hits AS (
  SELECT variant, doc_id, sum(-(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score
  FROM tf JOIN df USING (variant, phrase) JOIN len USING (doc_id), facts
  GROUP BY variant, doc_id HAVING count(*) = CASE variant {sizes} END)"""
