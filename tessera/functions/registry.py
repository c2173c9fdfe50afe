"""The functions that SQL can call: UDFs over batches, table functions and an aggregate."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessera.functions import embedding, html
from tessera.functions.chunking import packed, tokens_of, units_of
from tessera.operators import table_functions


class Chunks:
    """chunks(text): chunk_index, text, token_count."""

    def eval(self, text: str):
        for i, t in enumerate(packed(units_of(text))):
            yield i, t, tokens_of(t)


def register(spark: SparkSession, embedder: str = "hashing") -> None:
    """chunks (a table function), html_to_markdown, html_to_text, clean_html and embed_text (UDFs over batches), and what
    operators.table_functions has: bm25 over tables, index_tokens, and the aggregate rrf."""
    spark.udtf.register("chunks", udtf(Chunks, returnType="chunk_index int, text string, token_count int"))
    spark.udf.register("html_to_markdown", html.batched(html.to_markdown))
    spark.udf.register("html_to_text", html.batched(html.to_text))
    spark.udf.register("clean_html", html.batched(lambda x: html.written(html.cleaned(x))))
    spark.udf.register("embed_text", embedding.embedder(embedding.backend(embedder)))
    table_functions.register(spark)
