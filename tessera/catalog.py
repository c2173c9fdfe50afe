"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import archive, archive_runs, relations, retrieval, rules, texts

PARTS = (retrieval.CATALOG, texts.CATALOG, archive.CATALOG, rules.CATALOG, relations.CATALOG, archive_runs.CATALOG)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for part in PARTS for k, v in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.sql.items()}
