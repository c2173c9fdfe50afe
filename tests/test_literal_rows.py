"""Every case of literal_rows.py."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
duckdb = pytest.importorskip("duckdb")

import literal_rows  # noqa: E402


def plain(value):
    return round(value, 9) + 0.0 if isinstance(value, float) else [plain(v) for v in value] if isinstance(value, (list, tuple)) else str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(literal_rows.CATALOG.queries))
def test_case(spark, name):
    df = literal_rows.CATALOG.queries[name](spark, "")
    columns = sorted(df.columns)
    want = duckdb.sql(literal_rows.CATALOG.sql[name])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr) == sorted(([plain(r[i]) for i in order] for r in want.fetchall()), key=repr)
