"""Every query of the library runs on the smallest tables, and equals its SQL."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from tessera import catalog

duckdb = pytest.importorskip("duckdb")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return float(value) if type(value).__name__ == "Decimal" else str(value) if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name in catalog.oracle_sql():
        want = db.sql(catalog.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(([plain(r[i]) for i in order] for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
