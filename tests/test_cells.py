"""The store of cells: exact when all are probed, nearly so with few, kept up by changes, reading no other folders."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.cell_store import CellStore
from tessera.operators.vector_store import vector_store

ROWS = "chunk_id long, model string, message_pk long, embedding array<float>"


def grouped(n: int, groups: int = 20, dim: int = 12) -> list[tuple]:
    r = np.random.default_rng(5)
    centres = r.normal(size=(groups, dim)) * 4
    return [(i, "m" if i % 4 else "other", i * 10, [float(x) for x in np.float32(centres[i % groups] + r.normal(size=dim))]) for i in range(n)]


def brute(rows: list[tuple], query: list[float], k: int, test=lambda r: True) -> list[tuple]:
    own = [(r[0], float(np.dot(np.array(r[3][: len(query)], float), np.array(query[: len(r[3])], float)))) for r in rows if r[3] is not None and test(r)]
    return [(i, round(s, 6)) for i, s in sorted(own, key=lambda x: (-x[1], x[0]))[:k]]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [*grouped(2000), (5000, "m", 1, None), (5001, "m", 1, [1.0] * 3), (5002, "m", 1, [0.0] * 12)]
    own = vector_store(spark, str(tmp_path_factory.mktemp("cells") / "s"), "cells")
    own.upsert(spark.createDataFrame(rows, ROWS).repartition(3))
    return own, rows


def asked(spark, rows):
    return spark.createDataFrame([(r[0], r[3]) for r in rows], "query_id long, embedding array<float>")


def test_all_cells_are_an_exact_search(spark, stored):
    own, rows = stored
    assert own.count() == 2002 and own.count("other") == 500 and len(own.centres()) == 45
    got: dict[int, list] = {}
    for r in own.queries(asked(spark, rows[:40]), 7, 45).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 6)))
    assert got == {r[0]: brute(rows, r[3], 7) for r in rows[:40]}
    assert [(r["chunk_id"], round(r["score"], 6)) for r in own.query(rows[3][3], 9, probes=45).collect()] == brute(rows, rows[3][3], 9)


def test_few_cells_have_most_of_it_where_vectors_lie_in_groups(spark, stored):
    own, rows = stored
    assert own.probes() <= 12
    r = own.recall(asked(spark, rows[:100]), 20).agg(F.sum("found"), F.sum("there"), F.count("*")).first()
    assert r[2] == 100 and r[1] == 2000 and r[0] >= 0.9 * r[1]


def test_only_probed_folders_are_read(spark, stored):
    own, rows = stored
    one = own.query(rows[0][3], 5, probes=2)
    one.collect()
    scans = one._jdf.queryExecution().executedPlan().toString()
    filters = scans.partition("PartitionFilters: [")[2].partition("], PushedFilters")[0]
    assert "part" in filters and sum(f"{c:05d}" in filters for c in range(45)) == 2


def test_conditions_that_few_rows_pass_reach_further(spark, stored):
    own, rows = stored
    got = own.query(rows[8][3], 6, model="other", where=F.col("message_pk") % 7 == 0, probes=1)
    want = brute(rows, rows[8][3], 6, lambda r: r[1] == "other" and r[2] % 7 == 0)
    assert got.count() == 6 and len({r["chunk_id"] for r in got.collect()} & {i for i, _ in want}) >= 3
    few = own.queries(asked(spark, rows[:3]), 500, 1)
    assert {r["n"] for r in few.groupBy("query_id").agg(F.count("*").alias("n")).collect()} == {500}


def test_changes(spark, tmp_path):
    rows = grouped(600)
    own = CellStore(spark, str(tmp_path / "s"), cells=8)
    assert own.count() == 0 and own.query([1.0] * 12, 3).collect() == [] and own.queries(asked(spark, rows[:2]), 3).collect() == []
    own.upsert(spark.createDataFrame(rows, ROWS))
    moved = [(r[0], r[1], r[2], [-x for x in r[3]]) for r in rows[::5]]
    own.upsert(spark.createDataFrame(moved, ROWS))
    own.delete(spark.createDataFrame([(i,) for i in range(0, 600, 7)], "chunk_id long"))
    now = [r for r in {**{r[0]: r for r in rows}, **{r[0]: r for r in moved}}.values() if r[0] % 7]
    assert own.count() == len(now)
    r = random.Random(1)
    for q in r.sample(now, 5):
        assert [(x["chunk_id"], round(x["score"], 6)) for x in own.query(q[3], 10, probes=8).collect()] == brute(now, q[3], 10)
    before = own.sizes().agg(F.sum("n"), F.count("*")).first()
    assert tuple(before) == (len(now), 8)
    assert own.train() == 8 and own.count() == len(now) and 1 <= own.tune(0.5) <= own.tune(1.0) <= 8
    own.reset()
    assert own.count() == 0 and len(own.centres()) == 0
    own.upsert(spark.createDataFrame(rows[:3], ROWS))
    assert own.count() == 3
