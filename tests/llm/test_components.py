"""Connected components end when all edges lead straight to their component."""

from __future__ import annotations

import random

import pytest

from tessera.llm import components


@pytest.mark.parametrize("edges, rounds", [([(1, 5), (2, 5), (5, 2)], None), ([(7, 1), (8, 1), (9, 1), (6, 2)], 0), ([], 0), ([(3, 2), (2, 1)], 1)])
def test_no_round_follows_the_last(spark, monkeypatch, edges, rounds):
    made = []
    monkeypatch.setattr(components, "checkpointed", lambda df, own=components.checkpointed: made.append(1) or own(df))
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == by_hand(edges)
    assert rounds is None or len(made) == rounds + 1  # the edges themselves, and a table a round


def test_random_graphs(spark):
    r = random.Random(5)
    for n, m in ((12, 8), (40, 30), (60, 200)):
        edges = [(r.randrange(-n, n), r.randrange(-n, n)) for _ in range(m)] + [(i, i + 1) for i in range(100, 117)]
        rows = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert len(rows) == len({r["node"] for r in rows}) and {r["node"]: r["component"] for r in rows} == by_hand(edges)


def by_hand(edges):
    at = {x: x for e in edges for x in e}
    for _ in at:
        for u, v in edges:
            at[u] = at[v] = min(at[u], at[v])
    return {x: c for x, c in at.items() if x != c}
