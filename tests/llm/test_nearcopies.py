"""Near copies of the pipeline against brute force over all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from llm_help import docs_of, lower
from tessera.llm import nearcopies, simhash


def brute_set(text):
    words = lower(text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(sets):
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if group[i] != group[j] and alike(a, b):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def edited_rows():
    """Copies edited in so many words that some are over 0.8 and some under, chains of edits, and texts that share half."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for n in (30, 60, 120, 400):
        base = [word() for _ in range(n)]
        texts.append(base)
        for k in range(1, 10):
            own = list(base)
            for at in r.sample(range(n), max(1, n * k // 250)):
                own[at] = word()
            texts.append(own)
        texts += [base[: n // 2] + [word() for _ in range(n // 2)] for _ in range(3)]
        for _ in range(6):
            texts.append([*texts[-1][n // 20 :], *[word() for _ in range(n // 20)]])
    return [(i, " ".join(x)) for i, x in enumerate(texts)]


def test_stage_removes_edited_copies(spark):
    rows = edited_rows()
    group = brute_groups([brute_set(t) for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {i for (i,) in docs_of(corpus_pipeline.near_stage(spark, docs, ""), "doc_id")}
    assert kept == set(group) and 10 < len(kept) < len(rows) - 10
    by_simhash = {i for (i,) in docs_of(simhash.near_duplicates(docs).where("doc_id = component_id"), "doc_id")}
    assert len(kept) < len(by_simhash)


def test_stage_links_by_simhash(spark):
    """Texts of one fingerprint are copies, though their sets of shingles are far apart: most of either is one line, repeated."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    line = " ".join(word() for _ in range(11))
    tail = lambda: " ".join(word() for _ in range(100))
    rows = [(4, " ".join([line] * 200 + [tail()])), (2, " ".join([line] * 200 + [tail()])), (9, tail()), (None, " ".join([line] * 200 + [tail()]))]
    assert not alike(brute_set(rows[0][1]), brute_set(rows[1][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(docs_of(corpus_pipeline.near_stage(spark, docs, ""), "doc_id", "text"), key=repr) == sorted(rows[1:], key=repr)


def test_repeated_doc_ids(spark):
    """A unique text stays though its doc_id has a near copy too; of repeated rows one stays; without doc_id all stay."""
    (_, base), (_, other), (_, third) = [edited_rows()[i] for i in (0, 19, 38)]
    copy = base + " more"
    rows = [(1, base), (1, base), (5, copy), (5, other), (7, third), (7, third), (7, third), (None, base), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(docs_of(corpus_pipeline.near_stage(spark, docs, ""), "doc_id", "text"), key=repr) == sorted([(1, base), (5, other), (7, third), (None, base), (None, base)], key=repr)


def test_messy_rows(spark, messy, empty):
    docs = messy.select("doc_id", "text").where("doc_id is not null").dropDuplicates()
    rows = docs_of(docs, "doc_id", "text")
    found = docs_of(nearcopies.near_copies(docs, ["doc_id"]), "doc_id", "component")
    assert len(found) == len(rows) and nearcopies.near_copies(empty, ["doc_id"]).collect() == []
    rows = [r for r in rows if r[0] != 2]  # two texts under one id
    group = dict(zip((i for i, _ in rows), brute_groups([brute_set(t) for _, t in rows]), strict=True))
    component = dict(found)
    assert all((component[a] == component[b]) == (group[a] == group[b]) for a in group for b in group)


def test_crowds_lose_no_link(spark, monkeypatch):
    """Sets that are dropped as too much alone have no partner: the groups are those of all pairs, also where every bucket is
    a crowd and where few bits mark the texts."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(60):
        own = list(base)
        for at in r.sample(range(80), r.choice([0, 1, 1, 2, 2, 3, 5, 8])):
            own[at] = word()
        texts.append(own[: 80 - r.choice([0, 0, 5, 12])])
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    group = brute_groups([brute_set(t) for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for crowd, marks in ((1000, 1 << 27), (2, 1 << 27), (2, 1 << 15)):
        monkeypatch.setattr(nearcopies, "CROWD", crowd)
        monkeypatch.setattr(nearcopies, "MARKS", marks)
        found = dict(docs_of(nearcopies.near_copies(docs, ["doc_id"]), "doc_id", "component"))
        assert all((found[a] == found[b]) == (group[a] == group[b]) for a in range(60) for b in range(60))
