"""Each stage of the pipeline against a brute-force version, on a small corpus with every kind of case in it."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from llm_help import docs_of
from pyspark.sql import functions as F
from test_operators import brute_contamination, brute_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(4)
    word = lambda: "".join(r.choice(["ta", "re", "mi", "so", "lu", "ne", "ko"]) for _ in range(r.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(25)
    rows = [(i, f"{prose(60)}.\nShared line of all sites\n{prose(40)}.", "en", f"s{i % 12}") for i in range(80)]
    rows += [(100 + i, "BUY!! NOW!! $$$ %%% " * (10 + i), "en", "s1") for i in range(30)]
    base = prose(400)
    rows += [(200, base, "en", "s1"), (201, base, "en", "s2"), (202, base + " more", "en", "s3"), (300, f"{prose(30)} {item} {prose(30)}", "en", "s1"), (301, None, "en", "s1"), (302, "", "en", None)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*x, len(x[1] or ""), 7) for x in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in [*range(60), *range(100, 120)]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(12))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, corpus):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    before, stages = docs, []
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, corpus)
        stages.append((docs_of(before, "doc_id", "text", "source"), after))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert after.columns == docs.columns
            before = spark.createDataFrame(after.collect(), docs.schema)

    kept = {x[0] for x in docs_of(stages[0][1], "doc_id")}
    assert kept.isdisjoint(range(100, 130)) and set(range(80)) <= kept and {200, 201, 202, 300} <= kept

    sites = defaultdict(set)
    for _, text, source in stages[1][0]:
        for line in (text or "").split("\n"):
            sites[line].add(source)
    common = {x for x, s in sites.items() if x.strip() and len(s) >= 10}
    assert common == {"Shared line of all sites"}
    first = {x: min(i for i, t, _ in stages[1][0] if x in (t or "").split("\n")) for x in common}
    for i, text, n in docs_of(stages[1][1], "doc_id", "text", "n_chars"):
        given = next(t for j, t, _ in stages[1][0] if j == i)
        want = None if given is None else "\n".join(x for x in given.split("\n") if x not in common or first[x] == i)
        assert text == want and n == (None if want is None else len(want))

    prints = {i: brute_simhash(t) for i, t, _ in stages[2][0]}
    group = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[a] == group[b] for a in prints for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3):
            break
    assert sorted(i for (i,) in docs_of(stages[2][1], "doc_id")) == sorted(i for i in prints if group[i] == i)
    assert 201 not in {i for (i,) in docs_of(stages[2][1], "doc_id")}

    hits = {r[0] for r in brute_contamination([(i, t) for i, t, _ in stages[3][0]], docs_of(spark.read.parquet(f"{corpus}/benchmark.parquet"), "item_id", "text")) if r[5]}
    assert hits == {300}
    assert sorted(i for (i,) in docs_of(stages[3][1], "doc_id")) == sorted(i for i, _, _ in stages[3][0] if i not in hits)

    pieces = stages[4][1].collect()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append((p["start"], np.frombuffer(bytes(p["ids"]), "<u4").tolist(), p["doc_tokens"]))
    from tokenizers import Tokenizer
    import public_tokenizers

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text, _ in stages[4][0]:
        joined = [x for _, ids, _ in sorted(by_doc[i]) for x in ids]
        assert joined == [*lib.encode(text or "", add_special_tokens=False).ids, 1] and {n for *_, n in by_doc[i]} == {len(joined)}


def test_run_is_the_stages_one_after_another(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert set(out.columns) == {"doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"}
    ids = {r[0] for r in out.select("doc_id").distinct().collect()}
    assert 300 not in ids and 201 not in ids and 200 in ids and 105 not in ids
    assert out.agg(F.sum("length")).first()[0] == sum(r[0] for r in out.where("start = 0").select("doc_tokens").collect())


def test_empty_tables(spark, corpus, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    from tessera.llm import queries

    assert len(queries.QUERIES) == 10 and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
