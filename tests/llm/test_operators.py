"""Each operator against a brute-force version over messy rows, rows with clashing columns, and no rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from llm_help import docs_of, lower, plain

from tessera.llm import common, decontaminate, linededup, packing, quality, simhash, substrings, tokencount, topk, toxicity, warc

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def held(rows, clash, none, run):
    """The rows of run(rows), which equal those with clashing columns; an empty table has none."""
    out = plain(run(rows).collect())
    assert plain(run(clash).collect()) == out
    assert run(none).collect() == []
    return out


def test_line_dedup(messy, clashing, empty):
    out = held(messy, clashing, empty, lambda d: linededup.line_dedup(d, min_sites=5))
    rows = docs_of(messy, "doc_id", "text", "source")
    sites, first = defaultdict(set), {}
    low = lambda i, p: (i is not None, i or 0, p)
    for i, t, s in rows:
        for p, raw in enumerate((t or "").split("\n") if t is not None else []):
            line = raw.strip(" \t\r")
            if line:
                sites[line] |= {s} - {None}
                first[line] = min(first.get(line, low(i, p)), low(i, p))
    want = []
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        gone = [p for p, raw in enumerate(lines) if (x := raw.strip(" \t\r")) and len(sites[x]) >= 5 and first[x] != low(i, p)]
        want.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone) if t is not None else None, len(lines), len(gone)))
    assert out == plain(want)
    assert any(r[3] for r in out)


def test_line_dedup_counts_near_lines_exactly(spark):
    rows = [(s * 1000 + i, f"line {i}", "en", f"site{s}", 1) for i in range(8, 14) for s in range(i)]
    out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), min_sites=10, lg_k=4)
    kept = {r["text"] for r in out.where("n_removed = 0").collect()}
    assert {r["doc_id"] % 1000 for r in out.where("n_removed > 0").collect()} == {10, 11, 12, 13}
    assert {"line 8", "line 9"} <= kept


def test_a_text_of_very_many_lines(spark):
    """Lines of one text are taken out in one pass over it."""
    rows = [(s, "\n".join(["shared by all", *(f"own {s} {i}" for i in range(100_000 if s == 3 else 2)), "shared by all"]), "en", f"site{s}", 1) for s in range(12)]
    begun = time.time()
    out = {r["doc_id"]: r for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert out[3]["n_lines"] == 100_002 and out[3]["n_removed"] == 2 and out[3]["text"] == "\n".join(f"own 3 {i}" for i in range(100_000))
    assert out[0]["n_removed"] == 1 and time.time() - begun < 60


def test_a_line_in_every_document(spark, monkeypatch):
    """Very common lines, near the threshold and over it, are dealt over tasks."""
    monkeypatch.setattr(linededup, "dealt", lambda *a: common.dealt(*a, hot=5))
    rows = [(i, f"on ten\non twelve {i % 5}\nown {i}\non nine" if i % 100 < 9 else f"on ten\nown {i}" if i % 100 < 10 else f"own {i}\non twelve {i % 5}", "en", f"s{i % 100}", 1) for i in range(1200) if i % 100 < 12]
    out = {r["doc_id"]: r["text"].split("\n") for r in linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), min_sites=10).collect()}
    lines, sites = Counter(x for own in out.values() for x in own), defaultdict(set)
    for _, text, _, site, _ in rows:
        for x in text.split("\n"):
            sites[x].add(site)
    assert lines["on ten"] == 1 and lines["on nine"] == sum("on nine" in r[1] for r in rows)
    assert all((lines[x] == 1) == (len(s) >= 10 or sum(x in r[1].split("\n") for r in rows) == 1) for x, s in sites.items())
    assert "on ten" in out[0] and all(f"own {i}" in out[i] for i in out)


def test_quality(messy, clashing, empty, labels, spark):
    out = held(messy, clashing, empty, lambda d: quality.quality_scores(d, labels))
    assert len(out) == messy.count()
    for doc, held_out, score, predicted in out:
        assert held_out == (doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1)
        assert 0 <= score <= 1 and predicted == int(score >= 0.5)
    none = quality.quality_scores(messy, labels.limit(0))
    assert {r["score"] for r in none.collect()} == {0.5}


def test_quality_learns_and_whole_texts_count(spark):
    good, bad = "plain words go on and on here, as they do. ", "BUY!! NOW!! $$$ %%% ### "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5), "en", "s", 1) for i in range(300)] + [(1000, good * 40, "en", "s", 1), (1001, bad * 40, "en", "s", 1), (1002, good * 2000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, docs.where("doc_id < 300").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))).collect()}
    assert out[1000] == 1 and out[1001] == 0 and out[1002] == 1
    assert np.mean([out[i] == i % 2 for i in range(300)]) > 0.98


def test_a_text_is_encoded_alike_in_any_company():
    from tessera.llm.common import utf8

    import pyarrow as pa

    texts = ["one two", "", "Shti Shti Shti " * 60, None, "x" * 1300, "é!"]
    together, first = quality.encode(*utf8(pa.array(texts)))
    ends = [*first[1:].tolist(), len(together)]
    for t, a, b in zip(texts, first, ends, strict=True):
        alone, _ = quality.encode(*utf8(pa.array([t], type=pa.string())))
        assert np.array_equal(alone, together[a:b])
    assert together.shape[1] == quality.FEATURES and together[first[2], -1] > 0.9


def test_long_texts_are_encoded_block_by_block(monkeypatch):
    from tessera.llm.common import utf8

    import pyarrow as pa

    texts = ["ab c" * 900, "", "x y " * 40, "Shti Sh" * 3000, None, "q" * 512, "w" * 1024, "é" * 1500]
    data, starts = utf8(pa.array(texts))
    whole, first = quality.encode(data, starts)
    for block in (1, 2, 3, 7, 2048):
        monkeypatch.setattr(quality, "BLOCK", block)
        parts = list(quality.encoded(data, starts))
        assert [i for i, _ in parts] == sorted(i for i, _ in parts) and max(len(x) for _, x in parts) <= block
        ends = [*first[1:].tolist(), len(whole)]
        for i in range(len(texts)):
            own, want = np.concatenate([x for j, x in parts if j == i]), whole[first[i] : ends[i]]
            assert np.array_equal(own, want)


def test_scores_equal_plain_loops():
    """The forward pass, on given weights, by its definition, passage by passage."""
    import math

    import pyarrow as pa

    model = quality.AttentionMIL(quality.FEATURES)
    texts = ["Some words, " * 200, "", None, "x", "BUY!! now $$$ " * 90]
    for text, score in zip(texts, quality.score_texts(pa.array(texts), model), strict=True):
        raw = (text or "").encode()
        rows = []
        for a in range(0, max(1, len(raw)), quality.PASSAGE):
            p = raw[a : a + quality.PASSAGE]
            after = [*raw[a + 1 : a + len(p) + 1], 0][: len(p)]
            row, half = [0.0] * quality.FEATURES, quality.BINS // 2
            for x, y in zip(p, after, strict=True):
                row[((x * 31 + y * 2654435761) >> 7) % half] += 1
                row[half + (int(quality.KIND[x]) * 37 + int(quality.KIND[y])) % half] += 1
            size = max(1, len(p))
            row[: quality.BINS] = [math.sqrt(v / size) for v in row[: quality.BINS]]
            for i, lag in enumerate(quality.LAGS, quality.BINS):
                row[i] = sum(raw[j] == raw[j + lag] for j in range(a, a + len(p)) if j + lag < len(raw)) / size
            row[-1] = max(row[quality.BINS : -1])
            rows.append(row)
        w = {k: v.astype(float) for k, v in model.w.items()}
        hidden = [[math.tanh(sum(x * w["E"][i, j] for i, x in enumerate(row)) + w["e"][0, j]) for j in range(32)] for row in rows]
        charge = []
        for h in hidden:
            t = [math.tanh(sum(h[i] * w["V"][i, j] for i in range(32))) for j in range(16)]
            g = [1 / (1 + math.exp(-sum(h[i] * w["G"][i, j] for i in range(32)))) for j in range(16)]
            charge.append(math.exp(sum(t[j] * g[j] * w["u"][j, 0] for j in range(16))))
        z = [sum(c * h[j] for c, h in zip(charge, hidden, strict=True)) / sum(charge) for j in range(32)]
        want = 1 / (1 + math.exp(-(sum(z[j] * w["w"][j, 0] for j in range(32)) + w["b"][0, 0])))
        assert abs(score - want) < 1e-4


def test_attention_gradients():
    from tessera.llm.model import AttentionMIL

    r = np.random.default_rng(0)
    model = AttentionMIL(6, 4, 3)
    model.w = {k: v.astype(float) for k, v in model.w.items()}
    x, starts, y = r.standard_normal((7, 6)), np.array([0, 3, 4]), np.array([1.0, 0, 1])
    loss = lambda: -np.mean(y * np.log(p := model.forward(x, starts)["p"]) + (1 - y) * np.log(1 - p))
    for k, g in model.gradients(x, starts, y, 0).items():
        for at in [(0, 0), (-1, -1)]:
            keep = model.w[k][at]
            model.w[k][at] = keep + 1e-5
            up = loss()
            model.w[k][at] = keep - 1e-5
            down = loss()
            model.w[k][at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def brute_contamination(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    where = defaultdict(set)
    for item, text in items:
        if item is not None and text is not None:
            w = word.findall(lower(text))
            for i in range(max(1, len(w) - width + 1) if w else 0):
                where[tuple(w[i : i + width])].add(str(item))
    out = []
    for doc, text in docs:
        w = word.findall(lower(text or ""))
        hit, found = set(), set()
        for n in {len(k) for k in where}:
            for i in range(len(w) - n + 1):
                if own := where.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return plain(out)


@pytest.mark.parametrize("block_bytes", [1 << 18, 600])
def test_decontamination(messy, clashing, empty, benchmark_items, block_bytes):
    out = held(messy, clashing, empty, lambda d: decontaminate.summary(decontaminate.contamination(d, benchmark_items, block_bytes=block_bytes)))
    assert out == brute_contamination(docs_of(messy, "doc_id", "text"), docs_of(benchmark_items, "item_id", "text"))
    assert any(r[5] for r in out)
    assert not any(r["contaminated"] for r in decontaminate.summary(decontaminate.contamination(messy, benchmark_items.limit(0))).collect())
    clean = decontaminate.uncontaminated(clashing, benchmark_items, block_bytes=block_bytes)
    assert clean.columns == clashing.columns and clean.count() == sum(not r[5] for r in out)


def test_decontamination_spans_and_overlaps():
    machine = decontaminate.Automaton([(1, b"a b c d e f g h i j k"), (2, b"d e"), (3, b"c d e f")])
    text = "X, A b-C  D e f g h I j k; d! E ü".encode()
    assert decontaminate.scan(text, machine) == (15, [(1, 14)], ["1", "2", "3"])
    a, b = decontaminate.original_spans(text, [(1, 14)])[0]
    assert text[a:b].decode() == "A b-C  D e f g h I j k; d! E"


def test_one_automaton_holds_a_large_benchmark(spark):
    """Ten megabytes of items in one pass, and items that share windows, repeat words or end within one another."""
    r = np.random.default_rng(12)
    words = ["".join(chr(97 + x) for x in r.integers(0, 26, 5)) for _ in range(30_000)]
    lines = [" ".join(words[i] for i in r.zipf(1.3, 200) % len(words)) for _ in range(9_000)]
    assert sum(map(len, lines)) > 10_000_000 and sum(map(len, lines)) < decontaminate.BLOCK_BYTES
    items = [*enumerate(lines), (-1, "a a a a"), (-2, "a a"), (-3, " ".join(["a"] * 30))]
    docs = [(1, f"zz {lines[70][30:400]} zz"), (2, "a a a b " + "a " * 12), (3, " ".join(lines[5].split()[50:59])), (4, lines[8].upper()), (5, "")]
    docs += [(10 + i, " ".join(words[i] for i in r.zipf(1.3, 3000) % len(words))) for i in range(20)]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert plain(decontaminate.summary(found).collect()) == brute_contamination(docs, items)


@pytest.mark.parametrize("part", [1, 50])
def test_long_texts_are_split_in_parts(monkeypatch, part):
    items = [(i, x.encode()) for i, x in enumerate(["a b c d e f g h i j k l m", "b c", "x", "a a a a a a a a a a a a"])]
    text = b"x a b c d e f g h i j k q b c b " + b"a " * 25 + b"x"
    want = decontaminate.scan(text, decontaminate.Automaton(items))
    monkeypatch.setattr(decontaminate, "PART", part)
    monkeypatch.setattr(decontaminate, "STRETCH", 3)
    assert decontaminate.scan(text, decontaminate.Automaton(items)) == want
    assert want == (42, [(0, 12), (13, 15), (16, 42)], ["0", "1", "2", "3"])


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    own = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(messy, clashing, empty):
    out = held(messy, clashing, empty, simhash.near_duplicates)
    rows = [(i, brute_simhash(t)) for i, t in docs_of(messy, "doc_id", "text")]
    nodes = sorted({f for _, f in rows})
    parent = {f: f for f in nodes}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, f in rows:
        if i is not None:
            least[root(f)].append(i)
    assert out == plain([(i, f"{f:016x}", min(least[root(f)], default=None)) for i, f in rows])


def test_multi_index_links_find_all_near_fingerprints(spark):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 1 << 63, 40)]
    fps = {b for x in base for b in (x, x ^ 1, x ^ (7 << 30), x ^ (1 << 63) ^ (1 << 31) ^ 1, x ^ 15, x ^ (1 << 40), x ^ (3 << 62) ^ (1 << 5))}
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))]
    found = {tuple(sorted((x["u"], x["v"]))) for x in simhash.links(spark.createDataFrame(signed, "fp long, rep long")).collect()}
    own = sorted(fps)
    assert found == {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if (own[i] ^ own[j]).bit_count() <= 3}


@pytest.mark.parametrize("shared", [4096, 20])
def test_links_of_a_family_that_shares_a_segment(spark, shared):
    """Against all pairs: 600 fingerprints with one upper segment or one bit off it, near each other and not."""
    r = np.random.default_rng(2)
    own = sorted({(0x80F0F0F0 ^ (i % 4 == 0) << 31) << 32 | int(x) ^ sum(1 << int(b) for b in r.integers(0, 32, 2)) for x in r.integers(0, 1 << 32, 60) for i in range(10)})
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(own)]
    found = {tuple(sorted((x["u"], x["v"]))) for x in simhash.links(spark.createDataFrame(signed, "fp long, rep long"), shared).collect()}
    want = {(i, j) for i in range(len(own)) for j in range(i + 1, len(own)) if (own[i] ^ own[j]).bit_count() <= 3}
    assert found == want and len(want) > 300


def test_links_of_a_large_family_are_bounded(spark):
    """20 000 with one upper segment, against all masks of up to three bits."""
    r = np.random.default_rng(3)
    rows = [((7 << 32) | int(x), i) for i, x in enumerate(sorted({int(x) for x in r.integers(0, 1 << 32, 20_000)}))]
    found = simhash.links(spark.createDataFrame(rows, "fp long, rep long"))
    values = np.array([x for x, _ in rows], np.uint64)
    place = {int(v): i for i, v in enumerate(values)}
    masks = [sum(1 << b for b in bits) for n in (1, 2, 3) for bits in itertools.combinations(range(32), n)]
    near = {tuple(sorted((i, place[v ^ m]))) for m in masks for v, i in place.items() if v ^ m in place}
    assert {tuple(sorted(x)) for x in found.collect()} == near


def test_links_are_shuffled_however_small_their_table_is_taken_for(spark):
    """Spark takes an explode for as large as its input, so it would broadcast the balls of a table of some megabytes."""
    r = np.random.default_rng(11)
    nodes = spark.createDataFrame([(int(x), int(x)) for x in r.integers(0, 1 << 63, 500)], "fp long, rep long")
    found = simhash.links(nodes)
    assert found.collect() == []
    final = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[seg#\w+, val#\w+, half", final) and not re.search(r"BroadcastHashJoin \[seg#\w+, val#\w+, half", final)


def test_links_over_a_row_without_an_id(spark, monkeypatch):
    """Two documents that only meet through such a row are one component, and the row is in it."""
    prints = {"a": 0, "b": 0b111, "c": 0b111111, "far": (1 << 40) - 1}
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs, *_: docs.replace({k: str(v) for k, v in prints.items()}, subset=["text"]).select("doc_id", F.col("text").cast("long").alias("fp")))
    docs = spark.createDataFrame([(5, "a"), (None, "b"), (3, "c"), (9, "far"), (None, "far")], "doc_id long, text string")
    assert plain(simhash.near_duplicates(docs).select("doc_id", "component_id").collect()) == plain([(5, 3), (None, 3), (3, 3), (9, 9), (None, 9)])


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.standard_normal(12)]) for i in range(300)] + [(i, [0.5] * 12) for i in range(300, 330)]
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 12), (460, [float("inf")] * 12), (480, [0.25] * 5), (500, []), (None, [1.0] * 12), rows[20], rows[21]]
    rows += [(520, [float(x) for x in r.standard_normal(12)]), (520, [3.0] * 12)]
    vectors = spark.createDataFrame([(*x, 9, 9) for x in rows], "vec_id long, embedding array<float>, score int, v int").repartition(3)
    use = [(i, np.floor(64 * np.float32(e).astype(float))) for i, e in rows if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    use = [(i, np.pad(e, (0, 12 - len(e)))) for i, e in use]
    want = []
    for at, (q, own) in enumerate(use):
        if q % 20 == 0:
            best = sorted((-int(own @ e), c) for j, (c, e) in enumerate(use) if j != at)[:20]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    for block, seed in ((8192, 4096), (7, 40), (8192, 3)):
        assert plain(topk.top_k(vectors, lambda c: c % 20 == 0, query_block=block, seed_rows=seed).collect()) == plain(want)
    assert topk.top_k(vectors.limit(0), lambda c: c % 20 == 0).collect() == []
    few = topk.top_k(vectors.where("vec_id < 3"), lambda c: c % 20 == 0)
    assert few.count() == 2


@pytest.mark.parametrize("most", [100, 1e6, 1e12])
def test_bounds_hold_at_every_level(most):
    r = np.random.default_rng(4)
    for dim in (1, 3, 64):
        a, b = np.floor(r.standard_normal((50, dim)) * most), np.floor(r.standard_normal((60, dim)) * most)
        levels = topk.levels_of(a, dim, most)
        (za, sa), (zb, sb) = levels.of(a), levels.of(b)
        exact, room = a @ b.T, 1e-5 * np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
        for t, x, y in zip(levels.singles, sa, sb, strict=True):
            bound = za[:, :t] @ zb[:, :t].T + x @ y.T
            assert (bound + room >= exact).all()


def test_only_survivors_are_scored(spark):
    """Most pairs are settled by their bounds, also where no direction stands out, and a basis makes the first levels tell."""
    r = np.random.default_rng(7)
    flat, steep = r.standard_normal((6000, 64)), r.standard_normal((6000, 64)) * 2.0 ** -np.arange(0, 16, 0.25)
    turn, _ = np.linalg.qr(r.standard_normal((64, 64)))
    for x, share in ((flat, 0.08), (steep @ turn, 0.05)):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(2)
        seen, exact = topk.pairs_scored(vectors, lambda c: c % 20 == 0)
        assert seen == 300 * 6000 and exact < share * seen


def test_token_counts(messy, clashing, empty):
    import sentencepiece

    out = held(messy, clashing, empty, lambda d: tokencount.token_counts(d, PIECES))
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert out == plain([(i, len((t or "").encode()), n := len(lib.encode(t or "")), n > 4096) for i, t in docs_of(messy, "doc_id", "text")])


def test_transducer_and_scan_equal_the_library(monkeypatch):
    import random

    made = tokencount.Transducer(PIECES)
    assert made.plain
    r = random.Random(2)
    signs, parts = "ab the ing  \n\t▁éßçø日本語🙂\0<s>1239 .,;'’", ["the", "of", "ing", "▁", " ", "  ", "\n", "hello", "world", "日本", "    ", "</s>", "aaaaaaa"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) if i % 2 else "".join(r.choice(parts) for _ in range(r.randint(0, 12))) for i in range(1500)]
    texts += ["", " ", "  ", "\n", " \n ", "  \n  \n", "a" * 5000, "Supercalifragilistic" * 40, "the " * 700, "x  y" * 300, "\n" * 500]
    want = [len(made.library.encode(x)) for x in texts]
    for chunk, block in ((192, 1 << 20), (1, 1 << 20), (7, 40), (3, 1), (64, 1000)):
        monkeypatch.setattr(tokencount, "CHUNK", chunk)
        monkeypatch.setattr(tokencount, "BLOCK", block)
        got = made.counts(texts).tolist()
        assert got == want, [(x, g, w) for x, g, w in zip(texts, got, want, strict=True) if g != w][:5]
    assert [made.count(x) for x in texts[:200]] == want[:200]


def test_a_chunks_map_is_asked_at_the_state_before_it():
    """The maps of all cuts of a word compose to the word's own."""
    made = tokencount.Transducer(PIECES)
    for word in ("▁international", "▁understandings", "▁Thequickbrownfoxjumps"):
        whole = made.run(tokencount.START, word)
        for i in range(1, len(word)):
            at, n = made.run(tokencount.START, word[:i])
            to, more = made.run(at, word[i:])
            assert (to, n + more) == whole
        assert whole[1] == len(made.library.encode(word[1:]))


@pytest.mark.parametrize("most", [50])
def test_states_start_anew(monkeypatch, most):
    monkeypatch.setattr(tokencount, "MOST_STATES", most)
    made = tokencount.Transducer(PIECES)
    for text in ("the cat sat on the mat " * 20, "Völlig andere Wörter kommen hier", "und noch mehr davon"):
        assert made.count(text) == len(made.library.encode(text))


@pytest.mark.parametrize(("together", "cuts"), [(1024, (24, 6)), (1, (24, 6)), (1, ())])
def test_repeated_substrings(messy, clashing, empty, monkeypatch, together, cuts):
    monkeypatch.setattr(substrings, "TOGETHER", together)
    monkeypatch.setattr(substrings, "CUTS", cuts)
    out = held(messy, clashing, empty, lambda d: substrings.without_repeats(d, length=200))
    texts = [(i, (t or "").encode()) for i, t in docs_of(messy, "doc_id", "text")]
    seen = Counter(t[j : j + 200] for _, t in texts for j in range(len(t) - 199))
    want = []
    for i, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - 199):
            if seen[t[j : j + 200]] > 1:
                gone[j : j + 200] = b"\1" * 200
        edges = [j for j in range(len(t) + 1) if (j < len(t) and gone[j]) != (j > 0 and gone[j - 1])]
        want.append((i, len(t), tuple(edges), bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    assert out == plain(want)
    assert any(r[2] for r in out)


@pytest.mark.parametrize("length", [5, 8, 20, 200])
def test_order_of_phrases_tells_what_they_share(length):
    """Against all pairs of pieces of a group, aligned at their triggers."""
    r = np.random.default_rng(length)
    for signs in (1, 2, 26):
        base = bytes(r.integers(97, 97 + signs, 3 * length, dtype=np.uint8))
        groups, places, pieces = [], [], []
        for _ in range(60):
            p, tail = int(r.integers(0, length)), int(r.integers(1, length + 3))
            x = bytearray(base[length - p : length + tail])
            for _ in range(int(r.integers(0, 3))):
                x[int(r.integers(0, len(x)))] = 65 + int(r.integers(0, 3))
            groups.append(int(r.integers(0, 4)))
            places.append(p)
            pieces.append(bytes(x))
        seen = Counter((g, i - p, x[i : i + length]) for g, p, x in zip(groups, places, pieces, strict=True) for i in range(min(p, len(x) - length) + 1))
        found = {(i, j) for i, a, b in substrings.repeated_windows(groups, places, pieces, length) for j in range(a, b + 1)}
        want = {(n, i) for n, (g, p, x) in enumerate(zip(groups, places, pieces, strict=True)) for i in range(min(p, len(x) - length) + 1) if seen[g, i - p, x[i : i + length]] > 1}
        assert found == want
    order, lcp = substrings.in_order([(0, b"ab"), (1, b"ab"), (0, b"abc"), (0, b""), (1, b"b"), (0, b"abd")])
    assert order.tolist() == [3, 0, 2, 5, 1, 4] and lcp.tolist() == [-1, 0, 2, 2, -1, 0]


def brute_repeats(texts: list[tuple], length: int) -> list[tuple]:
    seen = Counter(t[j : j + length] for _, t in texts for j in range(len(t) - length + 1))
    want = []
    for i, t in texts:
        gone = bytearray(len(t))
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = b"\1" * length
        edges = [j for j in range(len(t) + 1) if (j < len(t) and gone[j]) != (j > 0 and gone[j - 1])]
        want.append((i, len(t), tuple(edges), bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return plain(want)


@pytest.mark.parametrize("hot", [1000, 1])
def test_a_trigger_in_every_document_and_repeated_rows(spark, monkeypatch, hot):
    """One short passage in all documents, one row a thousand times."""
    monkeypatch.setattr(substrings, "dealt", lambda *a: common.dealt(*a, hot=hot))
    r = np.random.default_rng(13)
    some = lambda n: "".join(chr(97 + x) for x in r.integers(0, 26, n))
    passage = some(70)
    rows = [(i, some(60) + passage + some(60)) for i in range(300)] + [(1000, some(90) + passage + some(300))] * 1000 + [(1001, "z" * 500), (1002, some(30) + passage)]
    out = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), length=40)
    assert plain(out.collect()) == brute_repeats([(i, t.encode()) for i, t in rows], 40)


def test_repeats_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    long = "".join(chr(97 + x) for x in rng.integers(0, 26, 5000))
    monkeypatch.setattr(substrings, "BLOCK", 2048)
    texts = [long.encode(), (long[1000:3000] + "!" + long[3500:3800]).encode(), b"z" * 900]
    found = {}
    for own, joined, sizes in substrings.blocks(texts, 200):
        ends = np.repeat(np.cumsum(sizes), sizes)
        lo, hi, _, _ = substrings.phrases(np.frombuffer(joined, np.uint8), ends, 200, 32)
        base = np.concatenate(([0], np.cumsum(sizes)))
        for a, b in zip(lo, hi, strict=True):
            part = int(np.searchsorted(base, a, "right")) - 1
            for w in range(a, b + 1):
                key = own[part][0], own[part][1] + w - base[part]
                assert key not in found
                found[key] = joined[w : w + 200]
    assert found == {(r, j): t[j : j + 200] for r, t in enumerate(texts) for j in range(len(t) - 199)}


def test_packing(messy, clashing, empty):
    from tokenizers import Tokenizer

    def run(d):
        return packing.pack(d, BYTES)

    rows = run(messy).collect()
    assert run(empty).collect() == []
    assert run(clashing).count() > 0
    lib = Tokenizer.from_file(BYTES)
    ids = Counter((i, tuple(lib.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in docs_of(messy, "doc_id", "text"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(k[1]) * n for k, n in ids.items())
    for (i, own), n in ids.items():
        pieces = Counter(by_doc[i, len(own)])
        if sum(1 for k in ids if (k[0], len(k[1])) == (i, len(own))) == 1:
            whole = Counter({(s, own[s : s + len(p)]): 0 for s, p in pieces})
            for (s, p), times in pieces.items():
                assert own[s : s + len(p)] == p
                whole[s, p] += times
            assert sum(len(p) * times for (_, p), times in pieces.items()) == n * len(own)
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048


def test_plan_uses_each_rest_once():
    r = np.random.default_rng(6)
    histogram = np.bincount(np.minimum(63, r.geometric(0.05, 5000)), minlength=64)
    histogram[40] += 2000
    own = packing.plan(histogram)
    assert own.combined > 0
    fill = defaultdict(list)
    for length in range(1, 64):
        for rank in range(histogram[length]):
            at = 0
            for start, size, sequence, offset in own.pieces(length, rank):
                assert start == at
                at += size
                fill[sequence].append((offset, size))
            assert at == length
    assert set(fill) == set(range(own.sequences))
    sizes = []
    for pieces in fill.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        sizes.append(at)
    assert sum(s == 64 for s in sizes) >= len(sizes) - 6
    assert all(s & (s - 1) == 0 for s in sizes)


def test_combinations_are_all_there_and_fit_the_histogram(monkeypatch):
    histogram = np.array([5, 3, 0, 4, 2, 0, 1, 2, 0, 4, 1, 2])
    ways = {tuple(sorted(int(x) for x in w if x)) for w in packing.combinations(histogram)}
    lengths = [v for v in range(1, 12) if histogram[v]]
    assert ways == {(a, b) for a in lengths for b in lengths if a <= b and a + b == 12} | {(a, b, c) for a in lengths for b in lengths for c in lengths if a <= b <= c and a + b + c == 12}
    assert len(packing.combinations(np.zeros(12, int))) == 0
    made = np.bincount(np.random.default_rng(2).choice(np.arange(100, 1900), 20_000), minlength=2048)
    ways = packing.combinations(made)
    def left(x):
        return np.linalg.norm((np.bincount(ways.ravel(), np.repeat(x, 3), minlength=2048) - made)[1:])

    x = packing.solve(ways, made)
    monkeypatch.setattr(packing, "SETTLED", 1e-9)
    assert (x >= 0).all() and left(x) <= 1.05 * left(packing.solve(ways, made)) < 0.1 * np.linalg.norm(made)
    own = packing.plan(made)
    assert (own.left <= made).all() and own.left.sum() > 0.6 * made.sum()


def test_quick_ids_equal_the_library():
    from tessera.llm.bpe import KNOWN, ids_of

    own = ids_of(BYTES)
    assert own.quick is not None
    for c in range(ord(KNOWN)):
        for text in (chr(c), f"a{chr(c)}b", f" {chr(c)} {chr(c)}{chr(c)} 1", f"x{chr(c)} {chr(c)}\n{chr(c)}"):
            assert own.of(text) == own.library.encode(text, add_special_tokens=False).ids, (c, text)


def test_toxicity(messy, clashing, empty, labels):
    out = held(messy, clashing, empty, lambda d: toxicity.toxicity_scores(d, labels))
    for doc, held_out, score, predicted in out:
        assert held_out == (doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2)
        assert 0 <= score <= 1 and predicted == int(score >= 0.3)


def test_toxicity_restores_words(spark):
    import random

    r = random.Random(3)
    filler = lambda: " ".join("".join(r.choice(["the", "re", "ring", "tion", "and", "with", "sho"]) for _ in range(r.randint(1, 4))) for _ in range(30))
    rows = [(i, filler() + (f" {r.choice(['moron', 'pathetic'])} " if i % 5 == 0 else " ") + filler(), "en", "s", 1) for i in range(800)]
    odd = ["m0r0n", "m o r o n", "moooron", "M.O.R.O.N", "p4thet1c", "pathétic", "PATHETIC!!"]
    rows += [(2000 + i, f"{filler()} {w} {filler()}", "en", "s", 1) for i, w in enumerate(odd)] + [(3000, filler(), "en", "s", 1), (3001, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    given = docs.where("doc_id < 800").select("doc_id", F.expr("int(doc_id % 5 = 0)").alias("toxic"))
    out = {x["doc_id"]: x["predicted"] for x in toxicity.toxicity_scores(docs, given).collect()}
    assert [out[2000 + i] for i in range(len(odd))] == [1] * len(odd)
    assert out[3000] == 0 and out[3001] == 0
    assert all(out[i] == int(i % 5 == 0) for i in range(800))


def test_toxicity_reads_gaps_anywhere():
    text = "you asshole moron, as shown in the show more on the moor only as she was " * 50
    code = toxicity.CODE[np.frombuffer(text.encode(), np.uint8)]
    grams, counts = np.unique([int(a) * 28**3 + int(b) * 28**2 + int(c) * 28 + int(d) for a, b, c, d in zip(code, code[1:], code[2:], code[3:])], return_counts=True)  # noqa: B905
    model = toxicity.ToxicWords(toxicity.CharModel(grams, counts), [("assh", 1), ("moro", 1), ("moron", 1)], np.array([0.9, 0.9, 0.9]), 0.01)
    for odd in ("a s s h o l e", "m o o r o n", "mor on", "m.o.ron", "moron", "m 0 r 0 n"):
        assert model.score(f"you {odd} you") > 0.8, odd
    for clean in ("as shown in the show", "as she was", "the moor only", "more on the"):
        assert model.score(clean) < 0.1, clean
    assert model.found("moron nice") >= {"moron"}


def _toxic_model():
    text = "you asshole moron, illmoron, loser, as shown in the show more on the moor only as she was for a loss so later " * 50
    code = toxicity.CODE[np.frombuffer(text.encode(), np.uint8)]
    grams, counts = np.unique([int(a) * 28**3 + int(b) * 28**2 + int(c) * 28 + int(d) for a, b, c, d in zip(code, code[1:], code[2:], code[3:])], return_counts=True)  # noqa: B905
    chars = toxicity.CharModel(grams, counts)
    clues = [("assh", 1), ("illmoron", 1), ("loser", 1), ("moro", 1)]
    return toxicity.ToxicWords(chars, clues, np.full(len(clues), 0.9), 0.01)


def test_toxicity_decodes_whole_spans_with_gaps_anywhere():
    model = _toxic_model()
    for odd in ("mo ron", "m oron", "mo.ro n", "l" + "o" * 70 + "ser", "l" + " o" * 70 + " s e r", "l" + "0" * 3000 + "ser", "i1lmoron", "11moron"):
        assert model.score(f"you {odd} you") > 0.8, odd[:80]
    for clean in ("a loss", "so later", "more on", "moor only", "lo" * 40, "see the lo sergeant"[:10]):
        assert model.score(f"you {clean} you") < 0.1, clean
    for endless in ("|" * 200_000, "l " * 200_000, "1" * 200_000, "m o " * 50_000, "l" + " o" * 200_000, "a s s " * 50_000):
        assert model.score(endless) < 0.1


def test_toxicity_reads_gaps_of_any_length_and_letters_that_look_alike():
    model = _toxic_model()
    for gap in ("...", "   ", "--", "/", ",", "\u200b", "\n", " \n\t ", "_" * 500, " . ", "\u00a0\u00a0"):
        assert model.score(f"you {gap.join('loser')} you") > 0.8, gap
        assert model.score(f"you lo{gap}ser you") > 0.8, gap
    for odd in ("l\u043eser", "l\u043es\u0435r", "L\u041eS\u0415R", "l\u03bfser", "l \u043e   s...e r"):
        assert model.score(f"you {odd} you") > 0.8, odd
    for clean in ("a   loss", "so ,, later", "more...on", "moor\n\nonly", "\u0441\u043e\u0440\u0435\u0432\u043d\u043e\u0432\u0430\u043d\u0438\u0435"):
        assert model.score(f"you {clean} you") < 0.1, clean
    for endless in ("l   " * 100_000, "m...o...\n" * 50_000, "." * 300_000, "\u200b" * 300_000):
        assert model.score(endless) < 0.1
    assert toxicity.plain_gaps("A\u200bB..c \n d\u2003e\tf-_g") == "ab.c d e f-g"


def test_viterbi_finds_the_cheapest_reading():
    """Against all readings of short spans: each sign read, dropped as a gap or a repeat, or taken as a boundary."""
    model = _toxic_model().chars

    def every(span, split, context=0, last=""):
        if not span:
            yield model.cost(context, 0), ""
            return
        sign = span[0]
        for letter, charge in toxicity.readings(sign) + ([(" ", toxicity.COST_WORD)] if split and sign in toxicity.GAPS else []):
            for kept, price in [(letter, charge)] + ([("", toxicity.COST_REPEAT)] if letter and letter == last else []):
                code = (ord(kept) - 96 if "a" <= kept <= "z" else 0 if kept == " " else 27) if kept else None
                to, now = ((context * 28 + code) % 28**3, kept) if kept else (context, last)
                for cost, rest in every(span[1:], split, to, now):
                    yield cost + price + (model.cost(context, code) if kept else 0), kept + rest

    for span in ("m0r0n", "mo ron", "l00ser", "a s s h", "1l1", "lo.ser", "sh0w", "é1!", "||", "mooor"):
        for split in (False, True):
            costs = {}
            for cost, word in every(span, split):
                costs[word] = min(cost, costs.get(word, np.inf))
            best = min(costs.values())
            assert abs(costs[toxicity.decode(span, model, split)] - best) < 1e-4, (span, split)


@pytest.mark.parametrize("least", [0, 50])
def test_warc_round_trip(spark, least):
    r = np.random.default_rng(9)
    big = "".join(chr(97 + x) for x in r.integers(0, 26, 50_000))
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", None), (3, None, ""), (4, "http://é", big), (5, "u", big), (6, "u", "é" * 5000), (7, "u", "\r\n\r\nWARC/1.0\r\n" * 900), (None, "u", "only here"), (None, "u", "<p>x</p>"), (9, "u", "<p>x</p>")]
    pages = spark.createDataFrame([(*x, 1, 2) for x in rows], "page_id long, url string, html string, digest int, first int").repartition(2)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(first.get(h or "", i), i)
    want = [(i, len(b := (h or "").encode()), warc.digest_of(b), "revisit" if first.get(h or "", i) != i else "response", first[h or ""] if first.get(h or "", i) != i else None) for i, _, h in rows]
    assert plain(warc.round_trip(pages, least_revisit_bytes=least).collect()) == plain(want)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_segments_in_other_files_come_together(spark, tmp_path):
    rows = [(i, "u", chr(97 + i) * 60_000) for i in range(5)]
    folder = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder, segment=4096, file_bytes=20_000)
    assert len(list((tmp_path / "warc").glob("*.gz"))) > 5
    assert plain(r[:2] for r in warc.read_archives(spark, folder).collect()) == [(i, 60_000) for i in range(5)]


def test_bad_and_foreign_records_are_set_aside(spark, tmp_path):
    import gzip

    def own(page, payload, **more):
        return [r + b"\r\n\r\n" for r in warc.page_records(page, "u", payload, more.get("first"), f"m{page}", 4096)]

    long = bytes(range(97, 123)) * 400
    good = own(1, b"one") + own(2, b"x", first=1) + own(3, long)
    info = warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:uuid:1>")], b"software: x") + b"\r\n\r\n"
    request = warc.record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:2>")], b"GET / HTTP/1.1") + b"\r\n\r\n"
    alien = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:3>"), ("WARC-Payload-Digest", "sha1:" + warc.digest_of(b"zz"))], b"HTTP/1.1 200 OK\r\n\r\nzz") + b"\r\n\r\n"
    no_length = b"WARC/1.0\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n"
    too_long = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcdefghi\r\n\r\n"
    changed = own(4, b"four")[0].replace(b"4\r\nfour", b"4\r\nFOUR")
    unframed = own(5, b"five")[0].replace(b"4\r\nfive", b"9\r\nfive")
    missing = own(6, long)[:1] + own(7, long)[1:]
    (tmp_path / "a").mkdir()
    parts = [info, good[0], no_length, request, good[1], too_long, alien, *good[2:], changed, unframed, *missing]
    (tmp_path / "a" / "1.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts))  # a member a record
    (tmp_path / "a" / "2.warc.gz").write_bytes(gzip.compress(b"junk before\r\n" + own(8, b"eight")[0]))
    (tmp_path / "a" / "3.warc.gz").write_bytes(b"\x1f\x8b no archive")
    rows = warc.read_records(spark, str(tmp_path / "a"))
    assert plain(r[:4] for r in warc.pages_of(rows).collect()) == plain([(1, 3, warc.digest_of(b"one"), "response"), (2, None, warc.digest_of(b"x"), "revisit"), (3, len(long), warc.digest_of(long), "response"), (8, 5, warc.digest_of(b"eight"), "response")])
    bad = warc.bad_records(rows).collect()
    assert len(bad) == 9 and all(r["error"] for r in bad)
    assert sum("missing" in r["error"] for r in bad) == 2 and sum(r["file"] is not None for r in bad) == 7


@pytest.mark.parametrize("repeats", [1, 4])
def test_revisits_refer_to_a_record_of_the_archive(spark, tmp_path, repeats):
    """Every Refers-To is the id of one response with that payload, and ids occur once, also where rows repeat."""
    rows = [(i, f"u{i}", f"body {i % 4}" * 2000) for i in range(20)] + [(2, f"u{k % 3}" if k else None, "body 2" * 2000) for k in range(1, repeats)] + [(None, "u", "body 3" * 2000), (50, "u", "alone"), (51, "u", None)]
    folder = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), folder)
    heads = [h for f in (tmp_path / "warc").glob("*.gz") for _, h, _, e in warc.records_of(warc.unzipped(f.read_bytes())) if not e]
    ids = [h["warc-record-id"] for h in heads]
    assert len(ids) == len(set(ids))
    digest = {h["warc-record-id"]: h["warc-payload-digest"] for h in heads if h["warc-type"] == "response"}
    back = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(back) == 17 and len(digest) == len(rows) - 17
    assert all(digest[h["warc-refers-to"]] == h["warc-payload-digest"] for h in back)
    assert len(warc.read_archives(spark, folder).collect()) == len(rows)


def test_salts_follow_a_keys_rows(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) k", "id v")
    for hot in (2000, 500, 10, 1):
        marks = spark.createDataFrame([(0, 1000, "a"), (1, 1, "b"), (2, 1, "c")], "k long, n long, m string")
        out = common.dealt(rows, marks, ["k"], ["v"], hot)
        assert plain(out.select("k", "v", "m").collect()) == plain([(0, i, "a") for i in range(0, 3000, 3)] + [(1, 1, "b"), (2, 2, "c")])


def test_a_very_common_payload(spark, monkeypatch):
    monkeypatch.setattr(warc, "dealt", lambda *a, **k: common.dealt(*a, hot=5, **k))
    rows = [(i, f"u{i}", "error" if i % 3 else f"own {i}") for i in range(300)]
    out = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert out == {i: ("revisit", 1, 5) if i % 3 and i != 1 else ("response", None, len(h)) for i, _, h in rows}


def test_framing_that_does_not_hold():
    for x in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n0\r\nx"):
        with pytest.raises(ValueError):
            warc.unchunked(x)
    with pytest.raises(ValueError):
        warc.reassembled([(1, None, b"ab"), (2, 5, b"cd")])
    assert warc.reassembled([(2, 4, b"cd"), (1, None, b"ab")]) == b"abcd"
    assert warc.reassembled([(2, 4, b"cd")]) is None
