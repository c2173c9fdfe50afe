"""Drifted schemas, spelling variants and chat formatting against brute-force versions over messy rows."""

from __future__ import annotations

import datetime
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from llm_help import plain

from tessera.llm import chat, drift, variants

# -- 11 --------------------------------------------------------------------------------------------------------------------

CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
NAMES = [c.split()[0] for c in CLIENTS.split(", ")]


def client_rows(n: int) -> list[tuple]:
    r = random.Random(3)
    some = lambda v: None if r.random() < 0.1 else v
    rows = [(i * 7 - 20, some(i // 2), some("web"), some(datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=r.randint(-(10**15), 10**15))), some(f"Näme {i}"), some(""), some("x|y\nz"), some(i % 25), some("s" * r.randint(0, 9)), some(r.choice([0.1, -3.7, 1e9 + 0.3, 2458.1]))) for i in range(n)]
    return [*rows, (None, 1, *[None] * 8), (5, 1, "a", None, "L" * 200_000, None, None, 3, None, -0.001), (5, 1, "a", None, "L", None, None, 3, None, 7.0), rows[3], rows[3]]


def version(file_no: int) -> int:
    v = zlib.crc32(f"42:{file_no}".encode()) % 24
    return v if v <= 15 else 0


def expected(rows: list[tuple], order: list[tuple], start: int, size: int, file_no: int) -> tuple:
    v, own = version(file_no), order[start : start + size]
    names = list(NAMES)
    if v & 1:
        a, b = names.index("name"), names.index("email")
        names[a], names[b] = names[b], names[a]
    if v & 4:
        names = [n for n in names if n not in ("nation_id", "source")]
    if v & 2:
        names = [names[0], *reversed(names[1:])]
    lines, nulls = [], 0
    for row in own:
        row = list(row)
        if v & 4:
            row[7], row[2] = -1, "none"
        if v & 8 and row[9] is not None:
            row[9] = struct.unpack("f", struct.pack("f", row[9]))[0]
        nulls += sum(x is None for x in row)
        if row[9] is not None:
            row[9] = math.floor(1048576 * row[9])
        if row[3] is not None:
            row[3] = (row[3] - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
        lines.append("|".join("?" if x is None else str(x) for x in row))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return file_no, v, len(own), nulls, sha(",".join("?" if r[0] is None else str(r[0]) for r in own)), sha("\n".join(lines)), ",".join(names), ",".join(NAMES), v != 0


COLUMNS = ("file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "rewritten")


@pytest.mark.parametrize("n", [40, 1300])
def test_drifted_rewrite(spark, n):
    rows = client_rows(n)
    df = spark.createDataFrame(rows, CLIENTS).repartition(3)
    out = drift.drifted_rewrite(df)
    got = {r["file_no"]: r for r in out.collect()}
    size = 1 + len(rows) // 500
    key = lambda r: (0 if r[0] is None else zlib.crc32(str(r[0]).encode()), r[0] is not None, r[0] or 0)
    order = sorted(rows, key=key)
    ties = {key(r) for i, r in enumerate(order) if i and key(order[i - 1]) == key(r)}
    assert sorted(got) == list(range(math.ceil(len(rows) / size)))
    for file_no, r in got.items():
        want = expected(rows, order, file_no * size, size, file_no)
        tied = any(key(x) in ties for x in order[file_no * size : (file_no + 1) * size])
        for name, value in zip(COLUMNS, want, strict=True):
            assert r[name] == value or (tied and name in ("rows_sha256", "n_nulls")), (name, file_no)
        table = pq.read_table(r["path"])
        assert table.schema.names == NAMES and [int(f.metadata[b"PARQUET:field_id"]) for f in pq.ParquetFile(r["path"]).schema_arrow] == list(range(1, 11))
        assert str(table.schema.field("nation_id").type) == "int64" and all(f.nullable for f in table.schema)
    folder = Path(got[0]["path"]).parent
    assert sorted(p.name for p in folder.parent.rglob("*") if p.is_file()) == sorted(Path(r["path"]).name for r in got.values())


def test_untouched_files_and_repeats_of_tasks(spark, tmp_path):
    """A version without drift keeps its file as it was; rewriting again changes nothing."""
    df = spark.createDataFrame(client_rows(600), CLIENTS).repartition(2)
    files = f"file://{tmp_path}/files"
    drift.write_drifted(df, files)
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "files").iterdir()}
    fields = drift.evolved(df)
    done = drift.rewrite(spark, files, f"file://{tmp_path}/staging", fields)
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "files").iterdir()}
    assert done == {i for i in range(len(before)) if version(i)} and len({version(i) for i in range(len(before))}) == 16
    assert {n for n in before if before[n] != after[n]} == {drift.file_name(i) for i in done}
    assert drift.rewrite(spark, files, f"file://{tmp_path}/staging", fields) == set()
    assert not (tmp_path / "staging").exists()


def test_a_client_with_most_rows_is_spread(spark):
    """One key, and copies of one row, are cut into ranges; the order is the same."""
    rows = [(i, 1, "a", None, f"n{i}", None, None, 1, None, 1.0) for i in range(2000)] + [(77, 1, "hot", None, str(i), None, None, 1, None, 1.0) for i in range(3000)] + [(78, 1, "copy", None, "same", None, None, 1, None, 1.0)] * 3000
    df = spark.createDataFrame(rows, CLIENTS).repartition(3)
    by_rank, total = drift.ranked(df, parts=8)
    sizes = by_rank.mapPartitions(lambda it: [sum(1 for _ in it)]).collect()
    assert sum(sizes) == total == len(rows) and max(sizes) < 2000 and len(sizes) <= 8 + 4 * 8
    ranks = by_rank.map(lambda x: (x[0], x[1][0])).collect()
    assert [r for r, _ in sorted(ranks)] == list(range(total))
    assert [i for _, i in sorted(ranks)] == sorted((r[0] for r in rows), key=lambda i: (zlib.crc32(str(i).encode()), i))


def test_no_clients(spark):
    assert drift.drifted_rewrite(spark.createDataFrame([], CLIENTS)).collect() == []


# -- 12 --------------------------------------------------------------------------------------------------------------------


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows: list[tuple]) -> list[tuple]:
    total: Counter = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    n = {w: k for w, k in total.items() if len(w) >= 6 and k >= 5}
    partners = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: next(iter(sorted((v for v in p), key=lambda v: (-n[v], v))), None) for w, p in partners.items()}
    form = {w: f if f is not None and n[f] >= 5 * n[w] else None for w, f in form.items()}

    def root(w: str) -> str:
        while form[w] is not None:
            w = form[w]
        return w

    return plain((w, form[w], root(w), n[w], len(partners[w]), n[form[w]] if form[w] else None) for w in n)


def variant_rows() -> list[tuple]:
    r, text = random.Random(9), []
    base = ["".join(r.choice("abcàÿz") for _ in range(r.randint(6, 11))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "b" * 40, "b" * 41]
    for i, w in enumerate(base):
        text += [w] * r.choice([5, 30, 200])
        for _ in range(6):
            at, c = r.randint(0, len(w)), r.choice("abcdàÿ")
            text += [r.choice([w[:at] + c + w[at:], w[: at - 1] + w[at:], w[: at - 1] + c + w[at:]])] * r.choice([1, 5, 6, 30])
        text += [f"prefix{c}suffix" for c in "abcdefghij" if i % 9 == 0] * 5
    r.shuffle(text)
    rows = [(i, r.choice([" ", "-", "1", "×"]).join(text[k : k + 37]).title() if i % 3 == 0 else " ".join(text[k : k + 37])) for i, k in enumerate(range(0, len(text), 37))]
    return [*rows, (None, text[0] + " " + text[1]), (None, None), (3, ""), rows[1], rows[1]]


@pytest.mark.parametrize("block", [3, variants.BLOCK])
def test_variants(spark, block):
    rows = variant_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_variants(rows)
    assert plain(variants.variants(df, block_size=block).collect()) == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] and w[1] for w in want)


def test_variants_with_other_columns_and_without_rows(spark):
    rows = variant_rows()[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = df.select("*", *(F.lit(1).alias(n) for n in ("word", "n", "near", "form", "root", "block", "best", "last", "doc")))
    assert plain(variants.variants(more).collect()) == brute_variants(rows)
    assert variants.variants(df.limit(0)).collect() == []
    assert variants.variants(df.select("doc_id", F.lit("a b c").alias("text"))).collect() == []


def test_pairs_in_memory_and_over_passes(spark):
    """Every pair once, for any block size, words of any length, and a block that all words share."""
    r = random.Random(4)
    own = sorted({"x" * 8 + "".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(300)} | {"a", "b", "ab", "ba", "c"})
    df = spark.createDataFrame([(w, 1) for w in own], "word string, n long").repartition(2)
    want = sorted(tuple(sorted((a, b))) for i, a in enumerate(own) for b in own[i + 1 :] if near(a, b))
    for block in (2, 50, 10_000):
        assert sorted(tuple(sorted((x["word"], x["near"]))) for x in variants.near_words(df, block).collect()) == want


def test_long_texts_are_cut_between_words():
    text = "word" * 50 + " " + "häuser " * 400 + "x" * 5000
    for size in (7, 100, 10_000):
        parts = list(variants.stretches(text, size))
        assert [m for a, b in parts for m in re.findall("[a-zÀ-ÿ]+", text[a:b])] == re.findall("[a-zÀ-ÿ]+", text)


# -- 13 --------------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def turn_rows() -> list[tuple]:
    r = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "<\\\\/s>", "[\\INST]", "[\\/INST]", "[", "<", "\\", "/s>", "INST]", "$0", "é", "🙂", "\n", "text ", ""]
    rows = [(c, t, r.choice(["user", "assistant", "system"]), "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for c in range(120) for t in range(r.randint(1, 7))]
    rows += [(500, 0, None, None), (500, None, "<s>[INST]", "role with marks"), (501, 1, "assistant", None), (None, 1, "user", "no conversation"), (502, 1, "user", "twice"), (502, 1, "user", "twice"), (502, 1, "assistant", "tie"), (503, 0, "assistant", "long [INST] " * 30_000)]
    return rows + [(504, t, "assistant" if t % 2 else "user", f"turn {t} </s>") for t in range(3000)]


def brute_chat(rows: list[tuple]) -> dict:
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        marks = sum(len(re.findall(r"<\\*/?s>|\[\\*/?INST\]", t[2])) + len(re.findall(r"<\\*/?s>|\[\\*/?INST\]", t[3])) for t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss), sum(20 + len(t[2]) + len(t[3]) for t in turns) + marks)
    return out


def test_chat_formatting(spark):
    rows = turn_rows()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    made = chat.formatted(df)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digest(made).collect()}
    assert got == brute_chat(rows)
    texts = {r["conv_id"]: r for r in made.collect()}
    for conv, r in texts.items():
        parts = r["formatted"].split("</s>")
        source = sorted((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == conv)
        assert [m["turn"] for m in r["mask"]] == [i for i, x in enumerate(source) if x[2] == "assistant"]
        for m in r["mask"]:
            assert parts[m["turn"]][m["end"] :] == "[/INST]" and parts[m["turn"]][: m["begin"]] == "<s>assistant[INST]"
        assert len(parts) == len(source) + 1 and all(len(re.findall(chat.MARK, p)) == 3 for p in parts[:-1])


def test_chat_with_other_columns_and_without_rows(spark):
    df = spark.createDataFrame(turn_rows()[:50], TURNS)
    more = df.select("*", *(F.lit(1).alias(n) for n in ("piece", "turns", "formatted", "mask", "read", "loss", "n_turns", "begin")))
    assert plain(chat.digest(chat.formatted(more)).collect()) == plain(chat.digest(chat.formatted(df)).collect())
    assert chat.digest(chat.formatted(df.limit(0))).collect() == []


def test_the_grammar_rejects_what_it_did_not_write(spark):
    bad = ["x", "<s>user[INST]hi[/INST]", "<s>user[INST]a[INST]b[/INST]</s>", "user[INST]a[/INST]</s>", "<s>user[INST]a</s>"]
    for r in spark.createDataFrame([(x,) for x in bad], "t string").select(chat.parsed(F.col("t")).alias("turns")).collect():
        assert None in r["turns"]
    (one,) = spark.createDataFrame([("<s>user[INST]<\\s> [\\\\/INST][/INST]</s>",)], "t string").select(chat.parsed(F.col("t")).alias("turns")).collect()
    assert [tuple(t) for t in one["turns"]] == [("user", "<s> [\\/INST]")]


def test_chat_runs_no_python(spark):
    plan = chat.digest(chat.formatted(spark.createDataFrame([(1, 1, "user", "a")], TURNS).select("*")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
