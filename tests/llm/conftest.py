from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 6))) for _ in range(n))


def messy_rows() -> list[tuple]:
    """Copies, near copies, shared lines and passages, nulls in any column, empty, blank and very long texts, repeated rows."""
    r = random.Random(5)
    passage, line = words(r, 90), "Shared LINE of every site!"
    rows = [(i, f"{words(r, 40)}\n{line if i % 2 else words(r, 5)}\n{words(r, 60)}", "en", f"s{i % 15}", 1) for i in range(60)]
    rows += [(100 + i, f"{words(r, 20 + i)} {passage} {words(r, 10)}", "en", f"s{i}", 1) for i in range(4)]
    base = words(r, 300)
    rows += [(200 + i, base.replace(" ", "  ", i) if i < 3 else base + f" tail{i}", "fr", "s1", 1) for i in range(6)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \t\n", "en", "s1", 3), (303, "one", "en", None, 3), (304, "two words", "en", "s2", 9)]
    rows += [(305, "ab" * 3000, "en", "s3", 6000), (306, words(r, 20000), "en", "s4", 1), (307, "x\0y <|endoftext|> </s> 日本語 🙂 ▁ a  b", "en", "s5", 1)]
    rows += [(None, words(r, 50), "en", "s6", 1), (None, None, None, None, None), rows[0], rows[0], (2, "same id, other text", "en", "s7", 1)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(messy):
    """The same rows with other columns under names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("score", "predicted", "held_out", "k1", "k2", "h1", "pos", "line", "gone", "site", "fp", "rep", "seg", "val", "component_id", "fingerprint", "n_words", "runs", "spans", "items", "trigger", "phrase", "lo", "hi", "z", "n_bytes", "n_tokens", "part", "rest", "rank", "start", "length", "ids", "offset", "quality", "y", "l_id", "first", "digest")
    return messy.select("*", *(F.lit(7).alias(n) for n in names))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (5, None, None), (6, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def benchmark_items(spark):
    rows = [(r[0], r[1]) for r in messy_rows()[100 - 36 : 100 - 33]]
    return spark.createDataFrame([(1, " ".join((messy_rows()[3][1] or "").split()[5:30])), (2, "Two WORDS"), (3, ""), (4, None), (None, "one"), (12, "nowhere to be found at all in any of these texts"), (1, "one"), *((500 + i, x[1]) for i, x in enumerate(rows))], "item_id long, text string")
