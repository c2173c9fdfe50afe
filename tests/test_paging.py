"""Pages by key equal those by offset and read the files they lie in; work that is called off leaves the tables as they were."""

from __future__ import annotations

import random
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.archive import Archive
from tessera.functions.embedding import Backend
from tessera.operators.paging import SortedPages
from tessera.sources.cancel import Cancelled

ROWS = "message_pk long, date_utc timestamp, folder string"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    r = random.Random(6)
    rows = [(i, None if i % 50 == 0 else datetime(2024, 1, 1) + timedelta(hours=r.randint(0, 300)), f"f{i % 40}") for i in range(3000)]
    own = SortedPages(spark, str(tmp_path_factory.mktemp("pages") / "p"))
    with pytest.raises(LookupError):
        own.page(5)
    own.build(spark.createDataFrame(rows[:10], ROWS))
    own.build(spark.createDataFrame(rows, ROWS).repartition(3), rows_per_file=200)
    return own, sorted(rows, key=lambda x: (x[1] is not None, x[1] or datetime.min, x[0]), reverse=True)


def test_pages_follow_each_other(pages):
    own, rows = pages
    seen, after = [], None
    for _ in range(8):
        page = own.page(37, after)
        assert page.files <= 2
        seen += [r["message_pk"] for r in page.rows.collect()]
        after = page.next
    assert seen == [r[0] for r in rows[: 8 * 37]]


def test_the_end_and_rows_without_a_time(pages):
    own, rows = pages
    last = own.page(2990)
    rest = own.page(37, last.next)
    assert [r["message_pk"] for r in rest.rows.collect()] == [r[0] for r in rows[2990:]] and rest.next is None and rest.files == 1
    assert own.page(3000).next is not None and own.page(5, own.page(3000).next).rows.collect() == []


def test_conditions_reach_further(pages):
    own, rows = pages
    want = [r[0] for r in rows if r[2] == "f7"]
    first = own.page(20, where=F.col("folder") == "f7")
    second = own.page(20, first.next, F.col("folder") == "f7")
    assert [r["message_pk"] for p in (first, second) for r in p.rows.collect()] == want[:40] and first.files > 1
    assert own.page(5, where=F.lit(False)).rows.collect() == []


RAW = "account string, folder string, uidvalidity long, uid string, size_bytes long, content binary"


def raw(spark, n: int):
    return spark.createDataFrame([("a", "INBOX", 1, str(i), 60, bytearray(f"Subject: s{i}\r\nMessage-ID: <m{i}@x>\r\nDate: Mon, 01 Jan 2024 10:{i:02d}:00 +0000\r\n\r\nbody {i}\r\n".encode())) for i in range(1, n + 1)], RAW)


def embedder(seconds: float) -> Backend:
    """One vector for all texts, after a while; a closure, so that it goes to the workers by value."""

    def run(texts: list[str]) -> list[list[float]]:
        time.sleep(seconds)
        return [[1.0, 0.0] for _ in texts]

    return Backend("closure", run, 2)


def test_an_index_run_that_is_called_off(spark, tmp_path):
    own = Archive(spark, str(tmp_path / "a"), embedder=embedder(0))
    own.sync(raw(spark, 12))
    own.index()
    own.sync(raw(spark, 20))
    before = {n: own.store(n).parts() for n in ("messages", "chunks")}
    busy = Archive(spark, str(tmp_path / "a"), embedder=embedder(60))
    found: list[BaseException] = []

    def run():
        try:
            busy.index()
        except BaseException as e:  # noqa: BLE001
            found.append(e)

    begun = time.time()
    worker = threading.Thread(target=run)
    worker.start()
    time.sleep(8)
    own.cancellation().call_off()
    worker.join(50)
    assert not worker.is_alive() and time.time() - begun < 58 and isinstance(found[0], Cancelled)
    assert {n: own.store(n).parts() for n in ("messages", "chunks")} == before
    own.index()
    assert own.table("chunks").select("message_pk").distinct().count() == 20
    own.build_pages()
    page = own.page_after(limit=8)
    assert [r["subject"] for r in page.rows.collect()] == [f"s{i}" for i in range(20, 12, -1)] and [r["subject"] for r in own.page_after(page.next, 8).rows.collect()] == [f"s{i}" for i in range(12, 4, -1)]


def test_a_call_between_steps(spark, tmp_path):
    own = Archive(spark, str(tmp_path / "a"), embedder=embedder(0))
    with pytest.raises(Cancelled), own.cancellation().work() as work:
        work.check()
        own.cancellation().call_off()
        work.check()
    with own.cancellation().work() as work:
        work.check()
        assert spark.range(3).count() == 3
