"""Progress with state over several batches and starts: counters, the bounded log, runs that stall, runs that are forgotten."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tessera.streaming import run_progress
from tessera.streaming.index_stream import folded

LOG = "run_id string, seq long, event string, folder string, number long, status string, at timestamp"
T0 = datetime(2024, 1, 1)


def row(run: str, seq: int, event: str, minute: float, number: int | None = None, status: str = "", folder: str = "") -> tuple:
    return run, seq, event, folder, number, status, T0 + timedelta(minutes=minute)


BATCHES = [
    [row("a", 1, "run_start", 0), row("a", 3, "message_archived", 2), row("a", 2, "fetch_plan", 1, 10), row("b", 1, "run_start", 0), row("c", 1, "run_start", 0)],
    [row("a", i, "message_archived", 2 + i / 10) for i in range(4, 9)] + [row("a", 9, "message_failed", 4), row("b", 2, "run_done", 5, None, "success")],
    [row("c", 2, "fetch_plan", 50, 3), row("d", 1, "run_start", 300)],
    [row("a", 10, "message_archived", 310), row("b", 7, "run_start", 320), row("d", 2, "message_archived", 700)],
]


@pytest.fixture(scope="module")
def states(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("progress")
    out: list[dict] = []
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(place / "log"))
        stream = run_progress.run_progress(spark.readStream.schema(LOG).parquet(str(place / "log")), kept=4, stall=3600, shown=3)
        stream.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(place / "updates" / f"batch={n}"))).option("checkpointLocation", str(place / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        updates = spark.read.schema(run_progress.OUT + ", batch int").parquet(str(place / "updates"))
        out.append({r["run_id"]: r for r in run_progress.latest(updates).collect()})
    return out


def test_counters_go_on_over_restarts(states):
    want = ("idle", "", 0, 0, 0, 0, 0, 0)
    for r in sorted((x for b in BATCHES[:2] for x in b if x[0] == "a"), key=lambda x: x[1]):
        want = folded(want, r[2], r[3], r[4], r[5])
    got = states[1]["a"]
    assert tuple(got[c] for c in ("phase", "folder", "done", "total", "archived", "failed", "folders_done", "errors")) == want
    assert got["events"] == 9 and got["rate"] > 0 and got["eta"] > 0 and states[0]["a"]["events"] == 3


def test_the_log_is_bounded_and_in_order(states):
    assert states[0]["a"]["last"] == [1, 2, 3] and states[1]["a"]["last"] == [7, 8, 9] and states[3]["a"]["last"] == [8, 9, 10]


def test_a_run_without_events_stalls_and_goes_on(states):
    assert not states[1]["a"]["stalled"] and not states[1]["c"]["stalled"]
    assert states[2]["a"]["stalled"] and states[2]["c"]["stalled"] and not states[2]["d"]["stalled"]
    assert states[2]["a"]["done"] == 7 and states[3]["a"]["done"] == 8 and states[3]["a"]["events"] == 10


def test_a_run_that_has_ended_is_forgotten(states):
    assert states[1]["b"]["phase"] == "done" and not states[2]["b"]["stalled"]
    assert states[3]["b"]["events"] == 1 and states[3]["b"]["last"] == [7]
