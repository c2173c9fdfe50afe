"""Progress of runs as a stream keeps it: counters, the last events of each run, its rate, and whether it has stalled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.streaming.index_stream import STATE, folded, percent

#: Events that are kept of a run; seconds without one after which a run has stalled, and after which an ended one is forgotten.
KEPT, STALL = 200, 1800
OUT = "run_id string, phase string, folder string, done long, total long, archived long, failed long, folders_done long, errors long, percent double, rate double, eta double, stalled boolean, events long, last array<long>"
COUNTERS = f"{STATE}, events long, started long, at long, until long, stalled boolean"
LOG = "seq long, event string, folder string, at long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ENDED = ("done", "partial", "error")


class RunProgress(StatefulProcessor):
    """State of a run: its counters as one value, its last events as a list of bounded length, and one timer. A run without
    events for `stall` seconds is told of once; one that has ended is forgotten then."""

    def __init__(self, kept: int = KEPT, stall: int = STALL, shown: int = 5):
        self.kept, self.stall, self.shown = kept, stall, shown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", COUNTERS)
        self.log = handle.getListState("log", LOG)

    def _row(self, run: str, c: tuple) -> pd.DataFrame:
        own, (events, started, at, _, stalled) = c[:8], c[8:]
        seconds = (at - started) / 1000
        rate = round(own[2] / seconds, 2) if seconds > 0.5 and own[2] > 0 else 0.0
        eta = round((own[3] - own[2]) / rate, 1) if rate > 0 and own[3] > own[2] else None
        last = [int(r[0]) for r in self.log.get()][-self.shown :] if self.shown else []
        return pd.DataFrame([(run, *own, percent(own[2], own[3], own[6]), rate, eta, stalled, events, last)], columns=[x.split()[0] for x in OUT.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = pd.concat(list(rows)).sort_values("seq")  # a run's events of one batch; the source bounds a batch
        before = tuple(self.counters.get()) if self.counters.exists() else ("idle", "", 0, 0, 0, 0, 0, 0, 0, None, 0, None, False)
        own, (events, started, at, until, _) = before[:8], before[8:]
        times = (fresh["at"].astype("int64") // (10**6 if fresh["at"].dtype == "datetime64[ns]" else 10**3)).tolist()
        for r in fresh.itertuples():
            own = folded(own, r.event, r.folder, None if pd.isna(r.number) else r.number, r.status)
        log = [tuple(x) for x in self.log.get()] + [(int(r.seq), r.event, r.folder, t) for r, t in zip(fresh.itertuples(), times, strict=True)]
        self.log.put(sorted(log, key=lambda x: x[0])[-self.kept :])
        started, at = min([*times, *([] if started is None else [started])]), max([at, *times])
        if until is not None:
            self.handle.deleteTimer(until)
        until = at + self.stall * 1000
        self.handle.registerTimer(until)
        own = tuple(int(x) if i > 1 else x for i, x in enumerate(own))
        now = (*own, events + len(fresh), started, at, until, False)
        self.counters.update(now)
        yield self._row(key[0], now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = tuple(self.counters.get())
        if own[0] in ENDED:
            self.counters.clear()
            self.log.clear()
            return
        now = (*own[:11], None, True)
        self.counters.update(now)
        yield self._row(key[0], now)

    def close(self) -> None:
        pass


def run_progress(stream: DataFrame, delay: str = "10 minutes", kept: int = KEPT, stall: int = STALL, shown: int = 5) -> DataFrame:
    """stream: run_id, seq, event, folder, number, status, at (timestamp). In update mode: a row a run and batch that has
    events of it, and one when it has stalled. Event time decides: events later than `delay` are not counted."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    own = stream.select("run_id", "seq", "event", "folder", "number", "status", "at").withWatermark("at", delay)
    return own.groupBy("run_id").transformWithStateInPandas(RunProgress(kept, stall, shown), OUT, "Update", "EventTime")


def latest(updates: DataFrame, order: str = "batch") -> DataFrame:
    """The last row of each run among the updates of several batches; a stalled row of a batch comes after its others."""
    columns = [c for c in updates.columns if c not in ("run_id", order)]
    best = F.max_by(F.struct(*columns), F.struct(order, "stalled")).alias("r")
    return updates.groupBy("run_id").agg(best).select("run_id", "r.*")
