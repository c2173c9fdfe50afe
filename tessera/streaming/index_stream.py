"""Structured Streaming around the archive: new mail into tables, copies dropped, progress kept, activity by time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.sync import upsert
from tessera.sources.scratch import written
from tessera.sources.store import Table


#: Parts of a merged table: a micro-batch writes those that hold its keys.
PARTS = 64


def merge_batches(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Each micro-batch is merged into a table by parts, of which it writes those that hold its keys. A batch that runs again
    brings the same newest rows, so the result is the same."""
    spark = stream.sparkSession
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    table = Table(spark, path, schema)
    part = F.lpad(F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("string"), 2, "0")

    def merge(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(*[F.max_by(c, order).alias(c) for c in batch.columns if c not in keys]).select(batch.columns)
        newest = written(newest.withColumn("part", part), "micro-batch")
        touched = [r["part"] for r in newest.select("part").distinct().collect()]
        if touched:
            before = table.read(touched).select(batch.columns)
            table.write(written(upsert(before, newest.drop("part"), keys, order=order, revive=None).withColumn("part", part), "merged"), touched)

    spark.createDataFrame([(schema,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark, path: str) -> DataFrame:
    """The merged table as it is now."""
    return Table(spark, path, spark.read.text(f"{path}/schema").first()[0]).read()


def without_copies(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each key; state is kept as long as copies may come."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def activity(stream: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Events and their values by window and kind. An extension: the archive itself has no event-time windows."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, delay) if stream.isStreaming else stream
    return out.groupBy(window.alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), kind, "n", "value")


def sessions(events: DataFrame, user: str = "user_id", time: str = "ts", gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    out = events.withWatermark(time, delay) if events.isStreaming else events
    return out.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


COUNTERS = {"message_archived": "archived", "message_failed": "failed", "folder_done": "folders_done", "error": "errors"}
PROGRESS = "run_id string, phase string, folder string, done long, total long, archived long, failed long, folders_done long, errors long, percent double"
STATE = "phase string, folder string, done long, total long, archived long, failed long, folders_done long, errors long"
#: The phase that an event leads to.
PHASES = {"run_start": "connecting", "fetch_plan": "fetching", "index_start": "indexing", "error": "error"}


def folded(state: tuple, event: str, folder: str | None, number: int | None, status: str | None) -> tuple:
    """The progress of a run after one more event."""
    phase, current, done, total, archived, failed, folders, errors = ("connecting", "", 0, 0, 0, 0, 0, 0) if event == "run_start" else state
    phase = PHASES.get(event, phase)
    if event == "folder_start":
        current = folder or ""
    elif event == "fetch_plan":
        done, total = 0, int(number or 0)
    elif event in ("message_archived", "message_failed"):
        done += 1
    elif event == "run_done":
        phase, current = {"success": "done", "partial": "partial"}.get(status or "", "error"), ""
    bump = {c: int(COUNTERS.get(event) == c) for c in COUNTERS.values()}
    return phase, current, done, total, archived + bump["archived"], failed + bump["failed"], folders + bump["folders_done"], errors + bump["errors"]


def percent(done: int, total: int, folders: int) -> float:
    return round(done * 100 / total, 1) if total else 100.0 if folders else 0.0


def rates(progress: DataFrame, started: str = "started_at", now: Column | None = None) -> DataFrame:
    """progress with elapsed seconds, messages a second, and the seconds that are left (null if that cannot be told)."""
    elapsed = ((now if now is not None else F.current_timestamp()).cast("double") - F.col(started).cast("double")).alias("elapsed")
    rate = F.when((F.col("elapsed") > 0.5) & (F.col("done") > 0), F.bround(F.col("done") / F.col("elapsed"), 2)).otherwise(0.0)
    return progress.withColumn("elapsed", elapsed).withColumn("rate", rate).withColumn("eta", F.when((F.col("rate") > 0) & (F.col("total") > F.col("done")), F.bround((F.col("total") - F.col("done")) / F.col("rate"), 1)))


def progress(stream: DataFrame) -> DataFrame:
    """stream: run_id, seq, event, folder, number, status. The state of each run after each of its batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = state.get if state.exists else ("idle", "", 0, 0, 0, 0, 0, 0)
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            own = folded(own, r.event, r.folder, None if pd.isna(r.number) else r.number, r.status)
        state.update(own)
        yield pd.DataFrame([(key[0], *own, percent(own[2], own[3], own[6]))], columns=[c.split()[0] for c in PROGRESS.split(", ")])

    return stream.groupBy("run_id").applyInPandasWithState(step, PROGRESS, STATE, "update", GroupStateTimeout.NoTimeout)


def batch_progress(events: DataFrame) -> DataFrame:
    """The counters of progress() over a finished log, by expressions only."""
    last_plan = F.max_by("number", F.when(F.col("event") == "fetch_plan", F.col("seq")))
    plan_at = events.where("event = 'fetch_plan'").groupBy("run_id").agg(F.max("seq").alias("__at"))
    own = events.join(plan_at, "run_id", "left")
    done = F.count_if(F.col("event").isin("message_archived", "message_failed") & (F.col("seq") > F.coalesce("__at", F.lit(-1))))
    counts = [F.count_if(F.col("event") == e).alias(c) for e, c in COUNTERS.items()]
    return own.groupBy("run_id").agg(done.alias("done"), F.coalesce(last_plan, F.lit(0)).alias("total"), *counts)
