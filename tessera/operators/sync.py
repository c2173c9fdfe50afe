"""Incremental sync as set operations: what is new, what is gone, watermarks, epochs, budgets, merges and run status."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written

KEY = ["account", "folder", "uidvalidity", "uid"]


def new_uids(remote: DataFrame, local: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Remote rows that are not local yet."""
    return remote.join(local.select(*keys), keys, "left_anti")


def missing_uids(local: DataFrame, remote: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Live local rows that are not remote any more; epochs count."""
    return local.where(F.col("deleted_at").isNull()).join(remote.select(*keys), keys, "left_anti")


def soft_delete_missing(local: DataFrame, remote: DataFrame, now: Column, known: DataFrame | None = None, keys: list[str] = KEY) -> DataFrame:
    """local with deleted_at set where a live row is missing. known: the folders (account, folder) whose remote list is
    known to be whole; rows of other folders are left alone. By default those with any remote row."""
    whole = (remote if known is None else known).select("account", "folder").distinct().withColumn("__known", F.lit(True))
    there = remote.select(*keys).distinct().withColumn("__there", F.lit(True))
    marked = local.join(there, keys, "left").join(whole, ["account", "folder"], "left")
    gone = F.col("deleted_at").isNull() & F.col("__there").isNull() & F.coalesce("__known", F.lit(False))
    return marked.withColumn("deleted_at", F.when(gone, now).otherwise(F.col("deleted_at"))).select(local.columns)


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str] = KEY, kept: tuple[str, ...] = (), order: str = "updated_at", revive: str | None = "deleted_at") -> DataFrame:
    """One row a key: the newest one's values, but columns in `kept` as the oldest row has them, and `revive` null where
    an incoming row has the key. Both frames have the same columns."""
    rows = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    values = [c for c in current.columns if c not in keys]
    newest = F.struct("__new", order)
    last, first = [c for c in values if c not in kept and c != revive], [c for c in values if c in kept and c != revive]
    aggs = [pick(F.struct(*names), newest).alias(name) for pick, names, name in ((F.max_by, last, "__last"), (F.min_by, first, "__first")) if names]  # a row's values as one
    if revive:
        aggs.append(F.when(F.max("__new") == 1, None).otherwise(F.max(revive)).alias(revive))
    out = rows.groupBy(*keys).agg(*aggs)
    return out.select([F.col(f"__last.{c}") if c in last else F.col(f"__first.{c}") if c in first else F.col(c) for c in current.columns])


def merged(current: DataFrame, incoming: DataFrame, keys: list[str] = KEY, **how) -> DataFrame:
    """What upsert() gives, for rows that are large: those whose key no other row has stay where they are, and only the others
    are brought together. An incoming row has nothing in the column to revive. Keys that several rows have are written as a
    table of their own, whose size is known then."""
    rows = current.withColumn("__late", F.lit(False)).unionByName(incoming.withColumn("__late", F.lit(True)))
    again = written(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(k).alias(f"__{k}") for k in keys]), "sync-again")
    if again.isEmpty():
        return rows.drop("__late")
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    several = rows.join(again, same, "left_semi")
    both = upsert(several.where("not __late").drop("__late"), several.where("__late").drop("__late"), keys, **how)
    return rows.join(again, same, "left_anti").drop("__late").unionByName(both)


def upsert_folders(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Folders by account and name: delimiter, epoch and selectable of the incoming row, watermark and times of the current."""
    a, b = current.alias("a"), incoming.alias("b")
    taken = ("delimiter", "uidvalidity", "selectable")
    cols = [F.coalesce(f"b.{c}", f"a.{c}") if c in taken else F.coalesce(f"a.{c}", f"b.{c}") for c in current.columns if c not in ("account", "name")]
    names = [c for c in current.columns if c not in ("account", "name")]
    joined = a.join(b, (F.col("a.account") == F.col("b.account")) & (F.col("a.name") == F.col("b.name")), "full")
    return joined.select(F.coalesce("a.account", "b.account").alias("account"), F.coalesce("a.name", "b.name").alias("name"), *[c.alias(n) for c, n in zip(cols, names, strict=True)]).select(current.columns)


def partial_update(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Only what a change gives (not null) is taken."""
    a, b = current.alias("a"), changes.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    return a.join(b, on, "left").select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) if c in changes.columns and c not in keys else F.col(f"a.{c}") for c in current.columns])


def replace_children(current: DataFrame, fresh: DataFrame, parent: str, parents: DataFrame | None = None) -> DataFrame:
    """Children of the given parents (by default those with fresh children) are replaced as a whole."""
    redone = (fresh if parents is None else parents).select(parent).distinct()
    return current.join(redone, parent, "left_anti").unionByName(fresh)


def cascade(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def first_copies(messages: DataFrame) -> DataFrame:
    """messages with duplicate_of: the least other id in another folder of the account with the same Message-ID, for all
    but the first; null for messages without a Message-ID."""
    first = messages.where(F.coalesce("message_id", F.lit("")) != "").groupBy("account", "message_id").agg(F.min_by(F.struct("message_pk", "folder"), "message_pk").alias("__first"))
    joined = messages.join(first, ["account", "message_id"], "left")
    other = (F.col("__first.message_pk") < F.col("message_pk")) & (F.col("__first.folder") != F.col("folder"))
    return joined.withColumn("duplicate_of", F.when(other, F.col("__first.message_pk"))).drop("__first")


def copies_of(fresh: DataFrame, current: DataFrame) -> DataFrame:
    """fresh with duplicate_of: the message with its Message-ID in another folder of the account that was there first, of
    messages that came together the least id. What is there already stays as it is."""
    ids = fresh.where(F.coalesce("message_id", F.lit("")) != "").select("account", "message_id").distinct()
    there = current.select("account", "message_id", "message_pk", "folder", F.lit(0).alias("__late")).join(ids, ["account", "message_id"], "left_semi")
    seen = there.unionByName(fresh.select("account", "message_id", "message_pk", "folder", F.lit(1).alias("__late")).where(F.coalesce("message_id", F.lit("")) != ""))
    first = seen.groupBy("account", "message_id").agg(F.min_by(F.struct("message_pk", "folder"), F.struct("__late", "message_pk")).alias("__first"))
    other = (F.col("__first.message_pk") != F.col("message_pk")) & (F.col("__first.folder") != F.col("folder"))
    pairs = fresh.select("account", "message_id", "message_pk", "folder").join(first, ["account", "message_id"]).where(other)
    copies = written(pairs.select("message_pk", "folder", F.col("__first.message_pk").alias("duplicate_of")).distinct(), "sync-copies")  # often few: texts need not move then
    return fresh.drop("duplicate_of").join(copies, ["message_pk", "folder"], "left")


def handed_on(messages: DataFrame, gone: DataFrame, heirs: bool = True) -> DataFrame:
    """messages without those that are gone (message_pk). What was a copy of one that is gone becomes a copy of what that was a
    copy of, through any number that are gone; where none is left, the least id of these copies is the first now, and the
    others are its copies where they lie in other folders. With heirs false their duplicate_of is null. Nulls and ids that no
    message has change nothing. The way up is found by doubling: rounds follow the logarithm of its length."""
    gone = gone.select("message_pk").where("message_pk is not null").distinct()
    left = messages.join(gone, "message_pk", "left_anti")
    if not heirs:
        dead = gone.select(F.col("message_pk").alias("duplicate_of"), F.lit(True).alias("__dead"))
        return left.join(dead, "duplicate_of", "left").withColumn("duplicate_of", F.when(F.col("__dead").isNull(), F.col("duplicate_of"))).select(messages.columns)
    up = written(messages.join(gone, "message_pk", "left_semi").select(F.col("message_pk").alias("__dead"), F.coalesce("duplicate_of", "message_pk").alias("__up")), "gone")
    for _ in range(64):
        over = up.select(F.col("__dead").alias("__up"), F.col("__up").alias("__over"))
        now = written(up.join(over, "__up", "left").select("__dead", F.coalesce("__over", "__up").alias("__up"), (F.coalesce("__over", "__up") != F.col("__up")).alias("__moved")), "gone")
        up, moved = now.drop("__moved"), now.where("__moved").isEmpty()
        if moved:
            break
    else:
        raise RuntimeError("copies of copies run in a circle")
    joined = left.join(up.withColumnRenamed("__dead", "duplicate_of"), "duplicate_of", "left")
    none_left = up.select(F.col("__up")).join(gone.select(F.col("message_pk").alias("__up")), "__up", "left_semi").distinct()
    first = joined.join(none_left, "__up", "left_semi").groupBy("__up").agg(F.min_by(F.struct("message_pk", "folder"), "message_pk").alias("__first"))
    named = joined.join(first, "__up", "left")
    other = (F.col("__first.message_pk") != F.col("message_pk")) & ~F.col("__first.folder").eqNullSafe(F.col("folder"))
    to = F.when(F.col("__up").isNull(), F.col("duplicate_of")).when(F.col("__first").isNull(), F.col("__up")).when(other, F.col("__first.message_pk"))
    return named.withColumn("duplicate_of", to).select(messages.columns)


def dedup_key(message_id: str = "message_id", folder: str = "folder", epoch: str = "uidvalidity", uid: str = "uid") -> Column:
    by_place = F.concat_ws(":", F.lit("uid"), folder, F.coalesce(F.col(epoch).cast("string"), F.lit("None")), uid)
    return F.when(F.coalesce(F.col(message_id), F.lit("")) != "", F.concat(F.lit("mid:"), message_id)).otherwise(by_place)


def uid_number(uid: str = "uid") -> Column:
    """Uids are texts that compare as numbers; others are 0."""
    return F.coalesce(F.col(uid).try_cast("long"), F.lit(0))


def plan_folders(folders: DataFrame, status: DataFrame, full: bool = False) -> DataFrame:
    """folders (account, name, uidvalidity, last_uid) with what the server says (account, name, epoch, messages): the
    watermark to start from and whether the whole folder is listed. A changed epoch (both known) starts anew; an empty
    folder lists nothing; a folder whose status is unknown (messages null) is not touched."""
    joined = folders.join(status, ["account", "name"], "left")
    reset = (F.coalesce("uidvalidity", F.lit(0)) != 0) & (F.coalesce("epoch", F.lit(0)) != 0) & (F.col("uidvalidity") != F.col("epoch"))
    start = F.when(reset, 0).otherwise(F.coalesce("last_uid", F.lit(0)))
    request = F.when(F.col("messages").isNull(), "unknown").when(F.col("messages") <= 0, "none").when(F.lit(full) | (start <= 0), "all").otherwise("newer")
    return joined.withColumns({"reset": reset, "start_uid": start, "request": request})


def within_budget(fresh: DataFrame, budget: int | None, order: tuple[str, ...] = ("folder_order",)) -> DataFrame:
    """fresh rows with `taken`: folder after folder and uid after uid until the run's budget is used up. A row's place is
    the sum of earlier folders plus its number in its own, so no window spans all rows. Without a budget nothing is numbered."""
    if not budget or budget <= 0:
        return fresh.withColumn("taken", F.lit(True))
    numbered = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(*order).orderBy(uid_number(), "uid")))
    sizes = numbered.groupBy(*order).agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__size")  # a row a folder
    place = F.col("__before") + F.col("__n")
    return numbered.join(before, list(order)).withColumn("taken", place <= budget).drop("__n", "__before")


def watermarks(planned: DataFrame, keys: tuple[str, ...] = ("account", "folder")) -> DataFrame:
    """A row a folder: rows listed and taken, those left for later, and the watermark: the highest uid that was processed
    if the folder was cut short, else the highest listed."""
    n, taken = F.count("*"), F.count_if("taken")
    top, done = F.max(uid_number()), F.max(F.when(F.col("taken"), uid_number()))
    return planned.groupBy(*keys).agg(n.alias("listed"), taken.alias("taken"), (n - taken).alias("skipped"), F.when(n == taken, top).otherwise(F.coalesce(done, F.lit(0))).alias("last_uid"), (n > taken).alias("truncated"))


def reconcile_due(last_full: str = "last_full_scan_at", now: Column | None = None, hours: float = 24, forced: bool = False, enabled: bool = True, truncated: str | None = None) -> Column:
    """Forced, never scanned, or longer ago than the interval; never after a run that was cut short."""
    old = F.col(last_full).isNull() | ((now if now is not None else F.current_timestamp()).cast("double") - F.col(last_full).cast("double") > hours * 3600)
    due = F.lit(enabled) & (F.lit(forced) | (F.lit(hours > 0) & old))
    return due & ~F.col(truncated) if truncated else due


def run_status(failed_folders: Column, failed: Column, error: Column, archived: Column, skipped: Column) -> Column:
    """success, partial or failed."""
    return F.when((failed_folders > 0) & (failed == 0), "partial").when((failed == 0) & (F.coalesce(error, F.lit("")) == ""), "success").when((archived > 0) | (skipped > 0), "partial").otherwise("failed")


def merge_results(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Folder results as one: counts added, failed folders listed, errors joined, and the status."""
    sums = [F.sum(c).alias(c) for c in ("fetched", "archived", "skipped", "failed", "deleted")]
    failed = F.sort_array(F.collect_set(F.when(F.col("status") == "failed", F.col("folder")))).alias("failed_folders")
    errors = F.array_join(F.sort_array(F.collect_list(F.when(F.coalesce("error_summary", F.lit("")) != "", F.col("error_summary")))), "; ").alias("error_summary")
    out = results.groupBy(*keys).agg(*sums, failed, errors)
    return out.withColumn("status", run_status(F.size("failed_folders"), F.col("failed"), F.col("error_summary"), F.col("archived"), F.col("skipped")))


def recent(log: DataFrame, n: int, key: str = "id") -> DataFrame:
    return log.orderBy(F.desc(key)).limit(n)


def select_folders(available: DataFrame, requested: list[str] | None = None, excluded: list[str] = ()) -> DataFrame:
    """name, position, found: what is asked for (or all that can be selected), but for excluded names, whose case does not
    count. Requested names that are not there are rows with found false."""
    spark = available.sparkSession
    out = [x.lower() for x in excluded]
    if not requested:
        return available.where(F.col("selectable") & ~F.lower("name").isin(out) if out else F.col("selectable")).select("name", F.lit(None).cast("int").alias("position"), F.lit(True).alias("found"))
    wanted = spark.createDataFrame([(n, i) for i, n in enumerate(requested)], "name string, position int")
    there = available.select("name").withColumn("__there", F.lit(True))
    kept = wanted if not out else wanted.where(~F.lower("name").isin(out))
    return kept.join(there, "name", "left").select("name", "position", F.coalesce("__there", F.lit(False)).alias("found"))
