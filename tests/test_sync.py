from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions.embedding import hashing
from tessera.operators import blobs, incremental, sync

KEYS = "account string, folder string, uidvalidity long, uid string"


def keys(spark, rows, more=""):
    return spark.createDataFrame(rows, KEYS + more)


def test_new_and_missing(spark):
    remote = keys(spark, [("a", "INBOX", 1, "1"), ("a", "INBOX", 1, "3"), ("a", "INBOX", 2, "1")])
    local = keys(spark, [("a", "INBOX", 1, "1", None), ("a", "INBOX", 1, "2", None), ("a", "Sent", 1, "9", None), ("a", "INBOX", 1, "8", "2024-01-01")], ", deleted_at string").withColumn("deleted_at", F.to_timestamp("deleted_at"))
    assert {r["uid"] + str(r["uidvalidity"]) for r in sync.new_uids(remote, local).collect()} == {"31", "12"}
    assert {r["uid"] for r in sync.missing_uids(local, remote).collect()} == {"2", "9"}
    gone = {r["uid"]: r["deleted_at"] is not None for r in sync.soft_delete_missing(local, remote, F.current_timestamp()).collect()}
    assert gone == {"1": False, "2": True, "9": False, "8": True}  # nothing is known of Sent, so nothing there is deleted
    known = spark.createDataFrame([("a", "Sent")], "account string, folder string")
    assert {r["uid"] for r in sync.soft_delete_missing(local, remote, F.current_timestamp(), known).where("deleted_at is not null").collect()} == {"9", "8"}


def test_upsert(spark):
    schema = KEYS + ", subject string, message_id string, updated_at int, deleted_at string"
    current = spark.createDataFrame([("a", "f", 1, "1", "old", "m1", 1, "gone"), ("a", "f", 1, "2", "keep", "m2", 1, None)], schema)
    incoming = spark.createDataFrame([("a", "f", 1, "1", "new", "mX", 2, None), ("a", "f", 1, "3", "fresh", "m3", 2, None)], schema)
    out = {r["uid"]: (r["subject"], r["message_id"], r["deleted_at"]) for r in sync.upsert(current, incoming, kept=("message_id",)).collect()}
    assert out == {"1": ("new", "m1", None), "2": ("keep", "m2", None), "3": ("fresh", "m3", None)}
    again = sync.upsert(sync.upsert(current, incoming), incoming)
    assert again.count() == 3
    folders = spark.createDataFrame([("a", "INBOX", "/", 1, 7, True)], "account string, name string, delimiter string, uidvalidity long, last_uid long, selectable boolean")
    seen = spark.createDataFrame([("a", "INBOX", ".", 2, 0, False), ("a", "New", ".", 5, 0, True)], folders.schema)
    got = {r["name"]: tuple(r)[2:] for r in sync.upsert_folders(folders, seen).collect()}
    assert got == {"INBOX": (".", 2, 7, False), "New": (".", 5, 0, True)}
    changed = sync.partial_update(folders, spark.createDataFrame([("a", "INBOX", None, 9)], "account string, name string, uidvalidity long, last_uid long"), ["account", "name"]).first()
    assert (changed["uidvalidity"], changed["last_uid"]) == (1, 9)


def test_children(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "message_pk long, chunk_index int, text string")
    fresh = spark.createDataFrame([(1, 0, "x")], old.schema)
    assert {tuple(r) for r in sync.replace_children(old, fresh, "message_pk").collect()} == {(1, 0, "x"), (2, 0, "c")}
    parents = spark.createDataFrame([(2,)], "id long")
    assert sync.cascade(old, parents, "message_pk", "id").count() == 1


def test_copies(spark):
    rows = spark.createDataFrame([(1, "a", "INBOX", "m"), (2, "a", "Sent", "m"), (3, "a", "INBOX", "m"), (4, "b", "Sent", "m"), (5, "a", "X", ""), (6, "a", "Y", None)], "message_pk long, account string, folder string, message_id string")
    assert {r["message_pk"]: r["duplicate_of"] for r in sync.first_copies(rows).collect()} == {1: None, 2: 1, 3: None, 4: None, 5: None, 6: None}
    own = rows.withColumn("uidvalidity", F.lit(3)).withColumn("uid", F.lit("7")).select("message_pk", sync.dedup_key().alias("k"))
    assert {r["message_pk"]: r["k"] for r in own.where("message_pk in (1, 5)").collect()} == {1: "mid:m", 5: "uid:X:3:7"}


def test_folder_plans(spark):
    folders = spark.createDataFrame([("a", n, e, u) for n, e, u in (("fresh", 0, 0), ("known", 1, 5), ("reset", 1, 5), ("empty", 1, 5), ("lost", 1, 5))], "account string, name string, uidvalidity long, last_uid long")
    status = spark.createDataFrame([("a", "fresh", 9, 4), ("a", "known", 1, 9), ("a", "reset", 2, 9), ("a", "empty", 1, 0), ("a", "lost", None, None)], "account string, name string, epoch long, messages long")
    got = {r["name"]: (r["request"], r["start_uid"], r["reset"]) for r in sync.plan_folders(folders, status).collect()}
    assert got == {"fresh": ("all", 0, False), "known": ("newer", 5, False), "reset": ("all", 0, True), "empty": ("none", 5, False), "lost": ("unknown", 5, False)}
    assert {r["request"] for r in sync.plan_folders(folders, status, full=True).where("name = 'known'").collect()} == {"all"}


def test_budget_and_watermarks(spark):
    fresh = spark.createDataFrame([("a", "INBOX", 0, u) for u in ("1", "2", "10")] + [("a", "Sent", 1, u) for u in ("4", "5")], "account string, folder string, folder_order int, uid string")
    planned = sync.within_budget(fresh, 4)
    assert {(r["folder"], r["uid"]) for r in planned.where("not taken").collect()} == {("Sent", "5")}
    marks = {r["folder"]: (r["taken"], r["skipped"], r["last_uid"], r["truncated"]) for r in sync.watermarks(planned).collect()}
    assert marks == {"INBOX": (3, 0, 10, False), "Sent": (1, 1, 4, True)}
    cut = {(r["uid"]) for r in sync.within_budget(fresh, 2).where("taken").collect()}
    assert cut == {"1", "2"}  # uids compare as numbers
    assert sync.within_budget(fresh, None).where("taken").count() == 5


def test_reconcile_and_status(spark):
    now = F.lit("2024-03-02 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([(1, None, False), (2, "2024-03-02 00:00:00", False), (3, "2024-03-01 00:00:00", False), (4, None, True)], "id int, t string, cut boolean").withColumn("last_full_scan_at", F.to_timestamp("t"))
    due = lambda **o: {r["id"] for r in rows.where(sync.reconcile_due(now=now, truncated="cut", **o)).collect()}
    assert due() == {1, 3} and due(forced=True) == {1, 2, 3} and due(enabled=False) == set() and due(hours=0) == set()
    schema = "folder string, status string, fetched long, archived long, skipped long, failed long, deleted long, error_summary string"
    run = lambda *r: tuple(sync.merge_results(spark.createDataFrame(list(r), schema)).select("status", "failed_folders", "archived").first())
    assert run(("a", "success", 3, 3, 0, 0, 0, ""), ("b", "failed", 0, 0, 0, 0, 0, "down")) == ("partial", ["b"], 3)
    assert run(("a", "success", 3, 3, 0, 0, 0, "")) == ("success", [], 3)
    assert run(("a", "partial", 3, 2, 0, 1, 0, "x")) == ("partial", [], 2)
    assert run(("a", "failed", 3, 0, 0, 3, 0, "x")) == ("failed", ["a"], 0)
    assert [r["id"] for r in sync.recent(rows, 2).collect()] == [4, 3]


def test_folder_selection(spark):
    there = spark.createDataFrame([("INBOX", True), ("Spam", True), ("All", False)], "name string, selectable boolean")
    assert {r["name"] for r in sync.select_folders(there, excluded=["spam"]).collect()} == {"INBOX"}
    asked = {r["name"]: (r["position"], r["found"]) for r in sync.select_folders(there, ["Spam", "INBOX", "Nope"], ["SPAM"]).collect()}
    assert asked == {"INBOX": (1, True), "Nope": (2, False)}


def mails(spark, rows):
    schema = "message_pk long, message_id string, subject string, sender string, date_utc timestamp, folder string, body_text string, indexed_at int, updated_at int, deleted_at int, duplicate_of long"
    return spark.createDataFrame([(pk, f"m{pk}", subject, "s", None, "INBOX", body, indexed, 2, None, copy) for pk, subject, body, indexed, copy in rows], schema)


def test_incremental_index(spark):
    backend = hashing(64)
    text = "A first paragraph that is long enough to be its own unit of text here, surely more than sixteen tokens long.\n\n" * 1
    rows = [(1, "s", text, None, None), (2, "s", "", None, None), (3, "s", text, 3, None), (4, "s", text, None, 1)]
    own = mails(spark, rows)
    assert {r["message_pk"] for r in incremental.pending(own).collect()} == {1, 2}
    empty = incremental.rebuild(own.limit(0), backend)
    first = incremental.index(own, empty, backend)
    assert {r["message_pk"] for r in first.collect()} == {1}
    kept = spark.createDataFrame(first.collect(), first.schema)
    again = incremental.with_vectors(incremental.chunked(incremental.pending(own)), kept, backend)
    counts = incremental.counters(incremental.pending(own), again).first()
    assert (counts["messages"], counts["chunks"], counts["reused"], counts["embedded"], counts["failed"]) == (2, 1, 1, 0, 0)
    renamed = incremental.with_vectors(incremental.chunked(mails(spark, [(1, "other subject", text, None, None)])), kept, backend)
    assert renamed.where("reused").count() == 0  # the subject is embedded too
    other = incremental.with_vectors(incremental.chunked(incremental.pending(own)), kept.withColumn("model", F.lit("older")), backend)
    assert other.where("reused").count() == 0
    assert {r["message_pk"] for r in incremental.rebuild(own, backend).collect()} == {1, 3}
    assert incremental.removed(kept, own.where("message_pk = 1")).count() == 0


def test_blobs(spark):
    a, b = "a" * 64, "b" * 64
    rows = spark.createDataFrame([(1, a, "f", "x.txt"), (2, a, "f", "x.txt"), (3, b, "f", "X.txt"), (4, None, "g", "x.txt"), (5, "bad", "g", "../y")], "attachment_id long, sha256 string, folder string, filename string")
    plan = {r["attachment_id"]: (r["reused"], r["blob_path"]) for r in blobs.plan_writes(rows, spark.createDataFrame([(b,)], "sha256 string")).collect()}
    assert plan == {1: (False, f"blobs/aa/aa/{a}"), 2: (True, f"blobs/aa/aa/{a}"), 3: (True, f"blobs/bb/bb/{b}"), 4: (False, None), 5: (False, None)}
    names = {r["attachment_id"]: r["target"] for r in blobs.target_names(rows).collect()}
    assert names == {1: "x.txt", 2: "x_1.txt", 3: "X_2.txt", 4: "x.txt", 5: "_y"}
    own = rows.select("attachment_id", "sha256", F.concat(F.lit("p"), F.col("attachment_id").cast("string")).alias("local_path"), F.lit(True).alias("downloaded"))
    files = spark.createDataFrame([("p1", a, 5), ("p2", b, 5), ("p3", b, 7), ("p4", b, 1)], "path string, sha256 string, length long")
    seen = blobs.verification(own, files, files.where("path = 'p1'").select("sha256"), deep=True)
    assert {r["attachment_id"]: r["state"] for r in seen.collect()} == {1: "ok", 2: "corrupted", 3: "missing_blob", 4: "ok", 5: "missing_file"}
    assert blobs.verification_summary(seen).first()["healthy"] is False
    stats = blobs.blob_statistics(spark.createDataFrame([(a, 10), (b, 4)], "sha256 string, length long"), rows).first()
    assert (stats["blobs"], stats["bytes"], stats["references"], stats["saved_bytes"]) == (2, 14, 3, 10)
    assert {r["attachment_id"]: r["action"] for r in blobs.migration(own, files.where("path = 'p3'").select("sha256")).collect()} == {1: "adopt", 2: "relink", 3: "relink", 4: "unknown", 5: "unknown"}
    assert blobs.views(own, files).where("exists").count() == 4
    stored = blobs.stored(rows.withColumn("payload", F.lit(b"x"))).count()
    assert stored == 2


def test_keys_must_match(spark):
    with pytest.raises(Exception):  # noqa: B017
        sync.new_uids(keys(spark, [("a", "f", 1, "1")]).drop("uid"), keys(spark, [])).count()


def _handed(rows, gone):
    """One message after another, by hand."""
    up, left = {k: d for k, _, d in rows}, [r for r in rows if r[0] not in gone]

    def top(d):
        while d in gone and up.get(d) is not None:
            d = up[d]
        return d

    to = {k: top(d) if d in gone and d in up else d for k, _, d in left}
    folder, out = {k: f for k, f, _ in left}, {}
    for k, f, _ in left:
        d = to[k]
        if d in gone and d in up:
            heir = min(x for x in to if to[x] == d)
            d = heir if heir != k and folder[heir] != f else None
        out[k] = d
    return out


def test_copies_are_handed_on(spark):
    import random

    r = random.Random(4)
    rows = [(i, r.choice("abc") if i % 17 else None, r.choice([None, *range(max(1, i - 6), i)]) if i > 1 else None) for i in range(1, 120)]
    rows += [(200 + i, "x" if i % 2 else "y", 200 + i - 1 if i else None) for i in range(40)]  # a long chain
    own = spark.createDataFrame(rows, "message_pk long, folder string, duplicate_of long")
    for gone in (set(), {1}, {k for k, _, _ in rows if k % 3 == 0}, set(range(200, 239)), {5, 7, 999, None}, {k for k, _, _ in rows}):
        lost = spark.createDataFrame([(g, g) for g in gone], "message_pk long, folder long")
        out = sync.handed_on(own, lost)
        assert out.columns == own.columns
        assert {x["message_pk"]: x["duplicate_of"] for x in out.collect()} == _handed(rows, gone - {None})
        bare = {x["message_pk"]: x["duplicate_of"] for x in sync.handed_on(own, lost, heirs=False).collect()}
        assert bare == {k: None if d in gone else d for k, _, d in rows if k not in gone}
    circle = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (3, "c", 1), (4, "d", 1)], own.schema)
    import pytest

    with pytest.raises(RuntimeError, match="circle"):
        sync.handed_on(circle, circle.where("message_pk < 4"))


def test_stored_contents_are_repaired(spark):
    import hashlib

    h = lambda b: hashlib.sha256(b).hexdigest()
    place = lambda d: f"blobs/{d[:2]}/{d[2:4]}/{d}"
    a, b, c, d = (h(x) for x in (b"a", b"b", b"c", b"d"))
    attachments = spark.createDataFrame([(1, a, "p1", True), (2, a, "gone", True), (3, b, "p3", True), (4, b, "p1", True), (5, c, "p5", True), (6, d, "p6", False), (7, "none", "p7", True), (8, None, None, None), (3, b, "p3", True)], "attachment_id long, sha256 string, local_path string, downloaded boolean")
    files = spark.createDataFrame([("p1", b"a"), ("p3", b"b"), ("p5", b"changed"), ("p9", b"b"), ("p0", None), ("p3", b"b")], "path string, payload binary")
    stored = spark.createDataFrame([(a, b"a"), (b, b"damaged"), (d, None), (a, b"a")], "sha256 string, payload binary")
    contents, out = blobs.repair(attachments, files, stored)
    assert [(x["sha256"], x["blob_path"], bytes(x["payload"])) for x in contents.collect()] == [(b, place(b), b"b")]
    got = sorted((x["attachment_id"], x["repaired"], x["local_path"], x["downloaded"], x["skip_reason"]) for x in out.collect() if x["attachment_id"] < 8)
    assert got == [(1, "ok", "p1", True, None), (2, "relinked", place(a), True, None), (3, "restored", "p3", True, None), (3, "restored", "p3", True, None), (4, "restored", place(b), True, None), (5, "lost", "p5", False, "lost"), (6, None, "p6", False, None), (7, None, "p7", True, None)]
    whole = stored.where("sha256 = '" + a + "'").unionByName(contents.select("sha256", "payload"))
    again = blobs.repair(out.drop("repaired"), files, whole)
    assert again[0].count() == 0 and {x["repaired"] for x in again[1].collect()} == {"ok", "relinked", None}
    assert blobs.repair(attachments.limit(0), files, stored)[1].count() == 0


def test_merged_is_upsert_where_few_keys_repeat(spark):
    """What a sync writes: rows whose key stands alone stay as they are, repeated ones are merged, null keys among them."""
    columns = "account string, folder string, uidvalidity long, uid string, message_pk long, body string, updated_at long, deleted_at long"
    old = spark.createDataFrame([("a", "f", 1, "1", 1, "alone", 1, 9), ("a", "f", 1, "2", 2, "old", 1, 9), ("a", "f", None, None, 3, "null key", 1, None)], columns)
    new = spark.createDataFrame([("a", "f", 1, "2", 12, "new", 2, None), ("a", "f", 1, "3", 13, "fresh", 2, None), ("a", "f", 1, "3", 13, "fresh", 2, None), ("a", "f", None, None, 14, "later", 2, None)], columns)
    want = sync.upsert(old, new, kept=("message_pk",))
    got = sync.merged(old, new, kept=("message_pk",))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 4
    assert sorted(r["body"] for r in sync.merged(old, new.where("uid = '3'").limit(1)).collect()) == ["alone", "fresh", "null key", "old"]
    alone = sync.merged(old, new.where("uid = '3'").limit(1)).groupBy("body").count()  # without repeats nothing but this count is shuffled
    assert alone._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    plan = sync.within_budget(new.withColumn("folder_order", F.col("folder")), None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
