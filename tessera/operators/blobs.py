"""Attachments by their content: which are written, which reuse, what a check of the files finds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import blob_path, is_digest, safe_filename


def plan_writes(attachments: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """attachments (attachment_id, sha256, …) with blob_path, reused and skip_reason: of equal contents the first is
    written unless it is known, the others reuse it. The first is found by aggregation, so a content that very many
    attachments have is no burden."""
    first = attachments.where(is_digest("sha256")).groupBy("sha256").agg(F.min("attachment_id").alias("__first"))
    out = attachments.join(first, "sha256", "left")
    if known is not None:
        out = out.join(known.select("sha256").distinct().withColumn("__known", F.lit(True)), "sha256", "left")
    else:
        out = out.withColumn("__known", F.lit(None).cast("boolean"))
    reused = F.coalesce(F.col("__known"), F.col("attachment_id") != F.col("__first"), F.lit(False))
    return out.withColumns({"blob_path": blob_path("sha256"), "reused": reused, "skip_reason": F.when(reused, "reused")}).drop("__first", "__known")


def target_names(attachments: DataFrame, folder: str = "folder", name: str = "filename", key: str = "attachment_id") -> DataFrame:
    """attachments with target: the safe name, _1, _2 … before the ending where a folder has it already."""
    safe = attachments.withColumn("__name", safe_filename(name, 120, "attachment"))
    n = F.row_number().over(Window.partitionBy(folder, F.lower("__name")).orderBy(key)) - 1
    stem, ending = F.regexp_extract("__name", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("__name", r"^(.+?)(\.[^.]*)?$", 2)
    return safe.withColumn("__n", n).withColumn("target", F.when(F.col("__n") > 0, F.concat(stem, F.lit("_"), F.col("__n").cast("string"), ending)).otherwise(F.col("__name"))).drop("__name", "__n")


def stored(attachments: DataFrame) -> DataFrame:
    """sha256, blob_path, payload: one row a content."""
    return attachments.where(is_digest("sha256") & F.col("payload").isNotNull()).groupBy("sha256").agg(F.first("payload").alias("payload")).select("sha256", blob_path("sha256").alias("blob_path"), "payload")


def views(attachments: DataFrame, files: DataFrame) -> DataFrame:
    """attachments with exists and size_on_disk. files: path, length."""
    return attachments.join(files.select(F.col("path").alias("local_path"), F.col("length").alias("size_on_disk")), "local_path", "left").withColumn("exists", F.col("size_on_disk").isNotNull())


def verification(attachments: DataFrame, files: DataFrame, blobs: DataFrame, deep: bool = False) -> DataFrame:
    """A row a downloaded attachment with state: missing_file, corrupted (deep: another hash than it should have),
    missing_blob, ok. files: path, sha256; blobs: sha256."""
    own = attachments.where("downloaded").join(files.select(F.col("path").alias("local_path"), F.col("sha256").alias("__hash")).withColumn("__file", F.lit(True)), "local_path", "left")
    own = own.join(blobs.select("sha256").distinct().withColumn("__blob", F.lit(True)), "sha256", "left")
    bad = F.lit(deep) & is_digest("sha256") & (F.col("__hash") != F.col("sha256"))
    state = F.when(F.col("__file").isNull(), "missing_file").when(bad, "corrupted").when(is_digest("sha256") & F.col("__blob").isNull(), "missing_blob").otherwise("ok")
    return own.withColumn("state", state).drop("__hash", "__file", "__blob")


def verification_summary(verified: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("ok", "missing_file", "missing_blob", "corrupted")]
    out = verified.agg(F.count("*").alias("checked"), *counts)
    return out.withColumn("healthy", (F.col("missing_file") == 0) & (F.col("corrupted") == 0))


def blob_statistics(blobs: DataFrame, attachments: DataFrame) -> DataFrame:
    """Blobs, their bytes, attachments that point to one, and bytes saved by that."""
    sizes = blobs.groupBy("sha256").agg(F.max("length").alias("length"))
    used = attachments.where(is_digest("sha256")).groupBy("sha256").agg(F.count("*").alias("uses"))
    return sizes.join(used, "sha256", "left").agg(F.count("*").alias("blobs"), F.sum("length").alias("bytes"), F.sum(F.coalesce("uses", F.lit(0))).alias("references"), F.sum(F.greatest(F.coalesce("uses", F.lit(0)) - 1, F.lit(0)) * F.col("length")).alias("saved_bytes"))


def migration(attachments: DataFrame, blobs: DataFrame) -> DataFrame:
    """What a move of old attachments into the blob store would do: already there, to adopt, to relink, or not possible."""
    own = attachments.where("downloaded").join(blobs.select("sha256").distinct().withColumn("__blob", F.lit(True)), "sha256", "left")
    first = own.groupBy("sha256").agg(F.min("attachment_id").alias("__first"))
    state = F.when(~is_digest("sha256"), "unknown").when(F.col("__blob"), "relink").when(F.col("attachment_id") == F.col("__first"), "adopt").otherwise("relink")
    return own.join(first, "sha256", "left").withColumn("action", state).drop("__blob", "__first")


def repair(attachments: DataFrame, files: DataFrame, blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What verification finds wrong, mended. files: path, payload; blobs: sha256, payload. A blob with another hash than its
    name is none. Returns (contents, attachments): contents (sha256, blob_path, payload) are the blobs to write, each from
    the first file by path that still has the content; attachments get repaired: ok, relinked (its file is gone or changed,
    and it points to the blob now), restored (so is its blob, from a file), lost (no copy is left: not downloaded any more,
    skip_reason lost), or null where nothing was to check (not downloaded, no digest). Contents that are whole do not move."""
    wanted = attachments.where(F.col("downloaded") & is_digest("sha256")).select("sha256").distinct()
    good = blobs.where(F.sha2("payload", 256) == F.col("sha256")).select("sha256").distinct()
    hashed = files.where(F.col("payload").isNotNull()).withColumn("__hash", F.sha2("payload", 256))
    missing = wanted.join(good, "sha256", "left_anti")
    source = hashed.select(F.col("__hash").alias("sha256"), "path").join(missing, "sha256", "left_semi").groupBy("sha256").agg(F.min("path").alias("path"))
    found = source.join(hashed.groupBy("path", "__hash").agg(F.first("payload").alias("payload")).withColumnRenamed("__hash", "sha256"), ["sha256", "path"])
    contents = found.select("sha256", blob_path("sha256").alias("blob_path"), "payload")
    state = good.withColumn("__blob", F.lit("good")).unionByName(source.select("sha256", F.lit("made").alias("__blob")))
    at = hashed.select(F.col("path").alias("local_path"), F.col("__hash").alias("__is")).distinct().groupBy("local_path").agg(F.collect_set("__is").alias("__is"))
    own = attachments.join(state, "sha256", "left").join(at, "local_path", "left")
    whole = F.coalesce(F.array_contains("__is", F.col("sha256")), F.lit(False))
    checked = F.coalesce(F.col("downloaded"), F.lit(False)) & F.coalesce(is_digest("sha256"), F.lit(False))
    done = F.when(~checked, F.lit(None)).when(F.col("__blob").isNull(), "lost").when(F.col("__blob") == "made", "restored").when(whole, "ok").otherwise("relinked")
    mended = own.withColumn("repaired", done).withColumns({
        "local_path": F.when(checked & F.col("__blob").isNotNull() & ~whole, blob_path("sha256")).otherwise(F.col("local_path")),
        "downloaded": F.when(F.col("repaired") == "lost", F.lit(False)).otherwise(F.col("downloaded")),
        "skip_reason": F.when(F.col("repaired") == "lost", F.lit("lost")).otherwise(F.col("skip_reason") if "skip_reason" in attachments.columns else F.lit(None).cast("string")),
    })
    return contents, mended.select(*dict.fromkeys([*attachments.columns, "skip_reason", "repaired"]))
