"""Cross-site boilerplate: lines that many distinct sites have, by HyperLogLog sketches and DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.llm.common import dealt, row_key, written

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: Registers of a sketch, as a power of two; the estimate's relative deviation is 1.04 / sqrt of them.
LG_K = 12
#: A spread this many deviations (and one site) from the threshold is counted exactly.
DEVIATIONS = 4
#: White space at a line's ends that does not tell lines apart.
BLANK = " \t\r"


def _occurrences(rows: DataFrame) -> DataFrame:
    """k1, k2, doc_id, site, pos, h1, h2: one row a line that is not blank."""
    lines = rows.select("k1", "k2", "doc_id", "site", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = F.btrim("raw", F.lit(BLANK))
    return lines.where(F.length(line) > 0).select("k1", "k2", "doc_id", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(5), line).alias("h2"))


def boilerplate(occurrences: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """h1, h2, first (struct doc_id, pos of the occurrence that stays), n (occurrences) of lines on min_sites distinct sites
    or more. Sketches merge by aggregation, partly before the shuffle; only lines near the threshold get an exact distinct
    count, of sites that are told apart before the shuffle as well."""
    sketched = occurrences.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_sites)
    margin = max(1.0, DEVIATIONS * 1.04 / (1 << lg_k) ** 0.5 * min_sites)
    spread = written(sketched.select("h1", "h2", "first", "n", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites - margin), "line-spread")
    sure = spread.where(F.col("sites") > min_sites + margin).drop("sites")
    near = spread.where(F.col("sites") <= min_sites + margin).drop("sites")
    pairs = dealt(occurrences.select("h1", "h2", "k1", "k2", "site"), near.select("h1", "h2", "n"), ["h1", "h2"], ["k1", "k2"]).select("h1", "h2", "site").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites).select("h1", "h2")
    return sure.unionByName(near.join(exact, ["h1", "h2"], "left_semi"))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines at these positions; it is split once."""

    def kept(lines: Column) -> Column:
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))

    return F.when(gone.isNull(), text).otherwise(let(F.split(text, "\n"), lambda lines: F.array_join(kept(lines), "\n")))


def hits(rows: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """rows: k1, k2 (the row's key), doc_id, text, site. Returns k1, k2, gone: the positions of the lines that go."""
    occurrences = written(_occurrences(rows), "lines")  # texts are split once
    lines = written(boilerplate(occurrences, min_sites, lg_k), "boilerplate")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("pos") == F.col("first.pos")))
    return dealt(occurrences, lines, ["h1", "h2"], ["k1", "k2"]).where(other).groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lg_k: int = LG_K) -> DataFrame:
    """doc_id, text (without the lines that go), n_lines, n_removed. One row a row of docs. A line that min_sites distinct
    sites have stays once, where the least (doc_id, position) has it, and goes everywhere else. Lines part at line feeds;
    spaces, tabs and carriage returns at the ends do not tell lines apart; blank lines stay. Null text stays null, with no
    lines; an empty text is one blank line. A null site is no site; a null doc_id comes before all others. Rows that repeat
    doc_id and text are one place, so both keep a first occurrence. Empty docs: no rows. Other columns are not read."""
    k1, k2 = row_key("doc_id", "text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site")).select(k1.alias("k1"), k2.alias("k2"), "doc_id", "text", "site")
    joined = rows.drop("site").join(hits(rows, min_sites, lg_k), ["k1", "k2"], "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return joined.select("doc_id", without(F.col("text"), F.col("gone")).alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
