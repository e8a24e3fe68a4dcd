"""Line dedup: lines that spread over many sites are boilerplate.

A line's key is the digest of its trimmed text; its spread is the number of distinct sites that
carry it.  One aggregation merges a HyperLogLog sketch of sites per key, so a line on a third
of all pages is still one small row per map task.  Only keys whose estimate lies near the
threshold get an exact distinct count.  A line that reaches the threshold stays in the document
with the smallest id that has it, and goes from all others.

Documents receive the *keys* to drop, salted so that one very common line is spread over many tasks.

Edge rows: null and empty texts have no lines and stay; blank lines are never dropped; a null
site counts as no site; rows of the same id count as one document; rows without id are documents of their own
and never keep a boilerplate line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybefore.llm.common import stored

MIN_SITES = 10
#: 2^LG_K registers: a standard error of about 1.04 / 2^(LG_K / 2).
LG_K = 12
SALTS = 32


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line, F.lit(" \t\r"))))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``key`` and ``keeper`` of the lines (doc_id, site, key) on at least ``min_sites`` sites."""
    margin = 1 + 4 * 1.04 / 2 ** (LG_K / 2) * min_sites
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("doc_id").alias("keeper"))
    spread = spread.select("key", "keeper", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - margin)
    spread = stored(spread)
    near = spread.filter(F.col("sites") <= min_sites + margin)
    exact = (lines.join(near.select("key"), "key", "left_semi").groupBy("key").agg(F.countDistinct("site").alias("sites"))
             .filter(F.col("sites") >= min_sites).select("key"))
    return spread.filter(F.col("sites") > min_sites + margin).select("key", "keeper").unionByName(near.join(exact, "key").select("key", "keeper"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                carry: list[str] | None = None) -> DataFrame:
    """Every row's ``doc_id``, cleaned ``text``, ``n_lines`` (not blank), ``n_removed`` and the columns named in ``carry``."""
    carry = carry or []
    mine = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.col(site_col).cast("string").alias("site"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    mine = mine.withColumn("nameless", F.when(F.col("doc_id").isNull(), F.unhex(F.md5("text"))))  # tells rows without id apart
    lines = (mine.select("doc_id", "nameless", "site", F.explode(_lines(F.col("text"))).alias("line"))
             .filter(F.trim("line", F.lit(" \t\r")) != "").select("doc_id", "nameless", "site", line_key(F.col("line")).alias("key")))
    lines = stored(lines)
    wide = spread_lines(lines, min_sites)
    salted = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dropped = (lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "nameless", "site"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
               .filter(F.col("doc_id").isNull() | ~F.col("doc_id").eqNullSafe(F.col("keeper")))
               .groupBy("doc_id", "nameless").agg(F.collect_set("key").alias("drop")))  # at most the lines of a document
    gone = dropped.withColumnsRenamed({"doc_id": "drop_id", "nameless": "drop_row"})
    out = mine.join(gone, F.col("doc_id").eqNullSafe(F.col("drop_id")) & F.col("nameless").eqNullSafe(F.col("drop_row")), "left")
    full = F.filter(_lines(F.col("text")), lambda x: F.trim(x, F.lit(" \t\r")) != "")
    hit = F.filter(_lines(F.col("text")), lambda x: (F.trim(x, F.lit(" \t\r")) != "") & F.array_contains(F.col("drop"), line_key(x)))
    kept = F.filter(_lines(F.col("text")), lambda x: (F.trim(x, F.lit(" \t\r")) == "") | ~F.array_contains(F.col("drop"), line_key(x)))
    none = F.col("drop").isNull()
    return out.select("doc_id", F.when(none, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.size(full).cast("long").alias("n_lines"),
                      F.when(none, F.lit(0)).otherwise(F.size(hit)).cast("long").alias("n_removed"), *[F.col(f"carry_{c}").alias(c) for c in carry])
