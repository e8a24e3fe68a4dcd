"""Merkle fixity audit of record archives against a replica.

Leaves are digests over (offset, length, content digest) of records.  A tree over one archive file is
built on ranges of offsets: level 0 groups the records that start in the same ``range_bytes``,
each further level ``fanout`` neighbours of the one below, up to one root.  A range holds at
most ``range_bytes`` records, whatever the size of its file, so no group grows with the data.

The audit joins roots, then follows only branches whose digests differ, level by level, down to
the records of the differing ranges; equal branches are never opened.

Findings: ``changed`` (same offset, other length or content), ``missing`` (only in the primary),
``extra`` (only in the replica).  Edge rows: null content is empty content; records without a file
or offset form no tree and are left out; exactly repeated records are one record; two different
records at one offset are both hashed and both shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybefore.llm.common import stored

RANGE_BYTES = 1 << 16
FANOUT = 16


def leaves(records: DataFrame, file: str = "file", offset: str = "offset", length: str = "length", digest: str = "digest") -> DataFrame:
    """One row per record: ``file``, ``offset``, ``length`` and its ``leaf`` digest; ``digest`` is over the content."""
    out = records.select(F.col(file).cast("string").alias("file"), F.col(offset).cast("long").alias("offset"), F.col(length).cast("long").alias("length"),
                         F.coalesce(F.col(digest), F.sha2(F.lit(""), 256)).alias("digest")).filter(F.col("file").isNotNull() & F.col("offset").isNotNull())
    text = F.concat_ws(":", F.col("offset").cast("string"), F.coalesce(F.col("length"), F.lit(0)).cast("string"), F.col("digest"))
    return out.select("file", "offset", "length", F.unhex(F.sha2(text, 256)).alias("leaf"))


def _ordered(position: str, value: str) -> Column:
    """Digest of a group's digests in order of position."""
    pairs = F.array_sort(F.collect_set(F.struct(F.col(position).alias("at"), F.col(value).alias("value"))))
    return F.unhex(F.sha2(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["at"].cast("string"), F.hex(x["value"]))), ","), 256))


def tree(leaf_rows: DataFrame, height: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """All nodes: ``file``, ``level``, ``node`` (number within its level) and ``hash``; ``height`` is the root's level."""
    level = (leaf_rows.groupBy("file", F.floor(F.col("offset") / range_bytes).cast("long").alias("node")).agg(_ordered("offset", "leaf").alias("hash"))
             .select("file", F.lit(0).alias("level"), "node", "hash"))
    level = stored(level)
    nodes = level
    for k in range(1, height + 1):
        level = (level.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("up")).agg(_ordered("node", "hash").alias("hash"))
                 .select("file", F.lit(k).alias("level"), F.col("up").alias("node"), "hash"))
        nodes = nodes.unionByName(level)
    return nodes


def height_for(largest_offset: int | None, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> int:
    """Levels above the ranges until one node covers every offset."""
    ranges, height = (largest_offset or 0) // range_bytes + 1, 0
    while ranges > 1:
        ranges, height = -(-ranges // fanout), height + 1
    return height


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Findings between two tables of records (file, offset, length, digest): ``file``, ``offset``, ``finding``, both leaf digests."""
    mine, other = stored(leaves(primary)), stored(leaves(replica))
    largest = mine.select("offset").unionByName(other.select("offset")).agg(F.max("offset")).first()[0]
    height = height_for(largest, range_bytes, fanout)
    trees = [stored(tree(x, height, range_bytes, fanout)) for x in (mine, other)]

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed("hash", "other_hash")
        return a.join(b, ["file", "node"], "full").filter(~F.col("hash").eqNullSafe(F.col("other_hash"))).select("file", "node")

    open_nodes = None
    for level in range(height, -1, -1):
        sides = [t.filter(F.col("level") == level).select("file", "node", "hash") for t in trees]
        if open_nodes is not None:
            up = open_nodes.withColumnRenamed("node", "up")
            sides = [s.withColumn("up", F.floor(F.col("node") / fanout).cast("long")).join(up, ["file", "up"], "left_semi").drop("up") for s in sides]
        open_nodes = differing(*sides)
    records = [x.withColumn("node", F.floor(F.col("offset") / range_bytes).cast("long")).join(open_nodes, ["file", "node"], "left_semi")
               .groupBy("file", "offset").agg(F.array_join(F.array_sort(F.collect_set(F.hex("leaf"))), ",").alias("leaf")) for x in (mine, other)]
    theirs = records[1].select("file", "offset", F.col("leaf").alias("other_leaf"))
    both = records[0].join(theirs, ["file", "offset"], "full")
    finding = F.when(F.col("leaf").isNull(), "extra").when(F.col("other_leaf").isNull(), "missing").otherwise("changed")
    return both.filter(~F.col("leaf").eqNullSafe(F.col("other_leaf"))).select("file", "offset", finding.alias("finding"), "leaf", "other_leaf")
