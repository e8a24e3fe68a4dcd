"""Order-dependent work on groups of any size: prefix sums and lag in bounded pieces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def prefix_sums(df: DataFrame, keys: Sequence[str], levels: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Exclusive running sums within ``keys``, in the order of ``levels``.

    ``levels`` refine each other and the last is unique within the ones before it.  Sums are
    combined per level prefix, accumulated level by level and joined down, so the largest
    window is the largest number of distinct values of one level under one prefix, never the
    whole group.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    base = df.withColumns(dict(zip(names, levels))).withColumns({f"_s_{k}": e for k, e in sums.items()})
    s_cols = [f"_s_{k}" for k in sums]
    w = Window.partitionBy(*keys, *names[:-1]).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)
    out = base.withColumns({f"_p_{k}": F.coalesce(F.sum(f"_s_{k}").over(w), F.lit(0)) for k in sums})
    offsets = None
    for depth in range(1, len(levels)):
        part = base.groupBy(*keys, *names[:depth]).agg(*[F.sum(c).alias(c) for c in s_cols])
        w = Window.partitionBy(*keys, *names[:depth - 1]).orderBy(names[depth - 1]).rowsBetween(
            Window.unboundedPreceding, -1)
        acc = part.select(*keys, *names[:depth], *[
            F.coalesce(F.sum(f"_s_{k}").over(w), F.lit(0)).alias(f"_o_{k}") for k in sums])
        if offsets is None:
            offsets = acc
        else:
            up = offsets.select(*keys, *names[:depth - 1], *[F.col(f"_o_{k}").alias(f"_u_{k}") for k in sums])
            offsets = acc.join(up, [*keys, *names[:depth - 1]]).select(
                *keys, *names[:depth], *[(F.col(f"_o_{k}") + F.col(f"_u_{k}")).alias(f"_o_{k}") for k in sums])
    if offsets is not None:
        out = out.join(offsets, [*keys, *names[:-1]])
        totals = {k: F.col(f"_p_{k}") + F.col(f"_o_{k}") for k in sums}
    else:
        totals = {k: F.col(f"_p_{k}") for k in sums}
    return out.select(*df.columns, *[c.alias(k) for k, c in totals.items()])


def lag_in_blocks(df: DataFrame, key: str, order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """``lag(value)`` over ``key`` ordered by the unique integer ``order``.

    A block spans ``block`` order numbers, so it holds at most ``block`` rows; the first row
    of a block takes the last value of the key's previous non-empty block.
    """
    blk = F.floor(F.col(order) / F.lit(block)).cast("long")
    cut = df.withColumn("_blk", blk)
    w = Window.partitionBy(key, "_blk").orderBy(order)
    inside = cut.withColumns({"_pos": F.row_number().over(w), "_lag": F.lag(value).over(w)})
    tails = cut.groupBy(key, "_blk").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_t"))
    prev = tails.select(key, "_blk", F.lag("_t").over(Window.partitionBy(key).orderBy("_blk"))["v"].alias("_tail"))
    joined = inside.join(prev, [key, "_blk"], "left")
    return joined.select(*df.columns, F.when(F.col("_pos") == 1, F.col("_tail")).otherwise(F.col("_lag")).alias(out))
