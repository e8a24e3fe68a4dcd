"""The grain everything time-dependent is computed at: one row per (key, calendar day).

A feature of date ``d`` depends on rows dated before ``d`` only, so all rows of one key
and day share it.  Every operator therefore

1. reduces its history to (key, day) with a map-side-combined aggregate, or with a
   ``row_number <= n`` filter that Spark prunes before the shuffle,
2. runs its window over the days of a key, and
3. joins the (key, day) result back to the rows that asked for it.

Step 2 sees at most one row per key and calendar day (``n`` for the prior-n forms), however
many raw rows the key has: a key holding a third of a table still is some thousand rows
there.  Steps 1 and 3 spread a hot key over its days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = "_day"


def named(expr: Column | str) -> Column:
    return F.col(expr) if isinstance(expr, str) else expr


def days_of(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """The distinct (key, day) pairs of ``df`` as ``keys`` + ``_day``."""
    return df.select(*keys, F.col(time).cast("date").alias(DAY)).distinct()


def attach(df: DataFrame, by_day: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Left join a (key, day) table back onto rows."""
    if isinstance(df.schema[time].dataType, T.DateType):
        return df.join(by_day.withColumnRenamed(DAY, time), [*keys, time], "left")
    left = df.withColumn(DAY, F.col(time).cast("date"))
    return left.join(by_day, [*keys, DAY], "left").drop(DAY).select(*df.columns, *[
        c for c in by_day.columns if c not in (*keys, DAY)])


def last_rows_per_day(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each (key, day); only they can be among a later day's last n.

    Spark turns the rank filter into a group limit on both sides of the shuffle.
    """
    w = Window.partitionBy(*keys, DAY).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)


def day_end_state(hist: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], n: int,
                  cols: Sequence[str], exprs) -> DataFrame:
    """State of each key after each of its days, over its last ``n`` rows up to then.

    ``exprs(w)`` gives the named columns for a window frame ``w``.
    """
    slim = hist.select(*keys, F.col(time).cast("date").alias(DAY),
                       *[c for c in dict.fromkeys([*order, *cols]) if c not in keys])
    slim = slim.where(F.col(DAY).isNotNull())
    recent = last_rows_per_day(slim, keys, order, n)
    w = Window.partitionBy(*keys).orderBy(DAY, *order).rowsBetween(-(n - 1), 0)
    named_cols = exprs(w)
    state = recent.select(*keys, DAY, "_rn", *[c.alias(k) for k, c in named_cols.items()])
    return state.where(F.col("_rn") == 1).drop("_rn")


def before(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shift day-end states to the key's next day: what was known before that day."""
    w = Window.partitionBy(*keys).orderBy(DAY)
    vals = [c for c in state.columns if c not in (*keys, DAY)]
    return state.select(*keys, DAY, *[F.lag(c).over(w).alias(c) for c in vals])


def prior_sums(spine_days: DataFrame, hist: DataFrame, keys: Sequence[str], time: str,
               sums: Mapping[str, Column], frames: Mapping[str, int | None]) -> DataFrame:
    """Sums over the history strictly before each spine day.

    ``sums`` names the aggregate inputs, ``frames`` the look-backs in days (None for all):
    the output column for sum ``s`` and frame ``f`` is ``s + f``.  History is first summed
    per (key, day); spine days join that day table as zero rows, so all frames share one
    exchange and one sort.
    """
    daily = hist.where(F.col(time).isNotNull()).groupBy(*keys, F.col(time).cast("date").alias(DAY)).agg(
        *[F.sum(e).alias(k) for k, e in sums.items()])
    asked = spine_days.select(*keys, DAY, F.lit(True).alias("_ask"))
    both = daily.withColumn("_ask", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    both = both.withColumn("_daynum", F.datediff(F.col(DAY), F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(*keys).orderBy("_daynum")
    outs = []
    for f, back in frames.items():
        span = w.rangeBetween(Window.unboundedPreceding if back is None else -back, -1)
        outs += [F.sum(s).over(span).alias(s + f) for s in sums]
    return both.select(*keys, DAY, "_ask", *outs).where("_ask").drop("_ask")
