"""Isotonic regression by pooling that can be merged: in ranges of scores first, then between them.

The best non-decreasing fit is unique, and pooling neighbours that violate the order leads to it in
whatever order they are pooled.  So rows are summed per score, each range of scores pools its own in a task,
and the blocks that are left, few as they are, are pooled again for wider and wider ranges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Neighbouring ranges that become one in a round.
FAN = 16
_BLOCK = "lo double, hi double, weight double, total double"


def _pool(n_keys: int):
    """Pool blocks that arrive in order of their scores; blocks of each key on their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, done, names = None, [], [], None

        def out() -> pa.RecordBatch:
            cols = [pa.array([k[i] for k, _ in done], names.field(i).type) for i in range(n_keys)]
            cols += [pa.array([b[i] for _, b in done], pa.float64() if i < 4 else names.field(n_keys + i).type) for i in range(len(names) - n_keys)]
            return pa.RecordBatch.from_arrays(cols, schema=names)
        for batch in batches:
            names = batch.schema
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            for row in rows:
                key, (lo, hi, weight, total, at) = row[:n_keys], row[n_keys:]
                if (key, at) != now:
                    done += [(now[0], b) for b in stack]
                    now, stack = (key, at), []
                while stack and stack[-1][3] * weight >= total * stack[-1][2]:
                    before = stack.pop()
                    lo, weight, total = before[0], before[2] + weight, before[3] + total
                stack.append((lo, hi, weight, total, at))
        if names is not None:
            done += [(now[0], b) for b in stack]
            yield out()
    return run


def isotonic_blocks(df: DataFrame, score: str, label: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Blocks of the non-decreasing least-squares fit, per group: ``lo``, ``hi`` (scores), ``weight``, ``value``.

    Rows without score or label, or with a weight that isn't above 0, are left out; equal scores are one point.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    points = df.where(x.isNotNull() & ~F.isnan(x) & y.isNotNull() & (w > 0)).groupBy(*by, x.alias("lo")).agg(F.sum(w).alias("weight"), F.sum(w * y).alias("total"))
    ranges = points.repartitionByRange(*by, "lo").withColumn("at", F.spark_partition_id())
    cols = [*by, "lo", "hi", "weight", "total", "at"]
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), _BLOCK, "at int"])
    blocks = ranges.withColumn("hi", F.col("lo")).select(*cols).sortWithinPartitions(*by, "lo").mapInArrow(_pool(len(by)), schema)
    left = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while left > 1:  # a range's blocks go, in order, to one task with those of its neighbours
        left = -(-left // FAN)
        blocks = blocks.withColumn("at", F.floor(F.col("at") / FAN).cast("int")).repartition(left, *by, "at").sortWithinPartitions(*by, "at", "lo").mapInArrow(_pool(len(by)), schema)
    return blocks.select(*by, "lo", "hi", "weight", (F.col("total") / F.col("weight")).alias("value"))


@dataclass
class Isotonic:
    """The fit as a function: constant on blocks, linear between them, constant outside."""

    at: list[float]
    values: list[float]

    def apply(self, score: Column) -> Column:
        at, values = np.array(self.at), np.array(self.values)

        def run(x: pd.Series) -> pd.Series:
            return pd.Series(np.interp(x.to_numpy(dtype="float64", na_value=np.nan), at, values)) if len(at) else x
        return F.pandas_udf(run, "double")(score.cast("double"))

    def dumps(self) -> str:
        return json.dumps({"at": self.at, "values": self.values})

    @classmethod
    def loads(cls, text: str) -> Isotonic:
        return cls(**json.loads(text))


def fit_isotonic(df: DataFrame, score: str, label: str, weight: str | None = None) -> Isotonic:
    """The model; its blocks are all that reaches the driver."""
    at, values = [], []
    for b in sorted(isotonic_blocks(df, score, label, weight).collect(), key=lambda r: r["lo"]):
        for end in dict.fromkeys((b["lo"], b["hi"])):
            at.append(end)
            values.append(b["value"])
    return Isotonic(at, values)
