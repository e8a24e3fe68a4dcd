"""Query registry: a Spark callable, the columns it returns, and its SQL twin.

Both sides are brought to the same column types here, once.  Doubles keep single precision
and six decimals: the engines add floats in different orders, and the step through single
precision moves values such as 0.0084375 off the rounding tie that would magnify it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bridge.views import Views, ctes

_SPARK = {"l": "bigint", "d": "double", "t": "date", "s": "string", "b": "boolean"}
_DUCK = {"l": "BIGINT", "d": "DOUBLE", "t": "DATE", "s": "VARCHAR", "b": "BOOLEAN"}


#: Doubles up to which a query's are rounded by arithmetic; for wide rows that code would be too long to be compiled.
PLAIN = 8


def round_six(x: Column) -> Column:
    """``round(x, 6)`` for doubles of single precision, without a decimal per value.

    Times a million such a number is exact, so halves are seen as halves; huge values, NaN and infinity take the plain way.
    """
    n = F.floor(F.abs(x) * F.lit(1e6) + F.lit(0.5))
    return F.when(F.abs(x) < F.lit(1e9), F.when(x < 0, -n).otherwise(n) / F.lit(1e6)).otherwise(F.round(x, 6))


@dataclass
class Query:
    name: str
    covers: str
    columns: dict[str, str]
    make: Callable[[Views], DataFrame]
    sql: str | None

    def __call__(self, spark, sf_dir: str) -> DataFrame:
        df = self.make(Views(spark, sf_dir))
        six = round_six if list(self.columns.values()).count("d") <= PLAIN else lambda x: F.round(x, 6)
        out = []
        for c, t in self.columns.items():
            v = F.col(c).cast(_SPARK[t])
            out.append((six(v.cast("float").cast("double")) if t == "d" else v).alias(c))
        return df.select(*out)


QUERIES: dict[str, Query] = {}


def parse(columns: str) -> dict[str, str]:
    """``"a b:d c:t"`` to names and type codes; no code means a long."""
    out = {}
    for part in columns.split():
        name, _, kind = part.partition(":")
        out[name] = kind or "l"
    return out


def query(name: str, covers: str, columns: str, uses: str = "", oracle: str | None = None):
    cols = parse(columns)

    def wrap(fn):
        sql = None
        if oracle is not None:
            outs = ", ".join(
                f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 6) + 0.0 AS {c}" if t == "d" else f"CAST({c} AS {_DUCK[t]}) AS {c}"
                for c, t in cols.items())
            sql = f"{ctes(uses.split())}SELECT {outs} FROM (\n{oracle}\n) result"
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(name, covers, cols, fn, sql)
        return fn
    return wrap
