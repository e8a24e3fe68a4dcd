"""As-of joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybefore.operators.daystate import DAY, attach, days_of, last_rows_per_day


@dataclass(frozen=True)
class Source:
    """Rows of one history for :func:`asof_merge`.

    The state after a day is the last row of that day by ``order`` (then by the values), or ``exprs`` over
    windows that end there: ``exprs(value, recent, all)`` gets a function from a column name to its
    value, the window of the last ``n`` rows, and that of all rows kept (``n`` a day).
    """

    rows: DataFrame
    time: str
    values: Sequence[str]
    order: str | None = None
    n: int = 1
    exprs: Callable[[Callable[[str], Column], Window, Window], dict[str, Column]] | None = None


def asof_merge(asked: DataFrame, keys: Sequence[str], sources: Sequence[Source], day: str = DAY) -> DataFrame:
    """Add to each asked row the state of every source of its key before the row's day.

    All sources go as (key, day, number of the source, values) into one union.  One shuffle by key and day,
    behind Spark's group limit, keeps the last rows of a day; a second by key brings them
    together with the asked rows, which carry all their columns along, so nothing is joined back.  There
    the rows of a key are sorted once for the windows and once for the carry, which keeps one state per
    source.  A key's part of the second shuffle is its days, whatever number of rows it has.
    """
    sizes = [s.n for s in sources]
    rows = None
    for i, s in enumerate(sources):
        order = F.col(s.order).cast("long") if s.order else F.lit(None).cast("long")
        known = s.rows.dropna(subset=[*keys, s.time])  # a row without key or date is nobody's state
        one = known.select(*keys, F.col(s.time).cast("date").alias("_t"), F.lit(i).alias("_tag"), order.alias("_ord"),
                                                           F.struct(*s.values).alias(f"_v{i}"))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    structs = [f"_v{i}" for i in range(len(sources))]
    last = Window.partitionBy(*keys, "_tag", "_t").orderBy(F.col("_ord").desc(), *[F.col(v).desc() for v in structs])
    rows = rows.withColumn("_rn", F.row_number().over(last)).where(F.col("_rn") <= max(sizes))
    if len(set(sizes)) > 1:
        rows = rows.where(F.col("_rn") <= F.element_at(F.array(*map(F.lit, sizes)), F.col("_tag") + 1))
    asks = asked.select(*keys, F.col(day).alias("_t"), F.struct(*[F.col(c) for c in asked.columns]).alias("_asked"))
    both = rows.unionByName(asks, allowMissingColumns=True).repartition(*keys)
    whole = Window.partitionBy(*keys, "_tag").orderBy("_t", F.col("_rn").desc())
    states = {}
    for i, s in enumerate(sources):
        def value(c, v=f"_v{i}"):
            return F.col(v)[c]
        made = {c: value(c) for c in s.values} if s.exprs is None else s.exprs(
            value, whole.rowsBetween(-(s.n - 1), 0), whole.rowsBetween(Window.unboundedPreceding, 0))
        states[f"_s{i}"] = (F.struct(*[e.alias(c) for c, e in made.items()]), list(made))
    both = both.select(*keys, "_t", "_tag", "_rn", "_asked", *[e.alias(n) for n, (e, _) in states.items()])
    seen = F.col("_asked").isNull()
    carry = Window.partitionBy(*keys).orderBy("_t", seen.cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("_asked", *[F.last(F.when((F.col("_tag") == i) & (F.col("_rn") == 1), F.col(n)), ignorenulls=True).over(carry).alias(n)
                                    for i, n in enumerate(states)])
    return found.where(F.col("_asked").isNotNull()).select(
        "_asked.*", *[F.col(n)[c].alias(c) for n, (_, cols) in states.items() for c in cols])


def asof_lookups(spine_days: DataFrame, states: Sequence[DataFrame], keys: Sequence[str],
                 inclusive: bool = False) -> DataFrame:
    """Latest state of the key before (or on) each spine day, from each of several state tables.

    All sides hold one row per key and day.  They are unioned and the last state seen of each
    table is carried forward: linear, no pairs of rows are ever built, and tables with the
    same keys share one exchange and one sort.
    """
    seen, asked = (0, 1) if inclusive else (1, 0)
    vals = [[c for c in s.columns if c not in (*keys, DAY)] for s in states]
    both = spine_days.select(*keys, DAY, F.lit(asked).alias("_seq"))
    for i, s in enumerate(states):
        both = both.unionByName(s.select(*keys, DAY, F.lit(seen).alias("_seq"), F.struct(*vals[i]).alias(f"_v{i}")),
                                allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(DAY, "_seq").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select(*keys, DAY, "_seq", *[
        F.last(f"_v{i}", ignorenulls=True).over(w).alias(f"_v{i}") for i in range(len(states))])
    return found.where(F.col("_seq") == asked).select(
        *keys, DAY, *[F.col(f"_v{i}")[c].alias(c) for i, cols in enumerate(vals) for c in cols])


def asof_lookup(spine_days: DataFrame, states: DataFrame, keys: Sequence[str], inclusive: bool = False) -> DataFrame:
    return asof_lookups(spine_days, [states], keys, inclusive)


def latest_per_day(snap: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str],
                   order: Sequence[str] = ()) -> DataFrame:
    """One row per (key, day): the last by ``order``, values in ``cols``."""
    slim = snap.select(*keys, F.col(time).cast("date").alias(DAY),
                       *[c for c in dict.fromkeys([*order, *cols]) if c not in keys]).where(F.col(DAY).isNotNull())
    tie = list(order) or list(cols)
    return last_rows_per_day(slim, keys, tie, 1).select(*keys, DAY, *[c for c in cols if c not in keys])


def asof_join(left: DataFrame, snap: DataFrame, on: Sequence[str], left_time: str, right_time: str,
              cols: Sequence[str], inclusive: bool = False, order: Sequence[str] = (),
              base: DataFrame | None = None) -> DataFrame:
    """Attach to every left row the latest snapshot of its key dated before it (on it, if ``inclusive``).

    Adds ``cols`` and ``right_time``; all NULL where no snapshot qualifies.  ``order`` breaks
    ties between snapshots of one key and day (last wins).  ``base`` is a narrower frame with the
    same keys and dates to take the asked days from: a chain of joins that all ask from one
    base grows linearly, where asking from the growing frame would double the plan each time.
    """
    s = snap.withColumn(right_time, F.col(right_time).cast("date"))
    vals = list(dict.fromkeys([*cols, right_time]))
    states = latest_per_day(s, on, right_time, vals, order)
    return attach(left, asof_lookup(days_of(base or left, on, left_time), states, on, inclusive), on, left_time)


def asof_group_mean(spine: DataFrame, snap: DataFrame, on: Sequence[str], time: str, snap_time: str,
                    exprs: Mapping[str, Column], defaults: Mapping[str, float],
                    base: DataFrame | None = None) -> DataFrame:
    """Mean over all members present on the group's single latest snapshot date before each spine row.

    A member missing on that date is not carried forward.
    """
    daily = snap.groupBy(*on, F.col(snap_time).cast("date").alias(DAY)).agg(
        *[F.avg(e).alias(k) for k, e in exprs.items()])
    got = attach(spine, asof_lookup(days_of(base or spine, on, time), daily, on), on, time)
    return got.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def resolve_override(spine: DataFrame, hist: DataFrame, group: str, member: str, time: str, spine_time: str,
                     override: str, order: Sequence[str]) -> DataFrame:
    """The member to use for each spine row: the override if it has history with the group, else the latest.

    Adds ``member`` and ``override_used``.
    """
    h = hist.select(F.col(group), F.col(member).alias("_m"), F.col(time).cast("date").alias("_t"),
                    *[c for c in order if c not in (group, member, time)])
    latest = asof_join(spine, h, [group], spine_time, "_t", ["_m"], order=[c for c in order if c != time])
    first_seen = h.groupBy(F.col(group), F.col("_m").alias(override)).agg(F.min("_t").alias("_first"))
    out = latest.join(first_seen, [group, override], "left")
    used = F.coalesce(F.col("_first") < F.col(spine_time).cast("date"), F.lit(False))
    return out.select(*spine.columns, F.when(used, F.col(override)).otherwise(F.col("_m")).alias(member),
                      used.alias("override_used"))
