"""Sequential rating: consecutive pieces of bounded size folded side by side, until their starts agree.

A match moves both ratings by what they were before it, so within a group (a season) matches are folded one
after the other.  A group is cut, in its order, into pieces of some ``WINDOW`` matches, all of which are
folded at once: first from the starting rating, then from the ratings at which the pieces before
ended in the pass before.  Every pass makes at least each group's next piece exact, so as many passes as a group has
pieces are always enough; since a rating forgets where it began (by ``k`` * ln 10 / 1600, about 0.7 %, a match),
two or three settle pieces with thousands of matches a team, and a group of one piece needs none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybefore.operators.daystate import DAY
from daybefore.session import settled, written

# Fixed values.
START, K, HOME_BONUS = 1500.0, 5.0, 50.0

#: Matches in a piece, about: pieces are ranges of Spark's range partitioning.
WINDOW = 1 << 17
#: Passes in one job; between jobs the starts of the pieces are written and their largest move is read.
PASSES = 2
#: Starts that move less than this from pass to pass are settled; the step between doubles at 1500 is 2e-13.
SETTLED = 1e-11

# Of a team in a piece: rating and rating at the start of the day it began with, rating it ended with, its last day, rating at the start of that, its other rating.
_ENDS = "_team long, _began double, _began_at double, _rating double, _on long, _at double, _other double"
_STATE = ("_rating", "_on", "_at", "_other")
# Of a match: both ratings before it, at the start of the day, and after it.
_STEPS = "_d long, _id long, _h long, _a long, _home double, _away double, _home_day double, _away_day double, _home_after double, _away_after double"


def expected_home(home: str, away: str, bonus: float = HOME_BONUS):
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (F.col(away) - F.col(home) - bonus) / 400.0))


def _fold(groups: Sequence[str], k: float, bonus: float, start: float, ends: bool):
    """Fold one piece from the states of its teams; returns the states it ends with, or a row per match."""
    names = [c.split()[0] for c in (_ENDS if ends else _STEPS).split(", ")]

    def run(key: tuple, part: pa.Table, states: pa.Table) -> pa.Table:
        part = part.take(pc.sort_indices(part, [("_d", "ascending"), ("_id", "ascending")], null_placement="at_start"))
        # teams by number, nulls being one team, so that states are lists
        teams = pc.unique(pa.chunked_array([c for side in ("_h", "_a") for c in part.column(side).chunks], pa.int64()))
        h_, a_ = (pc.index_in(part.column(side), teams).to_numpy().tolist() for side in ("_h", "_a"))
        d_, y_ = part.column("_d").to_numpy().tolist(), part.column("_y").to_numpy().tolist()
        states = states.take(pc.index_in(teams, states.column("_team"))) if len(states) else None
        rating, on, at, other = ([start if v is None and c != "_on" else v for v in states.column(c).to_pylist()] if states is not None
                                 else [None if c == "_on" else start] * len(teams) for c in _STATE)
        began, began_at = list(rating), list(at)
        home, away, home_day, away_day, moved = [], [], [], [], []
        # the two sequences of a team part only where it meets itself
        apart = rating != other or bool(pc.any(pc.equal(pa.array(h_), pa.array(a_))).as_py())
        for d, h, a, y in zip(d_, h_, a_, y_):
            rh = rating[h]
            if on[h] != d:
                on[h], at[h] = d, rh
            if h != a:
                ra = rating[a]
                if on[a] != d:
                    on[a], at[a] = d, ra
                up = k * (y - 1.0 / (1.0 + 10.0 ** ((ra - rh - bonus) / 400.0)))
                rating[h], rating[a] = rh + up, ra - up
                if apart:
                    other[h] += up
                    other[a] -= up
            else:
                # matches without teams, say: both sides stand in one sequence, the away side first, each
                # against the other sequence of the same matches, which has the home side first
                ra, oh = rh, other[h]
                up = k * (y - 1.0 / (1.0 + 10.0 ** ((ra - oh - bonus) / 400.0)))
                oh += up
                rh = ra - up
                up = k * (y - 1.0 / (1.0 + 10.0 ** ((oh - rh - bonus) / 400.0)))
                rating[h], other[h] = rh + up, oh - up
            if not ends:
                home.append(rh)
                away.append(ra)
                home_day.append(at[h])
                away_day.append(at[a])
                moved.append(up)
        if ends:
            values = [teams, began, began_at, rating, on, at, other if apart else rating]
        else:
            home, away, moved = np.array(home), np.array(away), np.array(moved)
            after = np.where(np.array(h_) == np.array(a_), home, away - moved)  # the away side of a match with itself ends where the home side begins
            values = [part.column("_d"), part.column("_id"), part.column("_h"), part.column("_a"), home, away, home_day, away_day, home + moved, after]
        kinds = [pa.int64() if c in ("_team", "_on", "_d", "_id", "_h", "_a") else pa.float64() for c in names]
        values = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, t) for v, t in zip(values, kinds)]
        where = [pa.repeat(v, len(values[0])) for v in key]
        return pa.Table.from_arrays([*where, *values], names=["_w", *groups, *names])
    return run


def solved(matches: DataFrame, id: str = "match_id", time: str = "match_date", groups: Sequence[str] = ("season",),
           home: str = "home_id", away: str = "away_id", hs: str = "home_score", as_: str = "away_score", k: float = K,
           home_adv: float = HOME_BONUS, start: float = START, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """One row per match, written: both sides' ratings before it, at the start of the day, and after it.

    An id stands once in its group.  Matches are read once and cut once; a pass is a shuffle of narrow rows by
    piece, ``passes`` of them are one job, and what they hand on is one row per piece and team.
    """
    return settled(lambda: _solved(matches, id, time, list(groups), home, away, hs, as_, k, home_adv, start, passes, window))


def _solved(matches: DataFrame, id: str, time: str, g: list[str], home: str, away: str, hs: str, as_: str, k: float, home_adv: float,
            start: float, passes: int, window: int) -> DataFrame:
    slim = written(matches.where(F.col(time).isNotNull()).select(
        *g, F.unix_date(F.col(time).cast("date")).cast("long").alias("_d"), F.col(id).cast("long").alias("_id"),
        F.col(home).cast("long").alias("_h"), F.col(away).cast("long").alias("_a"),
        F.coalesce((F.col(hs) > F.col(as_)).cast("int"), F.lit(0)).alias("_y")))
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    key = ["_w", *g]
    head = ", ".join(["_w int", *(f"`{c}` {kinds[c]}" for c in g)])
    count = slim.count()
    pieces = written(slim.repartitionByRange(max(1, -(-count // window)), *g, "_d", "_id").withColumn("_w", F.spark_partition_id()))

    def fold(states: DataFrame, ends: bool) -> DataFrame:
        run = _fold(g, float(k), float(home_adv), float(start), ends)
        return pieces.groupBy(*key).cogroup(states.groupBy(*key)).applyInArrow(run, f"{head}, {_ENDS if ends else _STEPS}")

    starts = slim.sparkSession.createDataFrame([], f"{head}, _team long, _rating double, _on long, _at double, _other double, _move double")
    before = Window.partitionBy(*g, "_team").orderBy("_w")
    settled = count <= window
    while not settled:
        for _ in range(passes):
            was = {c: F.lag(c).over(before).alias(c) for c in _STATE}
            starts = fold(starts, True).select(*key, "_team", "_began", "_began_at", *was.values()).where(F.col("_rating").isNotNull()).select(
                *key, "_team", *was, F.greatest(F.abs(F.col("_rating") - F.col("_began")), F.abs(F.col("_at") - F.col("_began_at"))).alias("_move"))
        starts = written(starts)
        settled = (starts.agg(F.max("_move")).first()[0] or 0.0) <= SETTLED
    return fold(starts, False).drop("_w")


def elo_steps(matches: DataFrame, id: str = "match_id", time: str = "match_date", groups: Sequence[str] = ("season",),
              home: str = "home_id", away: str = "away_id", same_day: str = "date", **options) -> DataFrame:
    """(groups, id, ratings shown at the match, ratings after it), one row per match."""
    if same_day not in ("date", "rows"):
        raise ValueError("same_day is 'date' or 'rows'")
    day = "_day" if same_day == "date" else ""
    return solved(matches, id, time, groups, home, away, **options).groupBy(*groups, "_id").agg(
        F.max(f"_home{day}").alias("home_elo"), F.max(f"_away{day}").alias("away_elo"),
        F.max("_home_after").alias("_home_after"), F.max("_away_after").alias("_away_after"))


def _with_steps(matches: DataFrame, steps: DataFrame, groups: Sequence[str], id: str) -> DataFrame:
    """Matches with their ratings, by group and id; a null group is a group."""
    s = steps.select(*[F.col(c).alias(f"_g_{c}") for c in groups], F.col("_id"), *[c for c in steps.columns if c not in (*groups, "_id")])
    on = F.col(id).cast("long") == F.col("_id")
    for c in groups:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return matches.join(s, on, "left")


def elo(matches: DataFrame, id: str = "match_id", time: str = "match_date", groups: Sequence[str] = ("season",),
        home: str = "home_id", away: str = "away_id", **options) -> DataFrame:
    """Add ``home_elo``, ``away_elo`` and ``elo_diff``, the ratings known before each match.

    ``same_day="date"`` shows the rating at the start of the day; ``"rows"`` lets a match see
    earlier matches of its own day.  A tie counts as an away win.
    """
    got = elo_steps(matches, id, time, groups, home, away, **options).drop("_home_after", "_away_after")
    return _with_steps(matches, got, groups, id).select(
        *matches.columns, "home_elo", "away_elo", (F.col("home_elo") - F.col("away_elo")).alias("elo_diff"))


def elo_log(matches: DataFrame, id: str = "match_id", time: str = "match_date", groups: Sequence[str] = ("season",),
            home: str = "home_id", away: str = "away_id", **options) -> DataFrame:
    """Rating of each team after each of its matches: (groups, ``team_id``, ``_day``, ``_id``, ``rating``)."""
    rows = solved(matches, id, time, groups, home, away, **options)
    sides = [F.struct(F.col(t).alias("team_id"), F.col(r).alias("rating")) for t, r in (("_h", "_home_after"), ("_a", "_away_after"))]
    return rows.select(*groups, F.date_from_unix_date(F.col("_d").cast("int")).alias(DAY), "_id", F.inline(F.array(*sides))).select(
        *groups, "team_id", DAY, "_id", "rating")


def elo_states(matches: DataFrame, id: str = "match_id", time: str = "match_date",
               groups: Sequence[str] = ("season",), home: str = "home_id", away: str = "away_id",
               **options) -> DataFrame:
    """Rating of each (groups, team) after each day it played: (groups, ``team_id``, ``_day``, ``rating``)."""
    log = elo_log(matches, id, time, groups, home, away, **options)
    return log.groupBy(*groups, "team_id", DAY).agg(F.max_by("rating", "_id").alias("rating"))
