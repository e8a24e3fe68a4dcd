"""Located events: model features and per-match attempt shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybefore.functions import events as E
from daybefore.functions.scalars import share
from daybefore.operators.prefix import BLOCK, lag_in_blocks


def events_of(events: DataFrame, matches: DataFrame, kinds: Sequence[str], game: str = "game_id",
              kind: str = "type_key", cols: Sequence[str] = ("home_team_id",)) -> DataFrame:
    """Events of the given kinds in the given matches, with match columns attached (inner join)."""
    m = matches.select(game, *[c for c in cols if c != game])
    e = events.drop(*[c for c in cols if c in events.columns and c != game])
    return e.where(F.col(kind).isin(*kinds)).join(m, game)


def event_features(events: DataFrame, game: str = "game_id", order: str = "sort_order", kind: str = "type_key",
                   block: int = BLOCK) -> DataFrame:
    """Append geometry, manpower, shot-kind, rebound, period and goal columns.

    The rebound flag looks at the previous row of ``events`` in the same match, so filter to
    the wanted kinds first.
    """
    df = lag_in_blocks(events, game, order, kind, "_prev", block)
    x, y = F.col("x_coord"), F.col("y_coord")
    cols = {
        "shot_distance": E.distance(x, y), "shot_angle": E.angle(x, y), "is_behind_net": E.behind_net(x),
        **E.manpower(F.col("situation_code"), F.col("owner_team_id"), F.col("home_team_id")),
        "shot_type_code": E.shot_kind_code("shot_type"),
        "is_rebound": F.coalesce((F.col("_prev") == "shot-on-goal").cast("int"), F.lit(0)),
        "period": E.period_capped(F.col("period")),
        "is_goal": (F.col(kind) == "goal").cast("int"),
    }
    return df.withColumns(cols).drop("_prev")


def attributed(events: DataFrame, kind: str = "type_key", owner_blocks: bool = True) -> DataFrame:
    """Attempts with attacking side, unblocked and high-danger flags."""
    unblocked = (F.col(kind).isin("goal", "shot-on-goal", "missed-shot")).cast("int")
    hd = E.high_danger(F.col("x_coord"), F.col("y_coord")) * unblocked
    return events.withColumns({
        "attack_team_id": E.attacker(F.col(kind), F.col("owner_team_id"), F.col("home_team_id"),
                                     F.col("away_team_id"), owner_blocks),
        "is_unblocked": unblocked, "hd": hd})


def event_shares(attempts: DataFrame, scored: DataFrame | None = None, game: str = "game_id",
                 order: str = "sort_order", kind: str = "type_key", keep: Sequence[str] = ()) -> DataFrame:
    """Per (match, side): attempts, expected goals and danger for and against, and their shares.

    ``attempts`` are the attempt events with home and away ids.  ``scored`` optionally gives
    (match, order, ``xg``) for the on-target ones; without it expected goals are 0.  A side
    without attempts has no row, and its opponent's "against" is then 0.
    """
    a = attributed(attempts, kind)
    if scored is None:
        a = a.withColumn("xg", F.lit(0.0))
    else:
        a = a.drop("xg").join(scored.select(game, order, "xg"), [game, order], "left")
        a = a.withColumn("xg", F.coalesce("xg", F.lit(0.0)))
    made = a.groupBy(game, *keep, F.col("attack_team_id").alias("team_id")).agg(
        F.count(F.lit(1)).alias("cf"), F.sum("xg").alias("xgf"), F.sum("hd").alias("hdcf"),
        F.first("home_team_id").alias("_h"), F.first("away_team_id").alias("_a"))
    made = made.withColumn("opp_id", F.when(F.col("team_id") == F.col("_h"), F.col("_a")).otherwise(F.col("_h")))
    other = made.select(game, F.col("team_id").alias("opp_id"), F.col("cf").alias("ca"),
                        F.col("xgf").alias("xga"), F.col("hdcf").alias("hdca"))
    out = made.drop("_h", "_a").join(other, [game, "opp_id"], "left")
    out = out.withColumns({"ca": F.coalesce("ca", F.lit(0)), "xga": F.coalesce("xga", F.lit(0.0)),
                           "hdca": F.coalesce("hdca", F.lit(0))})
    return out.withColumns({"cf_pct": share("cf", "ca"), "xgf_pct": share("xgf", "xga"),
                            "hdcf_pct": share("hdcf", "hdca")})
