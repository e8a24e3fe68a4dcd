"""Shrunk team and member strengths, all strictly before the spine row's date."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybefore.functions.scalars import bayes_mean, no_nan, previous_season
from daybefore.operators.asof import Source, asof_group_mean, asof_lookup, asof_merge, latest_per_day
from daybefore.operators.daystate import DAY, attach, day_end_state, days_of, prior_sums

# Fixed values of the strength model.
TEAM_PRIOR_GAMES = 20
SPLIT_PRIOR_GAMES = 6
SCHEDULE_GAMES = 10
MEMBER_PRIOR_SHOTS = 500
MEMBER_PRIOR_STARTS = 15
LEAGUE_GOALS = 3.0
LEAGUE_RATE = 0.905
OFFENSE_SHARE_WEIGHT = 0.75
FORM_WEIGHTS = (0.65, 0.2, 0.15)
FORM_GAMES, FORM_PRIOR = 10, 12
VALUE_WEIGHT = 0.015
TIRED_BONUS = 0.75
DEFENSE_WEIGHT = 0.35
ACTIVE_DAYS, TOP_N, DEPTH_N = 10, 6, 12
AVAILABLE_BASE, IMPACT_BASE, CONCENTRATION_BASE, SHOT_POINTS = 0.8, 0.6, 0.55, 0.05


def league_states(snap: DataFrame, season: str, snap_time: str) -> DataFrame:
    """Mean goals per game of the teams present on each snapshot date of a season."""
    gp = F.when(F.col("games_played") != 0, F.col("games_played").cast("double"))
    return snap.groupBy(season, F.col(snap_time).cast("date").alias(DAY)).agg(
        F.avg(F.col("goal_for") / gp).alias("league_gf_pg"), F.avg(F.col("goal_against") / gp).alias("league_ga_pg"))


def team_baselines(spine: DataFrame, snap: DataFrame, season: str = "season", time: str = "match_date",
                   snap_time: str = "as_of_date", base: DataFrame | None = None) -> DataFrame:
    """League goals for and against per game on the season's latest earlier snapshot date; 3.0 without one."""
    gp = F.when(F.col("games_played") != 0, F.col("games_played").cast("double"))
    return asof_group_mean(
        spine, snap, [season], time, snap_time,
        {"league_gf_pg": F.col("goal_for") / gp, "league_ga_pg": F.col("goal_against") / gp},
        {"league_gf_pg": LEAGUE_GOALS, "league_ga_pg": LEAGUE_GOALS}, base)


def split_record(spine: DataFrame, played: DataFrame, season: str = "season", time: str = "match_date",
                 base: DataFrame | None = None) -> DataFrame:
    """Earlier games and wins of the team this season at the spine row's venue.

    Adds ``split_games`` and ``split_wins``; both sides carry ``team_id`` and ``is_home``.
    """
    keys = ["team_id", season, "is_home"]
    got = prior_sums(days_of(base or spine, keys, time), played, keys, time,
                     {"split_wins": F.col("won"), "split_games": F.lit(1)}, {"": None})
    out = attach(spine, got, keys, time)
    return out.withColumns({"split_games": F.coalesce(F.col("split_games"), F.lit(0)).cast("long"),
                            "split_wins": F.coalesce("split_wins", F.lit(0.0))})


def opponent_states(played: DataFrame, season: str, time: str, id: str, n: int = SCHEDULE_GAMES) -> DataFrame:
    """The team's last ``n`` opponents of the season after each of its days, as ``_opps``."""
    return day_end_state(played, ["team_id", season], time, [id], n, ["opp_id"],
                         lambda w: {"_opps": F.collect_list("opp_id").over(w)})


def schedule_values(met: DataFrame, snap: DataFrame, season: str, snap_time: str, value: str) -> DataFrame:
    """(team, season, day) with ``_opps`` to the mean snapshot value of those opponents as of that day."""
    keys, opp_keys = ["team_id", season], ["opp_id", season]
    met = met.select(*keys, DAY, F.explode("_opps").alias("opp_id"))
    met = met.groupBy(*keys, DAY, "opp_id").agg(F.count(F.lit(1)).alias("_times"))
    got = asof_merge(met, opp_keys, [Source(snap.withColumnRenamed("team_id", "opp_id"), snap_time, [value])])
    v = no_nan(value)
    per = got.groupBy(*keys, DAY).agg(
        F.sum(v * F.col("_times")).alias("_sum"), F.sum(F.when(v.isNotNull(), F.col("_times"))).alias("schedule_n"))
    return per.select(*keys, DAY, (F.col("_sum") / F.col("schedule_n")).alias("schedule_value"), "schedule_n")


def schedule_form(spine: DataFrame, played: DataFrame, snap: DataFrame, season: str = "season",
                  time: str = "match_date", id: str = "match_id", snap_time: str = "as_of_date",
                  value: str = "point_pctg", n: int = SCHEDULE_GAMES, base: DataFrame | None = None) -> DataFrame:
    """Mean snapshot value, as of the spine row's own date, of the team's last ``n`` opponents this season.

    Adds ``schedule_value`` (NULL if none) and ``schedule_n``.
    """
    keys = ["team_id", season]
    met = asof_lookup(days_of(base or spine, keys, time), opponent_states(played, season, time, id, n), keys)
    out = attach(spine, schedule_values(met, snap, season, snap_time, value), keys, time)
    return out.withColumn("schedule_n", F.coalesce("schedule_n", F.lit(0)))


def team_strength_columns(df: DataFrame) -> DataFrame:
    """The five strengths from snapshot, share, league, split and schedule columns already on the row."""
    gp = F.greatest(F.coalesce(F.col("games_played").cast("double"), F.lit(0.0)), F.lit(0.0))
    per_game = F.greatest(gp, F.lit(1.0))
    df = df.withColumns({
        "_gf": F.when(gp > 0, F.coalesce(F.col("goal_for").cast("double"), F.lit(0.0)) / per_game)
                .otherwise(F.col("league_gf_pg")),
        "_ga": F.when(gp > 0, F.coalesce(F.col("goal_against").cast("double"), F.lit(0.0)) / per_game)
                .otherwise(F.col("league_ga_pg")),
        "_win": F.coalesce(no_nan("win_pctg"), F.lit(0.5)),
        "_xgf": F.coalesce(no_nan("xgf_pct"), F.lit(0.5)),
        "_hd": F.coalesce(no_nan("hdcf_pct_5v5"), no_nan("hdcf_pct"), F.lit(0.5)),
        "_recent": F.least(F.greatest(F.coalesce(no_nan("l10_points"), F.lit(10.0)) / 20.0, F.lit(0.0)), F.lit(1.0)),
    })
    split_pct = F.when(F.col("split_games") > 0, F.col("split_wins") / F.col("split_games")).otherwise(F.col("_win"))
    sched = F.coalesce("schedule_value", F.lit(0.5))
    df = df.withColumns({
        "team_off_strength": bayes_mean(F.col("_gf"), F.col("league_gf_pg"), gp, TEAM_PRIOR_GAMES)
        - F.col("league_gf_pg") + OFFENSE_SHARE_WEIGHT * (F.col("_xgf") - 0.5),
        "team_def_strength": F.col("league_ga_pg")
        - bayes_mean(F.col("_ga"), F.col("league_ga_pg"), gp, TEAM_PRIOR_GAMES)
        + OFFENSE_SHARE_WEIGHT * (F.col("_hd") - 0.5),
        "team_schedule_strength": bayes_mean(sched, 0.5, F.col("schedule_n"), SCHEDULE_GAMES) - 0.5,
        "team_split_strength": bayes_mean(split_pct, F.col("_win"), F.col("split_games"), SPLIT_PRIOR_GAMES)
        - F.col("_win"),
    })
    form, off, dfn = FORM_WEIGHTS
    df = df.withColumn("team_form_blend",
                       form * (bayes_mean(F.col("_recent"), F.col("_win"), FORM_GAMES, FORM_PRIOR) - 0.5)
                       + off * F.col("team_off_strength") + dfn * F.col("team_def_strength"))
    return df.drop("_gf", "_ga", "_win", "_xgf", "_hd", "_recent")


def team_strength(spine: DataFrame, played: DataFrame, snap: DataFrame, season: str = "season",
                  time: str = "match_date", id: str = "match_id", snap_time: str = "as_of_date",
                  base: DataFrame | None = None) -> DataFrame:
    """Five strengths per spine row (``team_id``, season, date, ``is_home``).

    The spine already carries the team's own latest snapshot and rolling share columns;
    ``base`` is the spine without them.
    """
    base = spine if base is None else base
    out = team_baselines(spine, snap, season, time, snap_time, base)
    out = split_record(out, played, season, time, base)
    out = schedule_form(out, played, snap, season, time, id, snap_time, base=base)
    return team_strength_columns(out).drop(
        "league_gf_pg", "league_ga_pg", "split_games", "split_wins", "schedule_value", "schedule_n")


def member_log(starts: DataFrame, values: DataFrame, season: str, hist_time: str) -> DataFrame:
    """Starts and values as one history, so that one window serves the sums of both."""
    sv = starts.select("player_id", season, hist_time, F.coalesce(no_nan("saves"), F.lit(0.0)).alias("saves"),
                       F.coalesce(no_nan("shots_against"), F.lit(0.0)).alias("shots"), F.lit(1).alias("starts"))
    v = no_nan("value")
    va = values.select("player_id", season, hist_time, v.alias("value"), v.isNotNull().cast("int").alias("value_n"))
    return sv.unionByName(va, allowMissingColumns=True)


LOG_SUMS = ["saves", "shots", "starts", "value", "value_n"]


def member_baselines(spine: DataFrame, starts: DataFrame, values: DataFrame, season: str = "season",
                     time: str = "match_date", hist_time: str = "date", base: DataFrame | None = None) -> DataFrame:
    """League save rate and mean value this season before the date: ``league_rate``, ``league_value``."""
    got = prior_sums(days_of(base or spine, [season], time), member_log(starts, values, season, hist_time), [season],
                     hist_time, {f"_{c}": F.col(c) for c in LOG_SUMS}, {"": None})
    out = attach(spine, got, [season], time)
    return out.withColumns(league_members()).drop(*[f"_{c}" for c in LOG_SUMS])


def league_members() -> dict[str, Column]:
    """``league_rate`` and ``league_value`` from the season's sums so far."""
    some, shots = F.col("_value_n") > 0, F.col("_shots") > 0
    return {"league_rate": F.when(shots, F.col("_saves") / F.when(shots, F.col("_shots"))).otherwise(F.lit(LEAGUE_RATE)),
            "league_value": F.when(some, F.col("_value") / F.when(some, F.col("_value_n"))).otherwise(F.lit(0.0))}


def member_history(spine: DataFrame, starts: DataFrame, values: DataFrame, season: str = "season",
                   time: str = "match_date", hist_time: str = "date", base: DataFrame | None = None) -> DataFrame:
    """Member's sums this season before the date, over the whole previous season, and recent start counts."""
    keys = ["player_id", season]
    asked = days_of((base or spine).where(F.col("player_id").isNotNull()), keys, time)
    out = attach(spine, member_sums(asked, member_log(starts, values, season, hist_time), season, hist_time), keys, time)
    return out.select(*spine.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in MEMBER_SUMS],
                      *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in MEMBER_COUNTS])


MEMBER_SUMS = ["cur_saves", "cur_shots", "cur_value", "prev_saves", "prev_shots", "prev_value"]
MEMBER_COUNTS = ["starts_14", "starts_7", "cur_value_n", "prev_value_n"]


def member_sums(asked: DataFrame, log: DataFrame, season: str = "season", hist_time: str = "date") -> DataFrame:
    """The sums and counts of :func:`member_history` for (player, season, day) pairs, NULL where there is nothing."""
    keys = ["player_id", season]
    cur = prior_sums(asked, log, keys, hist_time, {f"cur_{c}": F.col(c) for c in LOG_SUMS},
                     {"": None, "_14": 14, "_7": 7})
    prev = log.groupBy("player_id", F.col(season).cast("long").alias("_prev_season")).agg(
        *[F.sum(c).alias(f"prev_{c}") for c in LOG_SUMS])
    out = cur.withColumn("_prev_season", previous_season(season)).join(prev, ["player_id", "_prev_season"], "left")
    named = {"cur_starts_14": "starts_14", "cur_starts_7": "starts_7"}
    return out.select(*keys, DAY, *MEMBER_SUMS, *[F.col(c).alias(named.get(c, c)) for c in ("cur_starts_14", "cur_starts_7", "cur_value_n", "prev_value_n")])


def member_strength_columns(df: DataFrame, rest: str = "rest_days", defense: str = "team_def_strength") -> DataFrame:
    """Talent, workload, fatigue and team-adjusted strength; all 0 without a member."""
    half = F.lit(0.5)
    rate = (F.col("cur_saves") + half * F.col("prev_saves") + MEMBER_PRIOR_SHOTS * F.col("league_rate")) / F.greatest(
        F.col("cur_shots") + half * F.col("prev_shots") + MEMBER_PRIOR_SHOTS, F.lit(1.0))
    league = F.col("league_value")
    cur = F.when(F.col("cur_value_n") > 0, F.col("cur_value") / F.col("cur_value_n")).otherwise(league)
    prev = F.when(F.col("prev_value_n") > 0, F.col("prev_value") / F.col("prev_value_n")).otherwise(league)
    value = bayes_mean(bayes_mean(cur, prev, F.col("cur_value_n"), F.col("prev_value_n") * half), league,
                       F.col("cur_value_n") + half * F.col("prev_value_n"), MEMBER_PRIOR_STARTS)
    tired = F.coalesce(no_nan(rest), F.lit(2.0)) <= 1
    known = F.col("player_id").isNotNull()
    df = df.withColumn("_talent", rate - F.col("league_rate") + VALUE_WEIGHT * value)
    fatigue = F.greatest(F.col("starts_7") - 1, F.lit(0)) * half + F.when(tired, F.lit(TIRED_BONUS)).otherwise(0.0)

    def or_zero(c):
        return F.when(known, c).otherwise(F.lit(0.0))

    return df.withColumns({
        "goalie_talent_strength": or_zero(F.col("_talent")),
        "goalie_workload": or_zero(F.col("starts_14") - 2.0),
        "goalie_fatigue": or_zero(fatigue),
        "goalie_team_adj_strength": or_zero(F.col("_talent") - DEFENSE_WEIGHT * F.col(defense)),
    }).drop("_talent")


def member_strength(spine: DataFrame, starts: DataFrame, values: DataFrame, season: str = "season",
                    time: str = "match_date", hist_time: str = "date", rest: str = "rest_days",
                    defense: str = "team_def_strength", base: DataFrame | None = None) -> DataFrame:
    """Four member strengths per spine row (``player_id``, season, date, rest days, team defence)."""
    base = spine if base is None else base
    out = member_baselines(spine, starts, values, season, time, hist_time, base)
    out = member_history(out, starts, values, season, time, hist_time, base)
    out = member_strength_columns(out, rest, defense)
    return out.select(*spine.columns, "goalie_talent_strength", "goalie_workload", "goalie_fatigue",
                      "goalie_team_adj_strength")


def lineup_context(spine: DataFrame, log: DataFrame, season: str = "season", time: str = "match_date",
                   log_time: str = "date", id: str = "match_id", top: int = TOP_N, depth: int = DEPTH_N,
                   active_days: int = ACTIVE_DAYS, base: DataFrame | None = None) -> DataFrame:
    """Availability, impact and concentration of the team's most used players before each spine date.

    All 0 where the team has no player with history.
    """
    keys = ["team_id", season]
    out = attach(spine, lineup_values(days_of(base or spine, keys, time), log, season, log_time, id, top, depth,
                                      active_days), keys, time)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in LINEUP_VALUES})


def lineup_values(asked_days: DataFrame, log: DataFrame, season: str = "season", log_time: str = "date",
                  id: str = "match_id", top: int = TOP_N, depth: int = DEPTH_N,
                  active_days: int = ACTIVE_DAYS) -> DataFrame:
    """Asked (team, season, day) rows with their lineup columns, NULL where the team has no player yet.

    ``log`` carries ``rolling_toi_sec``, ``rolling_points`` and ``rolling_sog``.  A sweep over the days of each
    (team, season): a player's row of a day changes the standing order of the team's players, and an asked row,
    which carries all its columns along, reads the first ``depth`` of it.  What is shuffled is the last
    row of each player and day and the asked rows; no player is matched to the days asked for.
    A row without ice time takes its player out.
    """
    keys = ["team_id", season]
    vals = ["rolling_toi_sec", "rolling_points", "rolling_sog"]
    events = latest_per_day(log.dropna(subset=keys), [*keys, "player_id"], log_time, vals, [id]).select(
        *keys, F.col(DAY).alias("_t"), F.col("player_id").cast("long").alias("_who"), *[F.col(c).cast("double").alias(f"_{c}") for c in vals])
    asks = asked_days.select(*keys, F.col(DAY).alias("_t"), F.struct(*asked_days.columns).alias("_asked"))
    both = events.withColumn("_asks", F.lit(0)).unionByName(asks.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    both = both.repartition(*keys).sortWithinPartitions(*keys, "_t", F.col("_asks").desc())
    out = [*asked_days.columns, *LINEUP_VALUES]
    kept = both.schema["_asked"].dataType.simpleString()
    swept = both.mapInArrow(_sweep(len(keys), top, depth, active_days), f"_asked {kept}, " + ", ".join(f"{c} double" for c in LINEUP_VALUES))
    return swept.select("_asked.*", *LINEUP_VALUES).select(*out)


LINEUP_VALUES = ["lineup_availability", "top_skater_impact", "deployment_concentration"]


def _sweep(n_keys: int, top: int, depth: int, active_days: int):
    """Carries one team's players in order of ice time through its days, which arrive in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        team, order, held = None, [], {}
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(n_keys)]))
            cols = [batch.column(c).to_pylist() for c in ("_t", "_asks", "_who", "_rolling_toi_sec", "_rolling_points", "_rolling_sog")]
            rows = []
            for key, d, asks, who, toi, points, sog in zip(keys, *cols):
                if key != team:
                    team, order, held = key, [], {}
                if asks:
                    rows.append(_lineup(order[:depth], d, top, active_days))
                    continue
                if who in held:
                    del order[bisect_left(order, held.pop(who))]
                if toi is not None:
                    entry = held[who] = (-toi, (who is not None, who or 0), d, points or 0.0, sog or 0.0)
                    insort(order, entry)
            asked = batch.column("_asked").filter(pc.equal(batch.column("_asks"), 1))
            yield pa.RecordBatch.from_arrays([asked, *[pa.array([r[i] for r in rows], pa.float64()) for i in range(3)]], ["_asked", *LINEUP_VALUES])
    return run


def _lineup(best: list, day, top: int, active_days: int) -> tuple:
    if not best:
        return None, None, None
    first = best[:top]
    active = [(max(-t, 1.0), points + SHOT_POINTS * sog) for t, _, seen, points, sog in first if (day - seen).days <= active_days]
    weight = sum(w for w, _ in active)
    return (len(active) / max(len(first), 1) - AVAILABLE_BASE, sum(w * s for w, s in active) / weight - IMPACT_BASE if active else 0.0,
            -sum(b[0] for b in first) / max(-sum(b[0] for b in best), 1.0) - CONCENTRATION_BASE)
