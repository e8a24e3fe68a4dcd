"""Feature rows for a spine of pairings, and the series columns on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybefore.functions.scalars import bracket_year, or_default, season_of
from daybefore.operators.asof import Source, asof_merge
from daybefore.operators.daystate import DAY
from daybefore.operators.pairs import (head_to_head, seat_seeds, seed_difference, series_as_of, series_context,
                                       series_state, with_pair)
from daybefore.operators.rating import START, elo_log
from daybefore.operators.rolling import means, ratio, rest_states, sides
from daybefore.operators.strength import (LEAGUE_GOALS, LOG_SUMS, MEMBER_COUNTS, MEMBER_SUMS, SCHEDULE_GAMES, league_members, league_states,
                                          lineup_values, member_log, member_strength_columns, member_sums, schedule_values, team_strength_columns)
from daybefore.plans.columns import (GOALIE_STRENGTHS, LINEUP, SERIES, SHARES, STANDING_MEASURES, TEAM_STATS,
                                     TEAM_STRENGTHS)
from daybefore.session import settled, written
from daybefore.sources.context import Context
from daybefore.sources.scans import PLAYOFF, REGULAR

SPINE = "spine_id"
_GAME = dict(id="id", time="date", home="home_team_id", away="away_team_id")

#: Struct of a team's values on a day: wide rows go through shuffles, sorts and groupings as one column.
TEAM = "_team"
_TEAM_VALUES = [*STANDING_MEASURES, "as_of_date", *[f"rolling_{c}" for c in TEAM_STATS], *SHARES, "rest_days", "elo", *LINEUP, *TEAM_STRENGTHS]
_MEMBER_VALUES = ["goalie_sv", "goalie_gsax", *GOALIE_STRENGTHS]


def game_spine(games: DataFrame, game_type: int | None = REGULAR) -> DataFrame:
    """Every game of a type as its own request, with its outcome (a tie counts as 0)."""
    g = games if game_type is None else games.where(F.col("game_type") == game_type)
    return g.select(F.col("id").alias(SPINE), F.col("id").alias("game_id"), "season", "date", "game_type",
                    "home_team_id", "away_team_id",
                    F.coalesce((F.col("home_score") > F.col("away_score")).cast("int"), F.lit(0)).alias("target"))


def request_spine(requests: DataFrame) -> DataFrame:
    """Requests (``spine_id``, home, away, date) with the season worked out where absent."""
    season = F.col("season").cast("long") if "season" in requests.columns else F.lit(None).cast("long")
    return requests.withColumn("season", F.coalesce(season, season_of("date")))


def _sides(spine: DataFrame) -> DataFrame:
    have = set(spine.columns)

    def side(name, is_home):
        over = f"{name}_goalie_id"
        return F.struct(F.col(f"{name}_team_id").cast("long").alias("team_id"), F.lit(is_home).alias("is_home"),
                        (F.col(over) if over in have else F.lit(None)).cast("long").alias("_override"))
    return spine.select(
        SPINE, F.col("season").cast("long").alias("season"), F.col("date").cast("date").alias("date"),
        (F.col("game_id") if "game_id" in have else F.lit(None)).cast("long").alias("game_id"),
        F.inline(F.array(side("home", True), side("away", False))))


def side_features(ctx: Context, sides_df: DataFrame, member_mode: str = "actual", use_rest: bool = True,
                  rest_types=None) -> DataFrame:
    """All per-side columns for (``spine_id``, team, season, date, ``is_home``) rows, those of the team as columns of their own."""
    rows = packed_sides(ctx, sides_df, member_mode, use_rest, rest_types)
    return rows.select(*[c for c in rows.columns if c != TEAM], f"{TEAM}.*")


def packed_sides(ctx: Context, sides_df: DataFrame, member_mode: str = "actual", use_rest: bool = True,
                 rest_types=None) -> DataFrame:
    """The sides with their member's columns and, in the struct ``TEAM``, their team's.

    ``member_mode`` "actual" uses the recorded starter of the game for the rolling columns and
    the team's latest starter where none is recorded for the strengths; "latest" uses a valid
    override, else the latest starter, for both.  What a team's days have at home and away is computed once
    per day and venue; the sides stay narrow until it is joined, as one column.
    """
    sides_df = written(sides_df)
    asked = sides_df.select("team_id", "season", F.col("date").alias(DAY)).distinct()
    team = settled(lambda: venue_days(team_days(ctx, asked, rest_types)))
    rows = written(_members(_with_team(sides_df, team, "_latest"), ctx.goalies, member_mode))
    who = rows.where(F.col("player_id").isNotNull()).select("player_id", "season", F.col("date").alias(DAY)).distinct()
    rows = rows.join(member_days(ctx, who).withColumnRenamed(DAY, "date"), ["player_id", "season", "date"], "left")
    rows = _with_team(rows, team, TEAM, "league_rate", "league_value")
    rolls = F.col("_roller").isNotNull()
    rows = rows.withColumns({"goalie_sv": F.when(rolls, F.col("goalie_sv")), "goalie_gsax": F.when(rolls, F.col("rolling_value")),
                             "_rest_used": F.col(f"{TEAM}.rest_days") if use_rest else F.lit(None).cast("int"),
                             **{c: F.coalesce(c, F.lit(0.0)) for c in MEMBER_SUMS}, **{c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in MEMBER_COUNTS}})
    return member_strength_columns(rows, "_rest_used", f"{TEAM}.team_def_strength")


def venue_days(days: DataFrame) -> DataFrame:
    """Team days twice, for games at home and away: ``_latest``, the season's member baselines and all else in ``TEAM``.

    A day without team, season or date is nobody's: it has no values but those that follow from none.
    """
    keys = ["team_id", "season", DAY]
    some = F.col("team_id").isNotNull() & F.col("season").isNotNull() & F.col(DAY).isNotNull()
    rows = days.select(*keys, *[F.when(some, F.col(c)).alias(c) for c in days.columns if c not in keys],
                       F.explode(F.array(F.lit(True), F.lit(False))).alias("is_home"))
    home = F.col("is_home")
    rows = team_strength_columns(rows.withColumns({
        "split_games": F.coalesce(F.when(home, F.col("_hg")).otherwise(F.col("_ag")), F.lit(0)).cast("long"),
        "split_wins": F.coalesce(F.when(home, F.col("_hw")).otherwise(F.col("_aw")), F.lit(0.0))}))
    return rows.select(*keys, "is_home", "_latest", "league_rate", "league_value", F.struct(*_TEAM_VALUES).alias(TEAM))


def _with_team(rows: DataFrame, team: DataFrame, *columns: str) -> DataFrame:
    """Sides with columns of :func:`venue_days`; null keys are keys."""
    keys = {"team_id": "team_id", "season": "season", "date": DAY, "is_home": "is_home"}
    right = team.select(*[F.col(k).alias(f"_of_{c}") for c, k in keys.items()], *columns)
    on = F.col("team_id").eqNullSafe(F.col("_of_team_id"))
    for c in ("season", "date", "is_home"):
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(right, on, "left").select(*rows.columns, *columns)


def team_days(ctx: Context, asked: DataFrame, rest_types=None) -> DataFrame:
    """All team columns for (team, season, day) rows: one pass through each key's days after the other, without joins.

    The asked rows go through the (team, season) merge, the lineup sweep and the team merge with all
    they have gathered so far; what a season's days share and the opponents' standings, for which those
    results are needed, are joined to the written table.
    """
    keys = ["team_id", "season"]
    played = sides(ctx.games, **_GAME, keep=["season"])
    snaps = ctx.standings.withColumn("as_of_date", F.col("as_of_date").cast("date"))
    won, at_home = F.col("won"), F.col("is_home")
    split = {"hg": F.count_if(at_home), "hw": F.sum(F.when(at_home, won)), "ag": F.count_if(~at_home), "aw": F.sum(F.when(~at_home, won))}
    daily = played.groupBy(*keys, F.col("date").cast("date").alias(DAY)).agg(*[e.alias(c) for c, e in split.items()])
    days = asof_merge(asked, keys, [
        Source(snaps, "as_of_date", [*STANDING_MEASURES, "as_of_date"]),
        Source(elo_log(ctx.games, "id", "date", ["season"], "home_team_id", "away_team_id"), DAY, ["rating"], "_id"),
        Source(played, "date", ["opp_id"], "id", SCHEDULE_GAMES, lambda v, recent, _: {"_opps": F.collect_list(v("opp_id")).over(recent)}),
        Source(daily, DAY, list(split), exprs=lambda v, _, whole: {f"_{c}": F.sum(v(c)).over(whole) for c in split})])
    days = lineup_values(days, ctx.skaters, "season", "date", "game_id")
    rest_src = ctx.games if rest_types is None else ctx.games.where(F.col("game_type").isin(*rest_types))
    days = asof_merge(days, ["team_id"], [
        Source(ctx.team_stats, "date", TEAM_STATS, "game_id", 10, means(TEAM_STATS)),
        Source(ctx.shares, "date", SHARES, "game_id", 10, means(SHARES, prefix="")),
        Source(rest_states(sides(rest_src, **_GAME), "team_id", "date"), DAY, ["_last"]),
        Source(ctx.goalies.withColumnRenamed("player_id", "_latest"), "date", ["_latest"], "game_id")])
    days = written(days)
    log = member_log(ctx.goalies, ctx.goalie_values, "season", "date")
    by_day = log.groupBy("season", F.col("date").cast("date").alias(DAY)).agg(*[F.sum(c).alias(c) for c in LOG_SUMS])
    season = asof_merge(days.select("season", DAY).distinct(), ["season"], [
        Source(league_states(ctx.standings, "season", "as_of_date"), DAY, ["league_gf_pg", "league_ga_pg"]),
        Source(by_day, DAY, LOG_SUMS, exprs=lambda v, _, whole: {f"_{c}": F.sum(v(c)).over(whole) for c in LOG_SUMS})])
    schedule = schedule_values(days, ctx.standings, "season", "as_of_date", "point_pctg")
    days = days.join(schedule, [*keys, DAY], "left").join(season, ["season", DAY], "left")
    new = {"rest_days": F.datediff(DAY, "_last"), "elo": F.coalesce("rating", F.lit(START)),
           "schedule_n": F.coalesce("schedule_n", F.lit(0)),
           "league_gf_pg": F.coalesce("league_gf_pg", F.lit(LEAGUE_GOALS)), "league_ga_pg": F.coalesce("league_ga_pg", F.lit(LEAGUE_GOALS)),
           **league_members(), **{c: F.coalesce(c, F.lit(0.0)) for c in LINEUP}}
    used = {*new, "_last", "rating", "_opps", *[f"_{c}" for c in LOG_SUMS]}
    return days.select(*[c for c in days.columns if c not in used], *[e.alias(c) for c, e in new.items()])


def member_days(ctx: Context, asked: DataFrame) -> DataFrame:
    """Sums of this season and the last, and rolling columns, for (player, season, day) rows."""
    sums = member_sums(asked, member_log(ctx.goalies, ctx.goalie_values, "season", "date"))
    return asof_merge(sums, ["player_id"], [
        Source(ctx.goalies, "date", ["saves", "shots_against"], "game_id", 10, ratio("saves", "shots_against", out="goalie_sv")),
        Source(ctx.goalie_values, "date", ["value"], "game_id", 10, means(["value"]))])


def _members(rows: DataFrame, starts: DataFrame, mode: str) -> DataFrame:
    """Sides, with their team's ``_latest`` starter, given ``player_id`` (for the strengths) and ``_roller`` (for the rolling columns)."""
    columns = [c for c in rows.columns if c != "_latest"]
    if mode == "latest":
        first = starts.groupBy("team_id", F.col("player_id").alias("_override")).agg(F.min("date").alias("_first"))
        who = F.when(F.col("_first") < F.col("date"), F.col("_override")).otherwise(F.col("_latest"))
        return rows.join(first, ["team_id", "_override"], "left").select(*columns, who.alias("player_id"), who.alias("_roller"))
    if mode != "actual":
        raise ValueError("member_mode is 'actual' or 'latest'")
    actual = starts.groupBy("game_id", "team_id", "is_home").agg(F.min("player_id").alias("_roller"))
    return rows.join(actual, ["game_id", "team_id", "is_home"], "left").select(
        *columns, F.coalesce("_roller", "_latest").alias("player_id"), "_roller")


def paired(spine: DataFrame, side_rows: DataFrame) -> DataFrame:
    """Both sides' values as ``home`` and ``away`` structs, in one grouping on the spine id.

    The two-row group replaces two joins, each of which would compute the sides again.
    """
    v = F.struct(TEAM, *_MEMBER_VALUES)
    both = side_rows.groupBy(SPINE).agg(
        F.first(F.when(F.col("is_home"), v), ignorenulls=True).alias("home"),
        F.first(F.when(~F.col("is_home"), v), ignorenulls=True).alias("away"))
    return spine.join(both, SPINE, "left")


def side_value(side: str, name: str) -> Column:
    """A column of a side of :func:`paired`."""
    return F.col(f"{side}.{name}" if name in _MEMBER_VALUES else f"{side}.{TEAM}.{name}")


def usable(pairs: DataFrame) -> DataFrame:
    """Drop pairings without a snapshot on either side, or with no games played on both."""
    return pairs.where(side_value("home", "as_of_date").isNotNull() & side_value("away", "as_of_date").isNotNull() & ~(
        side_value("home", "games_played").eqNullSafe(0) & side_value("away", "games_played").eqNullSafe(0)))


def assemble(pairs: DataFrame, keep=("season", "date", "home_team_id", "away_team_id")) -> DataFrame:
    """The hundred computed columns in one projection."""
    H, A = (lambda c: side_value("home", c)), (lambda c: side_value("away", c))

    def z(x: Column) -> Column:
        return or_default(x, 0.0)

    out: dict[str, Column] = {}
    per_game, splits, pk = {}, {}, {}
    for name, S, O in (("home", H, A), ("away", A, H)):
        gp = F.greatest(F.coalesce(S("games_played"), F.lit(0.0)), F.lit(1.0))
        per_game[name] = (z(S("goal_for")) / gp, z(S("goal_against")) / gp)
        pk[name] = 1.0 - O("rolling_pp_pctg")
        out |= {
            f"{name}_games_played": z(S("games_played")), f"{name}_point_pctg": or_default(S("point_pctg"), 0.5),
            f"{name}_win_pctg": or_default(S("win_pctg"), 0.5),
            f"{name}_reg_win_pctg": or_default(S("regulation_win_pctg"), 0.5),
            f"{name}_goal_diff": z(S("goal_differential")), f"{name}_l10_points": z(S("l10_points")),
            f"{name}_points": z(S("points")), f"{name}_goals_for_per_game": per_game[name][0],
            f"{name}_goals_against_per_game": per_game[name][1],
        }
    for name, S, venue in (("home", H, "home"), ("away", A, "road")):
        w, l = z(S(f"{venue}_wins")), z(S(f"{venue}_losses"))
        splits[name] = w / F.greatest(w + l, F.lit(1.0))
    for name, S in (("home", H), ("away", A)):
        out |= {f"{name}_goalie_sv_pctg": S("goalie_sv"), f"{name}_goalie_gsax": S("goalie_gsax")}
    out |= {"home_rest_days": H("rest_days"), "away_rest_days": A("rest_days")}
    for name, S in (("home", H), ("away", A)):
        out[f"{name}_is_b2b"] = F.coalesce((S("rest_days") == 1).cast("int"), F.lit(0))
    out["rest_advantage"] = or_default(H("rest_days"), 2) - or_default(A("rest_days"), 2)
    rolling = {"pp_pctg": "rolling_pp_pctg", "faceoff_pctg": "rolling_faceoff_winning_pctg", "sog": "rolling_sog",
               "hits": "rolling_hits", "blocked_shots": "rolling_blocked_shots"}
    for name, S in (("home", H), ("away", A)):
        for short, col in rolling.items():
            out[f"{name}_{short}"] = S(col)
            if short == "pp_pctg":
                out[f"{name}_pk_pctg"] = pk[name]
    out |= {
        "diff_point_pctg": or_default(H("point_pctg"), 0.5) - or_default(A("point_pctg"), 0.5),
        "diff_goal_diff": z(H("goal_differential")) - z(A("goal_differential")),
        "diff_l10_points": z(H("l10_points")) - z(A("l10_points")), "diff_points": z(H("points")) - z(A("points")),
        "diff_goalie_sv_pctg": z(H("goalie_sv")) - z(A("goalie_sv")),
        "diff_goalie_gsax": z(H("goalie_gsax")) - z(A("goalie_gsax")),
        "diff_pp_pctg": z(H(rolling["pp_pctg"])) - z(A(rolling["pp_pctg"])),
        "diff_pk_pctg": z(pk["home"]) - z(pk["away"]),
        "diff_faceoff_pctg": z(H(rolling["faceoff_pctg"])) - z(A(rolling["faceoff_pctg"])),
        "diff_sog": z(H("rolling_sog")) - z(A("rolling_sog")),
        "diff_goals_for_per_game": per_game["home"][0] - per_game["away"][0],
        "diff_goals_against_per_game": per_game["home"][1] - per_game["away"][1],
    }
    out |= {f"diff_{c}": or_default(H(c), 0.5) - or_default(A(c), 0.5) for c in SHARES}
    for c in (*TEAM_STRENGTHS, *GOALIE_STRENGTHS, *LINEUP):
        out |= {f"home_{c}": H(c), f"away_{c}": A(c), f"diff_{c}": H(c) - A(c)}
    out |= {"home_home_win_pctg": splits["home"], "away_road_win_pctg": splits["away"],
            "diff_home_road_pctg": splits["home"] - splits["away"],
            "h2h_home_win_pctg": F.col("h2h_home_win_pctg"), "home_elo": H("elo"), "away_elo": A("elo"),
            "elo_diff": H("elo") - A("elo")}
    first = [F.col(SPINE).alias("game_id"), *[c for c in keep if c in pairs.columns]]
    return pairs.select(*first, *[c.cast("double").alias(n) for n, c in out.items()])


def build_features(ctx: Context, spine: DataFrame | None = None, game_type: int | None = REGULAR,
                   member_mode: str | None = None, h2h_types=None, rest_types=None, series: DataFrame | None = None) -> DataFrame:
    """Feature rows: for all games of a type, or for requested pairings on any date.

    Without a spine the games are the spine and the recorded starters are used.  With one
    (``spine_id``, home, away, date, optional season, optional ``home_goalie_id`` /
    ``away_goalie_id``), one plan answers all requests.  Head-to-head uses the games of
    ``h2h_types``; by default regular-season games when building those, else all.  With
    ``"by_type"`` regular-season rows use regular-season games and all others use all games.  With ``series``
    playoff rows get the columns of :func:`attach_series`, and are dropped where it drops them.
    """
    if spine is None:
        spine = game_spine(ctx.games, game_type)
        member_mode = member_mode or "actual"
        if h2h_types is None and game_type == REGULAR:
            h2h_types = [REGULAR]
    else:
        spine = request_spine(spine)
        member_mode = member_mode or "latest"
    side_rows = packed_sides(ctx, _sides(spine), member_mode, rest_types=rest_types)
    # earlier meetings are joined to the spine, which is narrow
    regular = ctx.games.where(F.col("game_type") == REGULAR)
    met = spine
    if h2h_types == "by_type":
        met = head_to_head(met, ctx.games, "home_team_id", "away_team_id", "date", base=spine)
        met = met.withColumnRenamed("h2h_home_win_pctg", "_any").drop("h2h_n", "h2h_home_wins")
        met = head_to_head(met, regular, "home_team_id", "away_team_id", "date", base=spine)
        mine = F.when(F.col("game_type") == REGULAR, F.col("h2h_home_win_pctg")).otherwise(F.col("_any"))
        met = met.withColumn("h2h_home_win_pctg", mine)
    else:
        games = ctx.games if h2h_types is None else ctx.games.where(F.col("game_type").isin(*h2h_types))
        met = head_to_head(met, games, "home_team_id", "away_team_id", "date", base=spine)
    if series is not None:  # here as well, while rows are narrow
        met, po = written(met), F.coalesce(F.col("game_type") == PLAYOFF, F.lit(False))
        met = met.where(~po).unionByName(attach_series(met.where(po), ctx.games, series), allowMissingColumns=True)
    pairs = usable(paired(met, side_rows))
    return assemble(pairs, ("season", "date", "game_type", "home_team_id", "away_team_id", "target", *SERIES))


def attach_series(features: DataFrame, games: DataFrame, series: DataFrame) -> DataFrame:
    """Series columns for playoff rows; round 0 and pairs without a series row are dropped."""
    rounds = with_pair(series.where(F.col("round_number").isNotNull()), "top_seed_team_id", "bottom_seed_team_id")
    rounds = rounds.groupBy("bracket_year", "pair_lo", "pair_hi").agg(F.max("round_number").alias("_round"))
    f = with_pair(features, "home_team_id", "away_team_id").withColumn("bracket_year", bracket_year("season"))
    f = f.join(rounds, ["bracket_year", "pair_lo", "pair_hi"]).where(F.col("_round") != 0).drop(
        "_round", "pair_lo", "pair_hi")
    state = series_state(games.where(F.col("game_type") == PLAYOFF), "season", **_GAME).select(
        F.col("id").alias("game_id"), *SERIES[:3])
    f = f.join(state, "game_id", "left")
    return seed_difference(f, seat_seeds(series), "bracket_year", "home_team_id", "away_team_id").drop("bracket_year")


def live_series(requests: DataFrame, games: DataFrame, series: DataFrame) -> DataFrame:
    """Series columns for requested pairings (``spine_id``, teams, date, ``is_playoff``).

    Regular-season requests get the neutral values; a missing seed makes the difference 0.
    """
    r = series_as_of(requests, games.where(F.col("game_type") == PLAYOFF), "home_team_id", "away_team_id", "date")
    r = r.withColumn("bracket_year", bracket_year(season_of("date")))
    meta = series_context(r, series, "bracket_year", "home_team_id", "away_team_id")
    po = F.coalesce(F.col("is_playoff"), F.lit(False))
    diff = F.coalesce(F.col("home_seed") - F.col("away_seed"), F.lit(0))
    return meta.select(
        *requests.columns, F.when(po, F.col("series_game_number")).otherwise(1).cast("long").alias("series_game_number"),
        F.when(po, F.col("home_series_wins")).otherwise(0).cast("long").alias("home_series_wins"),
        F.when(po, F.col("away_series_wins")).otherwise(0).cast("long").alias("away_series_wins"),
        F.when(po, diff).otherwise(0).cast("long").alias("seed_diff"))
