"""Unordered-pair operators: head-to-head, series state, completed series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybefore.operators.daystate import DAY, attach, days_of, prior_sums
from daybefore.operators.prefix import BLOCK, prefix_sums

PAIR = ["pair_lo", "pair_hi"]


def with_pair(df: DataFrame, a: str = "home_id", b: str = "away_id") -> DataFrame:
    return df.withColumns({"pair_lo": F.least(a, b), "pair_hi": F.greatest(a, b)})


def _wins(home: str, away: str, hs: str, as_: str) -> tuple[Column, Column]:
    """Wins of the low and the high id by strictly more goals; a tie is a win for nobody."""
    low_home = F.col(home) == F.col("pair_lo")
    home_won, away_won = F.col(hs) > F.col(as_), F.col(as_) > F.col(hs)
    low = F.when(low_home, home_won).otherwise(away_won)
    high = F.when(low_home, away_won).otherwise(home_won)
    return F.coalesce(low.cast("long"), F.lit(0)), F.coalesce(high.cast("long"), F.lit(0))


def head_to_head(spine: DataFrame, hist: DataFrame, home: str = "home_id", away: str = "away_id",
                 time: str = "match_date", hs: str = "home_score", as_: str = "away_score",
                 spine_time: str | None = None, base: DataFrame | None = None) -> DataFrame:
    """Win rate of the spine row's home side over all earlier meetings of the pair, either venue, any season.

    Adds ``h2h_home_win_pctg`` (NULL without a meeting), ``h2h_home_wins`` and ``h2h_n``.
    """
    t = spine_time or time
    s = with_pair(spine, home, away)
    h = with_pair(hist, home, away)
    low, high = _wins(home, away, hs, as_)
    asked = s if base is None else with_pair(base, home, away)
    got = prior_sums(days_of(asked, PAIR, t), h, PAIR, time, {"_lo": low, "_hi": high, "_n": F.lit(1)}, {"": None})
    out = attach(s, got, PAIR, t)
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    won = F.coalesce(F.when(F.col(home) == F.col("pair_lo"), F.col("_lo")).otherwise(F.col("_hi")), F.lit(0))
    return out.withColumns({
        "h2h_n": n, "h2h_home_wins": won.cast("long"),
        "h2h_home_win_pctg": F.when(n > 0, won / F.when(n > 0, n)),
    }).drop("_lo", "_hi", "_n", *PAIR)


def series_as_of(spine: DataFrame, hist: DataFrame, home: str = "home_id", away: str = "away_id",
                 time: str = "match_date", hs: str = "home_score", as_: str = "away_score",
                 spine_time: str | None = None) -> DataFrame:
    """Live series state for requested pairings: wins so far of each side and the next game's number.

    A meeting the home side did not win counts for the away side.
    """
    out = head_to_head(spine, hist, home, away, time, hs, as_, spine_time)
    return out.withColumns({
        "home_series_wins": F.col("h2h_home_wins"),
        "away_series_wins": F.col("h2h_n") - F.col("h2h_home_wins"),
        "series_game_number": F.col("h2h_n") + 1,
    }).drop("h2h_n", "h2h_home_wins", "h2h_home_win_pctg")


def series_state(matches: DataFrame, season: str = "season", id: str = "match_id", time: str = "match_date",
                 home: str = "home_id", away: str = "away_id", hs: str = "home_score", as_: str = "away_score",
                 block: int = BLOCK) -> DataFrame:
    """Before each match of a (season, pair): its number and the wins of each side so far.

    Order is (date, id).  A match the home side did not win counts for the away side.
    """
    m = with_pair(matches, home, away)
    home_won = F.coalesce(F.col(hs) > F.col(as_), F.lit(False))
    low_won = F.when(F.col(home) == F.col("pair_lo"), home_won).otherwise(~home_won).cast("long")
    levels = [F.col(time).cast("date"), F.floor(F.col(id) / block).cast("long"), F.col(id)]
    got = prefix_sums(m, [season, *PAIR], levels, {"_n": F.lit(1).cast("long"), "_lo": low_won})
    high = F.col("_n") - F.col("_lo")
    at_home = F.col(home) == F.col("pair_lo")
    return got.withColumns({
        "series_game_number": F.col("_n") + 1,
        "home_series_wins": F.when(at_home, F.col("_lo")).otherwise(high),
        "away_series_wins": F.when(at_home, high).otherwise(F.col("_lo")),
    }).drop("_n", "_lo", *PAIR)


def completed_series(matches: DataFrame, seeds: DataFrame, season: str = "season", id: str = "match_id",
                     time: str = "match_date", home: str = "home_id", away: str = "away_id",
                     hs: str = "home_score", as_: str = "away_score", wins_needed: int = 4) -> DataFrame:
    """One row per (season, pair) in which a side reached ``wins_needed``; the better seed is side A.

    ``seeds`` is (``season``, ``team_id``, ``seed``).  Series without both seeds are left out.
    """
    m = with_pair(matches.where(F.col(hs).isNotNull() & F.col(as_).isNotNull()), home, away)
    home_won = F.col(hs) > F.col(as_)
    low_won = F.when(F.col(home) == F.col("pair_lo"), home_won).otherwise(~home_won)
    order = F.struct(F.col(time).cast("date"), F.col(id))
    first = F.min_by(F.struct(F.col(id).alias("id"), F.col(time).cast("date").alias("d"),
                              F.col(home).alias("h"), F.col(away).alias("a")), order)
    g = m.groupBy(season, *PAIR).agg(
        F.count_if(low_won).alias("_lo"), F.count_if(~low_won).alias("_hi"), first.alias("_f"))
    g = g.where(F.greatest("_lo", "_hi") >= wins_needed)
    g = g.select(season, *PAIR, "_lo", "_hi", F.col("_f.h").alias("_h"), F.col("_f.a").alias("_a"),
                 F.col("_f.d").alias("start_date"), F.col("_f.id").alias("first_id"))
    sh = seeds.select(F.col(season), F.col("team_id").alias("_h"), F.col("seed").alias("_sh"))
    sa = seeds.select(F.col(season), F.col("team_id").alias("_a"), F.col("seed").alias("_sa"))
    g = g.join(sh, [season, "_h"]).join(sa, [season, "_a"])
    diff = (F.col("_sh") - F.col("_sa")).cast("double")
    a_is_home = diff < 0
    team_a = F.when(a_is_home, F.col("_h")).otherwise(F.col("_a"))
    team_b = F.when(a_is_home, F.col("_a")).otherwise(F.col("_h"))
    a_wins = F.when(team_a == F.col("pair_lo"), F.col("_lo")).otherwise(F.col("_hi"))
    return g.where(diff.isNotNull()).select(
        season, "start_date", "first_id", team_a.alias("team_a_id"), team_b.alias("team_b_id"),
        F.when(a_is_home, diff).otherwise(-diff).alias("seed_diff_a_home"),
        (a_wins * 2 > F.col("_lo") + F.col("_hi")).cast("int").alias("team_a_won"),
        (F.col("_lo") + F.col("_hi")).alias("n_games"))


def seat_seeds(series: DataFrame, year: str = "bracket_year") -> DataFrame:
    """Unpivot the two seats of each series into one (year, team_id, seed) row per team.

    A team in several rounds keeps the seed of its last round.
    """
    def seat(s):
        return series.where(F.col(f"{s}_seed_team_id").isNotNull() & F.col(f"{s}_seed_rank").isNotNull()
                            & (F.col(f"{s}_seed_rank") != 0)).select(
            F.col(year), F.col(f"{s}_seed_team_id").alias("team_id"), F.col(f"{s}_seed_rank").alias("seed"),
            F.col("round_number"))
    both = seat("top").unionByName(seat("bottom"))
    return both.groupBy(year, "team_id").agg(
        F.max_by("seed", F.struct(F.coalesce("round_number", F.lit(-1)), "seed")).alias("seed"))


def series_context(spine: DataFrame, series: DataFrame, year: str = "bracket_year", home: str = "home_id",
                   away: str = "away_id") -> DataFrame:
    """The series row of each pairing seen from the home side: round, wins, seeds, clinched, winner."""
    s = with_pair(series, "top_seed_team_id", "bottom_seed_team_id")
    meta = s.select(year, *PAIR, "round_number", "top_seed_team_id", "top_seed_wins", "bottom_seed_wins",
                    "top_seed_rank", "bottom_seed_rank", F.col("winning_team_id").alias("series_winner_id"))
    out = with_pair(spine, home, away).join(meta, [year, *PAIR], "left")
    top_home = F.col("top_seed_team_id") == F.col(home)
    found = F.col("top_seed_team_id").isNotNull()
    top_w = F.coalesce("top_seed_wins", F.lit(0))
    bot_w = F.coalesce("bottom_seed_wins", F.lit(0))
    return out.select(
        *spine.columns, "round_number",
        F.when(found, F.when(top_home, top_w).otherwise(bot_w)).alias("home_wins"),
        F.when(found, F.when(top_home, bot_w).otherwise(top_w)).alias("away_wins"),
        F.when(top_home, F.col("top_seed_rank")).otherwise(F.col("bottom_seed_rank")).alias("home_seed"),
        F.when(top_home, F.col("bottom_seed_rank")).otherwise(F.col("top_seed_rank")).alias("away_seed"),
        F.when(found, F.col("series_winner_id").isNotNull()).alias("series_clinched"), "series_winner_id")


def seed_difference(df: DataFrame, seeds: DataFrame, year: str = "bracket_year", home: str = "home_id",
                    away: str = "away_id") -> DataFrame:
    """Add ``seed_diff`` = seed of home - seed of away; NULL if either is unknown."""
    h = seeds.select(year, F.col("team_id").alias(home), F.col("seed").alias("_sh"))
    a = seeds.select(year, F.col("team_id").alias(away), F.col("seed").alias("_sa"))
    out = df.join(h, [year, home], "left").join(a, [year, away], "left")
    return out.select(*df.columns, (F.col("_sh") - F.col("_sa")).alias("seed_diff"))
