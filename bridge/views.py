"""Bridge views: the driver's tables in the shape the operators expect.

``SQL`` holds portable text, used as common table expressions by DuckDB and, for the plain
projections, by Spark as well.  The two snapshot views are running totals; Spark builds
those at the (team, day) grain instead of with a window over all rows of a team.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybefore.operators.daystate import DAY, day_end_state
from daybefore.operators.rolling import sides
from daybefore.plans.columns import SHARES, SKATER_STATS, TEAM_STATS
from daybefore.session import written
from daybefore.sources.context import Context

_MATCH = """
SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS match_date, year(o_orderdate) AS season,
       CASE WHEN month(o_orderdate) IN (5,6) THEN 3 ELSE 2 END AS game_type,
       o_custkey % 32 AS home_id, (o_custkey % 32 + 1 + o_orderkey % 31) % 32 AS away_id,
       CAST(floor(o_totalprice) AS BIGINT) % 7 AS home_score,
       CAST(floor(o_totalprice/7.0) AS BIGINT) % 6 AS away_score,
       CASE o_orderstatus WHEN 'F' THEN 'OFF' WHEN 'O' THEN 'final' ELSE 'LIVE' END AS game_state,
       o_custkey AS cust_id
FROM orders"""

_STAT = """
SELECT event_id AS stat_id, user_id AS entity_id, CAST(ts AS DATE) AS stat_date,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE floor(value) END AS num,
       floor(value) + event_id % 11 AS den,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS metric
FROM events"""

_PLAY = """
SELECT dayofyear(ts) * 10 + user_id % 10 AS game_id, event_id AS sort_order,
       CASE event_type WHEN 'purchase' THEN 'goal' WHEN 'click' THEN 'shot-on-goal'
            WHEN 'view' THEN 'missed-shot' WHEN 'error' THEN 'blocked-shot' ELSE 'faceoff' END AS type_key,
       CASE WHEN event_id % 29 = 0 THEN NULL ELSE event_id % 5 + 1 END AS period,
       CASE event_id % 6 WHEN 0 THEN '1551' WHEN 1 THEN '1541' WHEN 2 THEN '1451' WHEN 3 THEN '0651'
            WHEN 4 THEN NULL ELSE '15X1' END AS situation_code,
       CASE WHEN event_id % 31 = 0 THEN NULL ELSE (event_id * 37) % 201 - 100 END AS x_coord,
       (event_id * 53) % 85 - 42 AS y_coord,
       CASE event_id % 5 WHEN 0 THEN 'Wrist' WHEN 1 THEN 'slap' WHEN 2 THEN 'tip-in' WHEN 3 THEN 'cradle'
            ELSE NULL END AS shot_type,
       1 AS home_team_id, 2 AS away_team_id, CAST(1 + event_id % 2 AS INT) AS owner_team_id
FROM events"""

_PLAYGAME = """
SELECT DISTINCT dayofyear(ts) * 10 + user_id % 10 AS game_id, dayofyear(ts) AS season, CAST(ts AS DATE) AS date,
       1 AS home_team_id, 2 AS away_team_id
FROM events WHERE event_type = 'purchase'"""

_ODDS = """
SELECT match_id AS game_id, match_date AS date, 'opening' AS snapshot_type, match_id AS quote_id,
       CASE WHEN match_id % 4 < 2 THEN -(100 + match_id % 150) ELSE 100 + match_id % 200 END AS home_moneyline,
       CASE WHEN match_id % 4 < 2 THEN 100 + match_id % 120 ELSE -(110 + match_id % 90) END AS away_moneyline
FROM m WHERE match_id % 2 = 0
UNION ALL
SELECT match_id, match_date, CASE WHEN match_id % 3 = 0 THEN NULL ELSE 'Closing' END, match_id + 1000000000000,
       CASE WHEN match_id % 7 = 0 THEN NULL WHEN match_id % 4 < 2 THEN -(105 + match_id % 140)
            ELSE 105 + match_id % 190 END,
       CASE WHEN match_id % 4 < 2 THEN 105 + match_id % 110 ELSE -(115 + match_id % 80) END
FROM m WHERE match_id % 5 <> 0"""

_PRED = """
SELECT match_id, match_date, season, ((match_id * 37) % 100 * 2 + 1) / CAST(200 AS DOUBLE) AS p,
       CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS y FROM m"""

_RATE = """
SELECT match_id, season, home_score, away_score, (15 + match_id % 30) / CAST(10 AS DOUBLE) AS lambda_home,
       (12 + match_id % 25) / CAST(10 AS DOUBLE) AS lambda_away,
       (match_id % 4) / CAST(10 AS DOUBLE) AS lambda3 FROM m"""

_SERVED = """
SELECT match_id AS game_id, match_date AS date, match_date AS prediction_date, 'v2.3' AS feature_version,
       CASE WHEN match_id % 3 = 0 THEN 'a' ELSE 'b' END AS model_version,
       ((match_id * 37) % 100 * 2 + 1) / CAST(200 AS DOUBLE) AS home_win_probability,
       CASE WHEN match_id % 9 = 0 THEN NULL WHEN home_score > away_score THEN 1 ELSE 0 END AS home_win_outcome,
       season FROM m"""

_SKATER = """
SELECT event_id AS stat_id, user_id AS player_id, user_id % 8 AS team_id, CAST(ts AS DATE) AS stat_date,
       year(ts) AS season, event_id % 3 AS points, event_id % 7 AS sog, 600 + (event_id * 13) % 900 AS toi_sec
FROM events"""

_GAMES = """
SELECT match_id AS id, match_date AS date,
       (CASE WHEN month(match_date) >= 10 THEN year(match_date) ELSE year(match_date) - 1 END) * 10001 + 1 AS season,
       game_type, home_id AS home_team_id, away_id AS away_team_id, home_score, away_score, game_state FROM m"""

_GOALIES = """
SELECT match_id AS game_id, team_id * 3 + match_id % 3 AS player_id, team_id, is_home,
       18 + (match_id * 7 + team_id) % 17 AS saves, 18 + (match_id * 7 + team_id) % 17 + ga AS shots_against,
       match_date AS date, label AS season
FROM tg WHERE gf + ga <> 3"""

_GVALS = """
SELECT match_id AS game_id, team_id * 3 + match_id % 3 AS player_id, team_id, match_date AS date,
       CASE WHEN match_id % 13 = 0 THEN NULL
            ELSE ((match_id * 31 + team_id * 17) % 400 - 200) / CAST(97 AS DOUBLE) END AS value, label AS season
FROM tg WHERE gf + ga <> 3"""

_TSTATS = """
SELECT match_id AS game_id, team_id, is_home, match_date AS date,
       CASE WHEN match_id % 11 = 0 THEN NULL ELSE (match_id * 3 + team_id) % 50 / CAST(100 AS DOUBLE) END AS pp_pctg,
       (35 + (match_id * 5 + team_id) % 30) / CAST(100 AS DOUBLE) AS faceoff_winning_pctg,
       20 + (match_id * 7 + team_id) % 21 AS sog, 10 + (match_id + team_id) % 25 AS hits,
       8 + (match_id * 3 + team_id * 5) % 14 AS blocked_shots
FROM tg"""

_SHARES = """
SELECT match_id AS game_id, team_id, label AS season, match_date AS date,
       (30 + (match_id * 11 + team_id * 5) % 41) / CAST(97 AS DOUBLE) AS cf_pct,
       (30 + (match_id * 13 + team_id * 3) % 41) / CAST(97 AS DOUBLE) AS xgf_pct,
       (30 + (match_id * 17 + team_id * 7) % 41) / CAST(97 AS DOUBLE) AS hdcf_pct,
       CASE WHEN match_id % 7 < 4 THEN NULL ELSE (30 + (match_id * 19 + team_id) % 41) / CAST(97 AS DOUBLE) END
           AS cf_pct_5v5,
       (30 + (match_id * 23 + team_id) % 41) / CAST(97 AS DOUBLE) AS xgf_pct_5v5,
       CASE WHEN match_id % 7 < 5 THEN NULL ELSE (30 + (match_id * 29 + team_id) % 41) / CAST(97 AS DOUBLE) END
           AS hdcf_pct_5v5
FROM tg"""

# skater log: the lines of an order are the players of that match
_SKATERS = """
SELECT game_id, player_id, team_id, is_home, date, season,
       CASE player_id % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'left' WHEN 2 THEN 'R' WHEN 3 THEN 'd' ELSE NULL END AS position,
       CAST(sum(qty) AS DOUBLE) AS toi_sec, CAST(sum(g) AS DOUBLE) AS goals, CAST(sum(a) AS DOUBLE) AS assists,
       CAST(sum(g + a) AS DOUBLE) AS points, CAST(sum(s) AS DOUBLE) AS sog,
       CAST(sum(g - a) AS DOUBLE) AS plus_minus, CAST(sum(h) AS DOUBLE) AS hits, CAST(sum(b) AS DOUBLE) AS blocked_shots
FROM (
  SELECT t.match_id AS game_id, t.team_id * 24 + l.l_partkey % 24 AS player_id, t.team_id, t.is_home,
         t.match_date AS date, t.label AS season, CAST(floor(l.l_quantity) AS BIGINT) * 20 + 200 AS qty,
         l.l_partkey % 2 AS g, l.l_suppkey % 3 AS a, l.l_partkey % 6 AS s, l.l_suppkey % 4 AS h, l.l_partkey % 3 AS b
  FROM lineitem l JOIN tg t ON t.match_id = l.l_orderkey AND t.is_home = (l.l_linenumber % 2 = 1)
) lines GROUP BY game_id, player_id, team_id, is_home, date, season"""

_SERIES = """
SELECT bracket_year, round_number, top_seed_team_id, bottom_seed_team_id,
       (top_seed_team_id * 7 + bracket_year) % 97 + 1 AS top_seed_rank,
       (bottom_seed_team_id * 7 + bracket_year) % 97 + 1 AS bottom_seed_rank,
       top_seed_wins, bottom_seed_wins,
       CASE WHEN (top_seed_team_id + bracket_year) % 3 = 0 THEN NULL ELSE top_seed_team_id END AS winning_team_id
FROM (
  SELECT season % 10000 AS bracket_year, least(home_team_id, away_team_id) AS top_seed_team_id,
         greatest(home_team_id, away_team_id) AS bottom_seed_team_id,
         (least(home_team_id, away_team_id) + greatest(home_team_id, away_team_id)) % 5 AS round_number,
         sum(CASE WHEN home_score > away_score THEN 1 ELSE 0 END) % 5 AS top_seed_wins, count(*) % 5 AS bottom_seed_wins
  FROM games WHERE game_type = 3 AND home_team_id + away_team_id <> 31 GROUP BY 1, 2, 3, 4
) s"""

_TG = """
SELECT match_id, match_date, season, (CASE WHEN month(match_date) >= 10 THEN year(match_date)
       ELSE year(match_date) - 1 END) * 10001 + 1 AS label, game_type, home_id AS team_id, away_id AS opp_id,
       true AS is_home, home_score AS gf, away_score AS ga FROM m
UNION ALL
SELECT match_id, match_date, season, (CASE WHEN month(match_date) >= 10 THEN year(match_date)
       ELSE year(match_date) - 1 END) * 10001 + 1, game_type, away_id, home_id, false, away_score, home_score FROM m"""

_SNAP = """
SELECT team_id, season, as_of_date, games_played, goal_for, goal_against, wins FROM (
  SELECT team_id, season, match_date AS as_of_date, count(*) OVER w AS games_played, sum(gf) OVER w AS goal_for,
         sum(ga) OVER w AS goal_against, sum(CASE WHEN gf > ga THEN 1 ELSE 0 END) OVER w AS wins,
         row_number() OVER (PARTITION BY team_id, season, match_date ORDER BY match_id DESC) AS rn
  FROM tg WINDOW w AS (PARTITION BY team_id, season ORDER BY match_date, match_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) s WHERE rn = 1 AND day(as_of_date) % 3 = 0"""

_STANDINGS = """
SELECT team_id, season, as_of_date, games_played, points / (2.0 * games_played) AS point_pctg,
       wins / CAST(games_played AS DOUBLE) AS win_pctg, reg_wins / CAST(games_played AS DOUBLE) AS regulation_win_pctg,
       goal_for, goal_against, goal_for - goal_against AS goal_differential, l10_points, home_wins, home_losses,
       road_wins, road_losses, points, wins, losses, ot_losses
FROM (
  SELECT team_id, label AS season, match_date AS as_of_date, count(*) OVER w AS games_played,
         sum(gf) OVER w AS goal_for, sum(ga) OVER w AS goal_against,
         sum(CASE WHEN gf > ga THEN 1 ELSE 0 END) OVER w AS wins,
         sum(CASE WHEN gf > ga + 1 THEN 1 ELSE 0 END) OVER w AS reg_wins,
         sum(CASE WHEN gf < ga THEN 1 ELSE 0 END) OVER w AS losses,
         sum(CASE WHEN gf = ga THEN 1 ELSE 0 END) OVER w AS ot_losses,
         sum(CASE WHEN gf > ga AND is_home THEN 1 ELSE 0 END) OVER w AS home_wins,
         sum(CASE WHEN gf < ga AND is_home THEN 1 ELSE 0 END) OVER w AS home_losses,
         sum(CASE WHEN gf > ga AND NOT is_home THEN 1 ELSE 0 END) OVER w AS road_wins,
         sum(CASE WHEN gf < ga AND NOT is_home THEN 1 ELSE 0 END) OVER w AS road_losses,
         sum(CASE WHEN gf > ga THEN 2 WHEN gf = ga THEN 1 ELSE 0 END) OVER w AS points,
         sum(CASE WHEN gf > ga THEN 2 WHEN gf = ga THEN 1 ELSE 0 END) OVER (PARTITION BY team_id, label
             ORDER BY match_date, match_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l10_points,
         row_number() OVER (PARTITION BY team_id, label, match_date ORDER BY match_id DESC) AS rn
  FROM tg WINDOW w AS (PARTITION BY team_id, label ORDER BY match_date, match_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) s WHERE rn = 1 AND day(as_of_date) % 3 = 0"""

#: Lines that one task of the skater log joins and adds up.
LINES = 1_000_000

SQL: dict[str, tuple[str, str]] = {
    "m": ("", _MATCH), "tg": ("m", _TG), "stat": ("", _STAT), "snap": ("tg", _SNAP), "play": ("", _PLAY),
    "playgame": ("", _PLAYGAME), "odds": ("m", _ODDS), "pred": ("m", _PRED), "rate": ("m", _RATE),
    "served": ("m", _SERVED), "skater": ("", _SKATER), "games": ("m", _GAMES), "standings": ("tg", _STANDINGS),
    "goalies": ("tg", _GOALIES), "gvals": ("tg", _GVALS), "tstats": ("tg", _TSTATS), "shares": ("tg", _SHARES),
    "skaters": ("tg", _SKATERS), "series": ("games", _SERIES),
}


def ctes(names) -> str:
    """A WITH clause for the named views and what they need, in order."""
    out: dict[str, str] = {}

    def add(n):
        if n in out:
            return
        needs, text = SQL[n]
        for d in needs.split():
            add(d)
        out[n] = text
    for n in names:
        add(n)
    if not out:
        return ""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({t.strip()}\n)" for n, t in out.items()) + "\n"


class Views:
    """The same views as lazily built DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        import re
        for n in frames:
            text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
        return self.spark.sql(text, **frames)

    @cached_property
    def m(self):
        return self._sql(_MATCH, orders=self.table("orders"))

    @cached_property
    def tg(self):
        return self._sql(_TG, m=self.m)

    @cached_property
    def stat(self):
        return self._sql(_STAT, events=self.table("events"))

    @cached_property
    def play(self):
        return self._sql(_PLAY, events=self.table("events"))

    @cached_property
    def playgame(self):
        return self._sql(_PLAYGAME, events=self.table("events"))

    @cached_property
    def odds(self):
        return self._sql(_ODDS, m=self.m)

    @cached_property
    def pred(self):
        return self._sql(_PRED, m=self.m)

    @cached_property
    def rate(self):
        return self._sql(_RATE, m=self.m)

    @cached_property
    def served(self):
        return self._sql(_SERVED, m=self.m)

    @cached_property
    def skater(self):
        return self._sql(_SKATER, events=self.table("events"))

    @cached_property
    def games(self):
        return self._sql(_GAMES, m=self.m)

    @cached_property
    def goalies(self):
        return self._sql(_GOALIES, tg=self.tg)

    @cached_property
    def gvals(self):
        return self._sql(_GVALS, tg=self.tg)

    @cached_property
    def tstats(self):
        return self._sql(_TSTATS, tg=self.tg)

    @cached_property
    def shares(self):
        return self._sql(_SHARES, tg=self.tg)

    @cached_property
    def skaters(self):
        lines, tg = self.table("lineitem"), self.tg
        tasks = -(-lines.count() // LINES)
        if tasks > int(self.spark.conf.get("spark.sql.shuffle.partitions")):  # nearly every line is a group of its own
            lines = lines.repartition(tasks, "l_orderkey", F.expr("l_linenumber % 2 = 1"))
            tg = tg.repartition(tasks, "match_id", "is_home")
        return self._sql(_SKATERS, lineitem=lines, tg=tg)

    @cached_property
    def series(self):
        return self._sql(_SERIES, games=self.games)

    def _to_date(self, season: str, sums: dict) -> DataFrame:
        """Running totals per (team, season) at its days: daily sums first, then a window over days."""
        keys = ["team_id", season]
        daily = self.tg.groupBy(*keys, F.col("match_date").alias(DAY)).agg(
            F.count(F.lit(1)).alias("games_played"), F.sum("gf").alias("goal_for"), F.sum("ga").alias("goal_against"),
            *[F.count_if(c).alias(n) for n, c in sums.items()])
        w = Window.partitionBy(*keys).orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
        names = ["games_played", "goal_for", "goal_against", *sums]
        return daily.select(*keys, DAY, *[F.sum(c).over(w).alias(c) for c in names])

    @cached_property
    def snap(self):
        won = {"wins": F.col("gf") > F.col("ga")}
        t = self._to_date("season", won).withColumnRenamed(DAY, "as_of_date")
        return t.where(F.day("as_of_date") % 3 == 0).select(
            "team_id", "season", "as_of_date", "games_played", "goal_for", "goal_against", "wins")

    @cached_property
    def standings(self):
        gf, ga, home = F.col("gf"), F.col("ga"), F.col("is_home")
        sums = {"wins": gf > ga, "reg_wins": gf > ga + 1, "losses": gf < ga, "ot_losses": gf == ga,
                "home_wins": (gf > ga) & home, "home_losses": (gf < ga) & home,
                "road_wins": (gf > ga) & ~home, "road_losses": (gf < ga) & ~home}
        t = self._to_date("label", sums)
        pts = self.tg.withColumn("_pt", F.when(gf > ga, 2).when(gf == ga, 1).otherwise(0))
        l10 = day_end_state(pts, ["team_id", "label"], "match_date", ["match_id"], 10, ["_pt"],
                            lambda w: {"l10_points": F.sum("_pt").over(w)})
        t = t.where(F.day(DAY) % 3 == 0).join(l10, ["team_id", "label", DAY])
        gp = F.col("games_played").cast("double")
        points = F.col("wins") * 2 + F.col("ot_losses")
        return t.select(
            "team_id", F.col("label").alias("season"), F.col(DAY).alias("as_of_date"), "games_played",
            (points / (2.0 * gp)).alias("point_pctg"), (F.col("wins") / gp).alias("win_pctg"),
            (F.col("reg_wins") / gp).alias("regulation_win_pctg"), "goal_for", "goal_against",
            (F.col("goal_for") - F.col("goal_against")).alias("goal_differential"), "l10_points", "home_wins",
            "home_losses", "road_wins", "road_losses", points.alias("points"), "wins", "losses", "ot_losses")

    def _context(self, keep) -> Context:
        return Context(self.games, keep(self.standings), self.goalies, self.gvals, self.tstats, self.shares,
                       written(self.skaters)).normalised()

    @cached_property
    def context(self) -> Context:
        """The seven tables; the two that are aggregates here are written first, as they are stored tables elsewhere."""
        return self._context(written)

    @cached_property
    def skater_log(self) -> DataFrame:
        """The context's skaters with their rolling columns, for which no other table is written."""
        return self._context(lambda df: df).skaters


__all__ = ["SQL", "Views", "ctes", "SHARES", "SKATER_STATS", "TEAM_STATS", "sides"]
