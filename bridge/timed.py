"""As-of joins, rolling windows, ratings, pairs, events and strengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from bridge.registry import query
from bridge.views import SQL
from daybefore.functions import events as EV
from daybefore.functions import scalars as S
from daybefore.operators import asof, events, pairs, prefix, rating, rolling, strength
from daybefore.plans.columns import SHARES, SKATER_STATS, STANDING_MEASURES, TEAM_STATS
from daybefore.plans.features import attach_series
from daybefore.sources import scans

# ---- as-of joins ------------------------------------------------------------------------------

_SNAPCOLS = "match_id team_id as_of_date:t games_played goal_for wins"
_ASOF = """
SELECT t.match_id, t.team_id, s.as_of_date, s.games_played, s.goal_for, s.wins
FROM tg t ASOF LEFT JOIN snap s ON s.team_id = t.team_id AND s.season = t.season AND t.match_date {op} s.as_of_date"""
_KEEP = ["games_played", "goal_for", "wins"]


@query("asof_strict", "J1", _SNAPCOLS, "tg snap", _ASOF.format(op=">"))
def _(v):
    return asof.asof_join(v.tg, v.snap, ["team_id", "season"], "match_date", "as_of_date", _KEEP)


@query("asof_inclusive", "J2", _SNAPCOLS, "tg snap", _ASOF.format(op=">="))
def _(v):
    return asof.asof_join(v.tg, v.snap, ["team_id", "season"], "match_date", "as_of_date", _KEEP, inclusive=True)


SQL["lateststart"] = ("goalies", """
SELECT team_id, date, player_id, game_id FROM (
  SELECT *, row_number() OVER (PARTITION BY team_id, date ORDER BY game_id DESC) AS rn FROM goalies) g WHERE rn = 1""")


@query("latest_member", "J3 W10", "match_id team_id player_id", "tg lateststart", """
SELECT t.match_id, t.team_id, s.player_id FROM tg t
ASOF LEFT JOIN lateststart s ON s.team_id = t.team_id AND t.match_date > s.date""")
def _(v):
    h = v.goalies.select("team_id", "date", "game_id", "player_id")
    return asof.asof_join(v.tg, h, ["team_id"], "match_date", "date", ["player_id"], order=["game_id"])


@query("resolve_override", "J5", "match_id team_id player_id override_used:b", "tg goalies lateststart", """
SELECT t.match_id, t.team_id, CASE WHEN f.first < t.match_date THEN t.asked ELSE s.player_id END AS player_id,
       coalesce(f.first < t.match_date, false) AS override_used
FROM (SELECT *, CASE WHEN match_id % 4 = 0 THEN NULL ELSE team_id * 3 + match_id % 5 END AS asked FROM tg) t
ASOF LEFT JOIN lateststart s ON s.team_id = t.team_id AND t.match_date > s.date
LEFT JOIN (SELECT team_id, player_id, min(date) AS first FROM goalies GROUP BY 1, 2) f
  ON f.team_id = t.team_id AND f.player_id = t.asked""")
def _(v):
    asked = F.when(F.col("match_id") % 4 != 0, F.col("team_id") * 3 + F.col("match_id") % 5)
    return asof.resolve_override(v.tg.withColumn("asked", asked), v.goalies, "team_id", "player_id", "date",
                                 "match_date", "asked", ["game_id"])


_BASE = """
SELECT season, as_of_date, avg(goal_for / CAST(nullif(games_played, 0) AS DOUBLE)) AS gf,
       avg(goal_against / CAST(nullif(games_played, 0) AS DOUBLE)) AS ga FROM {snap} GROUP BY season, as_of_date"""


@query("asof_group_mean", "J6 A6", "match_id league_gf_pg:d league_ga_pg:d", "m snap", f"""
SELECT m.match_id, coalesce(b.gf, 3.0) AS league_gf_pg, coalesce(b.ga, 3.0) AS league_ga_pg
FROM m ASOF LEFT JOIN ({_BASE.format(snap="snap")}) b ON b.season = m.season AND m.match_date > b.as_of_date""")
def _(v):
    return strength.team_baselines(v.m, v.snap)


# ---- rolling windows --------------------------------------------------------------------------


def strict(body_cols: str, src: str, entity: str, time: str, id: str, outs: str) -> str:
    """SQL: a frame of 10 earlier rows, taken at the first row of each (entity, date)."""
    firsts = ", ".join(f"first_value({o}) OVER fw AS {o}" for o in outs.split())
    return f"""
SELECT {entity}, {time}, {id}, {firsts} FROM (
  SELECT {entity}, {time}, {id}, {body_cols} FROM {src}
  WINDOW w AS (PARTITION BY {entity} ORDER BY {time}, {id} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) x
WINDOW fw AS (PARTITION BY {entity}, {time} ORDER BY {id})"""


def _mean(c, out=None):
    return f"CASE WHEN count({c}) OVER w >= 3 THEN avg({c}) OVER w END AS {out or 'rolling_' + c}"


_RATIO = ("CASE WHEN count({n}) OVER w >= 3 AND count({d}) OVER w >= 3 AND sum({d}) OVER w <> 0 "
          "THEN sum({n}) OVER w / CAST(sum({d}) OVER w AS DOUBLE) END AS {o}")


@query("rolling_ratio_prior", "W1", "stat_id entity_id rate:d", "stat",
       strict(_RATIO.format(n="num", d="den", o="rate"), "stat", "entity_id", "stat_date", "stat_id", "rate"))
def _(v):
    return rolling.rolling_ratio_prior(v.stat, "entity_id", "stat_date", "stat_id", "num", "den")


@query("rolling_mean_prior", "W2", "stat_id entity_id rolling_metric:d", "stat",
       strict(_mean("metric"), "stat", "entity_id", "stat_date", "stat_id", "rolling_metric"))
def _(v):
    return rolling.rolling_mean_prior(v.stat, "entity_id", "stat_date", "stat_id", ["metric"])


_TS = [f"rolling_{c}" for c in TEAM_STATS]


@query("team_stats_rolling", "W3", "game_id team_id " + " ".join(f"{c}:d" for c in _TS), "tstats",
       strict(", ".join(_mean(c) for c in TEAM_STATS), "tstats", "team_id", "date", "game_id", " ".join(_TS)))
def _(v):
    return rolling.rolling_mean_prior(v.tstats, "team_id", "date", "game_id", TEAM_STATS)


_SH = [f"rolling_{c}" for c in SHARES]


@query("share_rolling", "W4", "game_id team_id " + " ".join(f"{c}:d" for c in _SH), "shares",
       strict(", ".join(_mean(c) for c in SHARES), "shares", "team_id", "date", "game_id", " ".join(_SH)))
def _(v):
    return rolling.rolling_mean_prior(v.shares, "team_id", "date", "game_id", SHARES)


_SK = [f"rolling_{c}" for c in [*SKATER_STATS, "toi_sec"]]
SQL["skroll0"] = ("skaters", strict(", ".join(_mean(c) for c in [*SKATER_STATS, "toi_sec"]), "skaters", "player_id",
                                    "date", "game_id", " ".join(_SK)))
SQL["skroll"] = ("skaters skroll0", """
SELECT s.*, {} FROM skaters s JOIN skroll0 r ON r.player_id = s.player_id AND r.game_id = s.game_id""".format(
    ", ".join(f"r.{c}" for c in _SK)))


@query("skater_rolling", "W5", "game_id player_id team_id " + " ".join(f"{c}:d" for c in _SK), "skroll",
       "SELECT * FROM skroll")
def _(v):
    return v.skater_log


# arbitrary-date form: every customer asks for one entity on its own date
SQL["asks"] = ("", """
SELECT o_orderkey AS ask_id, o_custkey % 150 AS entity_id, CAST(date_trunc('month', TIMESTAMP '2024-01-01 00:00:00') AS DATE)
       + CAST(o_orderkey % 35 AS INT) AS ask_date FROM orders""")


def _asks(v):
    o = v.table("orders")
    return o.select(F.col("o_orderkey").alias("ask_id"), (F.col("o_custkey") % 150).alias("entity_id"),
                    F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 35).cast("int")).alias("ask_date"))


SQL["daystate"] = ("stat", """
SELECT * FROM (
  SELECT entity_id, stat_date, row_number() OVER (PARTITION BY entity_id, stat_date ORDER BY stat_id DESC) AS rn,
         CASE WHEN count(metric) OVER w >= 3 THEN avg(metric) OVER w END AS rolling_metric,
         {} FROM stat
  WINDOW w AS (PARTITION BY entity_id ORDER BY stat_date, stat_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) x
WHERE rn = 1""".format(_RATIO.format(n="num", d="den", o="rate")))


@query("rolling_as_of", "W6", "ask_id entity_id rolling_metric:d", "asks daystate", """
SELECT a.ask_id, a.entity_id, d.rolling_metric FROM asks a
ASOF LEFT JOIN daystate d ON d.entity_id = a.entity_id AND a.ask_date > d.stat_date""")
def _(v):
    return rolling.rolling_as_of(_asks(v), v.stat, "entity_id", "stat_date", "stat_id", ["metric"], spine_time="ask_date")


@query("ratio_as_of", "W6", "ask_id entity_id rate:d", "asks daystate", """
SELECT a.ask_id, a.entity_id, d.rate FROM asks a
ASOF LEFT JOIN daystate d ON d.entity_id = a.entity_id AND a.ask_date > d.stat_date""")
def _(v):
    return rolling.ratio_as_of(_asks(v), v.stat, "entity_id", "stat_date", "stat_id", "num", "den",
                               spine_time="ask_date")


@query("actual_member_value", "J4", "match_id team_id player_id value:d", "tg goalies gvals", """
SELECT t.match_id, t.team_id, g.player_id, x.value FROM tg t
LEFT JOIN goalies g ON g.game_id = t.match_id AND g.team_id = t.team_id AND g.is_home = t.is_home
LEFT JOIN gvals x ON x.game_id = t.match_id AND x.player_id = g.player_id""")
def _(v):
    starts = v.goalies.select(F.col("game_id").alias("match_id"), "team_id", "is_home", "player_id")
    vals = v.gvals.select(F.col("game_id").alias("match_id"), "player_id", "value")
    return v.tg.join(starts, ["match_id", "team_id", "is_home"], "left").join(vals, ["match_id", "player_id"], "left")


SQL["lastday"] = ("tg", """
SELECT team_id, match_date, date_diff('day', lag(match_date) OVER (PARTITION BY team_id ORDER BY match_date), match_date) AS rest
FROM (SELECT DISTINCT team_id, match_date FROM tg) d""")


@query("rest_days", "W7", "match_id team_id rest_days is_b2b", "tg lastday", """
SELECT t.match_id, t.team_id, l.rest AS rest_days, CASE WHEN l.rest = 1 THEN 1 ELSE 0 END AS is_b2b
FROM tg t JOIN lastday l ON l.team_id = t.team_id AND l.match_date = t.match_date""")
def _(v):
    return rolling.rest_days(v.m)


@query("rest_advantage", "W7 P4 J7", "match_id home_rest away_rest rest_advantage", "m lastday", """
SELECT m.match_id, h.rest AS home_rest, a.rest AS away_rest, coalesce(h.rest, 2) - coalesce(a.rest, 2) AS rest_advantage
FROM m JOIN lastday h ON h.team_id = m.home_id AND h.match_date = m.match_date
JOIN lastday a ON a.team_id = m.away_id AND a.match_date = m.match_date""")
def _(v):
    r = rolling.rest_days(v.m).select("match_id", "team_id", "rest_days")
    h = r.select("match_id", F.col("team_id").alias("home_id"), F.col("rest_days").alias("home_rest"))
    a = r.select("match_id", F.col("team_id").alias("away_id"), F.col("rest_days").alias("away_rest"))
    j = v.m.join(h, ["match_id", "home_id"], "left").join(a, ["match_id", "away_id"], "left")
    return j.withColumn("rest_advantage", S.or_default("home_rest", 2) - S.or_default("away_rest", 2))


@query("split_record", "W12", "match_id team_id split_games split_wins:d", "tg", """
SELECT match_id, team_id, count(*) OVER w AS split_games,
       coalesce(sum(CASE WHEN gf > ga THEN 1 ELSE 0 END) OVER w, 0) AS split_wins
FROM (SELECT *, date_diff('day', DATE '1970-01-01', match_date) AS dn FROM tg) t
WINDOW w AS (PARTITION BY team_id, season, is_home ORDER BY dn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(v):
    played = rolling.sides(v.m, keep=["season"])
    return strength.split_record(played, played)


# ---- rating -----------------------------------------------------------------------------------

SQL["elo0"] = ("m", """
SELECT season, match_date, match_id, home_id, away_id, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS y,
       row_number() OVER (PARTITION BY season ORDER BY match_date, match_id) AS rn FROM m""")
_STEP = """
SELECT season, CAST(0 AS BIGINT) AS rn, list_transform(range(0, 32), lambda x: CAST(1500 AS DOUBLE)) AS cur,
       list_transform(range(0, 32), lambda x: CAST(1500 AS DOUBLE)) AS st, CAST(NULL AS DATE) AS d,
       CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS rh, CAST(NULL AS DOUBLE) AS ra,
       CAST(NULL AS DOUBLE) AS sh, CAST(NULL AS DOUBLE) AS sa, CAST(NULL AS DOUBLE) AS nh, CAST(NULL AS DOUBLE) AS na,
       CAST(NULL AS BIGINT) AS home_id, CAST(NULL AS BIGINT) AS away_id
FROM {src} WHERE rn = 1
UNION ALL
SELECT season, rn, list_transform(cur, lambda v, i: CASE WHEN i = home_id + 1 THEN nh WHEN i = away_id + 1 THEN na ELSE v END),
       st, d, id, rh, ra, st[home_id + 1], st[away_id + 1], nh, na, home_id, away_id
FROM (SELECT *, rh + 5 * (y - e) AS nh, ra + 5 * ((1 - y) - (1 - e)) AS na
      FROM (SELECT *, 1 / (1 + pow(CAST(10 AS DOUBLE), (ra - rh - 50) / 400)) AS e
            FROM (SELECT o.season, o.rn, r.cur, CASE WHEN r.d = o.match_date THEN r.st ELSE r.cur END AS st,
                         o.match_date AS d, o.match_id AS id, r.cur[o.home_id + 1] AS rh, r.cur[o.away_id + 1] AS ra,
                         o.y, o.home_id, o.away_id
                  FROM {me} r JOIN {src} o ON o.season = r.season AND o.rn = r.rn + 1) s1) s2) s3"""
SQL["elo"] = ("elo0", _STEP.format(src="elo0", me="elo"))
_ELO = "match_id home_elo:d away_elo:d elo_diff:d"


@query("elo", "W8 F10", _ELO, "elo",
       "SELECT id AS match_id, sh AS home_elo, sa AS away_elo, sh - sa AS elo_diff FROM elo WHERE rn > 0")
def _(v):
    return rating.elo(v.m)


@query("elo_row_order", "W8", _ELO, "elo",
       "SELECT id AS match_id, rh AS home_elo, ra AS away_elo, rh - ra AS elo_diff FROM elo WHERE rn > 0")
def _(v):
    return rating.elo(v.m, same_day="rows")


# ---- pairs ------------------------------------------------------------------------------------

SQL["h2h"] = ("m", """
SELECT match_id, home_id, n, CASE WHEN home_id = lo THEN wlo ELSE whi END AS w FROM (
  SELECT match_id, home_id, lo, count(*) OVER p AS n,
         coalesce(sum(CASE WHEN (home_id = lo AND home_score > away_score) OR (away_id = lo AND away_score > home_score) THEN 1 ELSE 0 END) OVER p, 0) AS wlo,
         coalesce(sum(CASE WHEN (home_id = hi AND home_score > away_score) OR (away_id = hi AND away_score > home_score) THEN 1 ELSE 0 END) OVER p, 0) AS whi
  FROM (SELECT *, least(home_id, away_id) AS lo, greatest(home_id, away_id) AS hi,
               date_diff('day', DATE '1970-01-01', match_date) AS dn FROM m) b
  WINDOW p AS (PARTITION BY lo, hi ORDER BY dn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s""")


@query("head_to_head", "A2", "match_id h2h_n h2h_home_wins h2h_home_win_pctg:d", "h2h", """
SELECT match_id, n AS h2h_n, w AS h2h_home_wins, CASE WHEN n > 0 THEN w / CAST(n AS DOUBLE) END AS h2h_home_win_pctg FROM h2h""")
def _(v):
    return pairs.head_to_head(v.m, v.m)


@query("series_live", "A4", "match_id home_series_wins away_series_wins series_game_number", "h2h", """
SELECT match_id, w AS home_series_wins, n - w AS away_series_wins, n + 1 AS series_game_number FROM h2h""")
def _(v):
    return pairs.series_as_of(v.m, v.m)


SQL["sstate"] = ("m", """
SELECT match_id, home_id, lo, n, wlo FROM (
  SELECT match_id, home_id, lo, count(*) OVER p AS n,
         coalesce(sum(CASE WHEN (home_id = lo) = (home_score > away_score) THEN 1 ELSE 0 END) OVER p, 0) AS wlo
  FROM (SELECT *, least(home_id, away_id) AS lo, greatest(home_id, away_id) AS hi FROM m) b
  WINDOW p AS (PARTITION BY season, lo, hi ORDER BY match_date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s""")


@query("series_state", "A3", "match_id series_game_number home_series_wins away_series_wins", "sstate", """
SELECT match_id, n + 1 AS series_game_number, CASE WHEN home_id = lo THEN wlo ELSE n - wlo END AS home_series_wins,
       CASE WHEN home_id = lo THEN n - wlo ELSE wlo END AS away_series_wins FROM sstate""")
def _(v):
    return pairs.series_state(v.m, block=4096)


@query("series_first_games", "W11", "match_id season", "sstate m", """
SELECT m.match_id, m.season FROM m JOIN sstate s ON s.match_id = m.match_id WHERE s.n = 0""")
def _(v):
    return pairs.series_state(v.m, block=4096).where("series_game_number = 1")


SQL["seeds"] = ("m", "SELECT DISTINCT season, home_id AS team_id, (home_id * 7 + season) % 97 + 1 AS seed FROM m")
SQL["done"] = ("m seeds", """
SELECT season, start_date, first_id, CASE WHEN d < 0 THEN h ELSE a END AS team_a_id, CASE WHEN d < 0 THEN a ELSE h END AS team_b_id,
       CASE WHEN d < 0 THEN d ELSE -d END AS seed_diff_a_home,
       CASE WHEN CASE WHEN (CASE WHEN d < 0 THEN h ELSE a END) = lo THEN wlo ELSE whi END * 2 > wlo + whi THEN 1 ELSE 0 END AS team_a_won,
       wlo + whi AS n_games
FROM (SELECT g.*, s1.seed - s2.seed AS d FROM (
        SELECT season, lo, hi, sum(CASE WHEN (home_id = lo) = (home_score > away_score) THEN 1 ELSE 0 END) AS wlo,
               sum(CASE WHEN (home_id = lo) = (home_score > away_score) THEN 0 ELSE 1 END) AS whi,
               min(CASE WHEN rn = 1 THEN home_id END) AS h, min(CASE WHEN rn = 1 THEN away_id END) AS a,
               min(match_date) AS start_date, min(CASE WHEN rn = 1 THEN match_id END) AS first_id
        FROM (SELECT *, row_number() OVER (PARTITION BY season, lo, hi ORDER BY match_date, match_id) AS rn
              FROM (SELECT *, least(home_id, away_id) AS lo, greatest(home_id, away_id) AS hi FROM m) b) o
        GROUP BY season, lo, hi) g
      JOIN seeds s1 ON s1.season = g.season AND s1.team_id = g.h JOIN seeds s2 ON s2.season = g.season AND s2.team_id = g.a
      WHERE greatest(wlo, whi) >= 4) x""")
_DONE = "season start_date:t first_id team_a_id team_b_id seed_diff_a_home:d team_a_won n_games"


def _seeds(v):
    return v.m.select("season", F.col("home_id").alias("team_id")).distinct().withColumn(
        "seed", (F.col("team_id") * 7 + F.col("season")) % 97 + 1)


@query("completed_series", "A5", _DONE, "done", "SELECT * FROM done")
def _(v):
    return pairs.completed_series(v.m, _seeds(v))


SQL["seats"] = ("series", """
SELECT bracket_year, team_id, seed FROM (
  SELECT *, row_number() OVER (PARTITION BY bracket_year, team_id ORDER BY round_number DESC, seed DESC) AS rn FROM (
    SELECT bracket_year, top_seed_team_id AS team_id, top_seed_rank AS seed, round_number FROM series
    UNION ALL SELECT bracket_year, bottom_seed_team_id, bottom_seed_rank, round_number FROM series) u) r WHERE rn = 1""")


@query("seat_seed_difference", "J12", "id bracket_year seed_diff", "games seats", """
SELECT g.id, g.season % 10000 AS bracket_year, h.seed - a.seed AS seed_diff FROM games g
LEFT JOIN seats h ON h.bracket_year = g.season % 10000 AND h.team_id = g.home_team_id
LEFT JOIN seats a ON a.bracket_year = g.season % 10000 AND a.team_id = g.away_team_id""")
def _(v):
    g = v.games.withColumn("bracket_year", S.bracket_year("season"))
    return pairs.seed_difference(g, pairs.seat_seeds(v.series), "bracket_year", "home_team_id", "away_team_id")


@query("series_context", "S13 J11 J18", "id round_number home_wins away_wins home_seed away_seed series_clinched:b "
       "series_winner_id", "games series", """
SELECT g.id, s.round_number, CASE WHEN s.top_seed_team_id = g.home_team_id THEN s.top_seed_wins ELSE s.bottom_seed_wins END AS home_wins,
       CASE WHEN s.top_seed_team_id = g.home_team_id THEN s.bottom_seed_wins ELSE s.top_seed_wins END AS away_wins,
       CASE WHEN s.top_seed_team_id = g.home_team_id THEN s.top_seed_rank ELSE s.bottom_seed_rank END AS home_seed,
       CASE WHEN s.top_seed_team_id = g.home_team_id THEN s.bottom_seed_rank ELSE s.top_seed_rank END AS away_seed,
       CASE WHEN s.top_seed_team_id IS NOT NULL THEN s.winning_team_id IS NOT NULL END AS series_clinched,
       s.winning_team_id AS series_winner_id
FROM games g LEFT JOIN series s ON s.bracket_year = g.season % 10000
  AND s.top_seed_team_id = least(g.home_team_id, g.away_team_id)
  AND s.bottom_seed_team_id = greatest(g.home_team_id, g.away_team_id)""")
def _(v):
    g = v.games.withColumn("bracket_year", S.bracket_year("season"))
    return pairs.series_context(g, v.series, "bracket_year", "home_team_id", "away_team_id")


SQL["pstate"] = ("games", """
SELECT id, n + 1 AS series_game_number, CASE WHEN home_team_id = lo THEN wlo ELSE n - wlo END AS home_series_wins,
       CASE WHEN home_team_id = lo THEN n - wlo ELSE wlo END AS away_series_wins FROM (
  SELECT id, home_team_id, lo, count(*) OVER p AS n,
         coalesce(sum(CASE WHEN (home_team_id = lo) = (home_score > away_score) THEN 1 ELSE 0 END) OVER p, 0) AS wlo
  FROM (SELECT *, least(home_team_id, away_team_id) AS lo, greatest(home_team_id, away_team_id) AS hi FROM games WHERE game_type = 3) b
  WINDOW p AS (PARTITION BY season, lo, hi ORDER BY date, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) s""")


@query("attach_series", "M3", "game_id series_game_number home_series_wins away_series_wins seed_diff", "games series seats pstate", """
SELECT g.id AS game_id, p.series_game_number, p.home_series_wins, p.away_series_wins, h.seed - a.seed AS seed_diff
FROM games g JOIN series s ON s.bracket_year = g.season % 10000
  AND s.top_seed_team_id = least(g.home_team_id, g.away_team_id)
  AND s.bottom_seed_team_id = greatest(g.home_team_id, g.away_team_id) AND s.round_number <> 0
LEFT JOIN pstate p ON p.id = g.id
LEFT JOIN seats h ON h.bracket_year = g.season % 10000 AND h.team_id = g.home_team_id
LEFT JOIN seats a ON a.bracket_year = g.season % 10000 AND a.team_id = g.away_team_id
WHERE g.game_type = 3""")
def _(v):
    f = v.games.where("game_type = 3").select(F.col("id").alias("game_id"), "season", "date", "home_team_id",
                                              "away_team_id")
    return attach_series(f, v.games, v.series)


@query("live_series", "M4", "id series_game_number home_series_wins away_series_wins seed_diff", "games series", """
SELECT g.id, CASE WHEN po THEN n + 1 ELSE 1 END AS series_game_number, CASE WHEN po THEN w ELSE 0 END AS home_series_wins,
       CASE WHEN po THEN n - w ELSE 0 END AS away_series_wins,
       CASE WHEN po THEN coalesce(CASE WHEN s.top_seed_team_id = g.home_team_id THEN s.top_seed_rank - s.bottom_seed_rank
            ELSE s.bottom_seed_rank - s.top_seed_rank END, 0) ELSE 0 END AS seed_diff
FROM (SELECT id, season, home_team_id, away_team_id, game_type = 3 AS po, n, CASE WHEN home_team_id = lo THEN wlo ELSE whi END AS w FROM (
        SELECT *, coalesce(sum(k) OVER p, 0) AS n,
          coalesce(sum(CASE WHEN (home_team_id = lo AND home_score > away_score) OR (away_team_id = lo AND away_score > home_score) THEN k ELSE 0 END) OVER p, 0) AS wlo,
          coalesce(sum(CASE WHEN (home_team_id = hi AND home_score > away_score) OR (away_team_id = hi AND away_score > home_score) THEN k ELSE 0 END) OVER p, 0) AS whi
        FROM (SELECT *, least(home_team_id, away_team_id) AS lo, greatest(home_team_id, away_team_id) AS hi,
                     CASE WHEN game_type = 3 THEN 1 ELSE 0 END AS k,
                     date_diff('day', DATE '1970-01-01', date) AS dn FROM games) b
        WINDOW p AS (PARTITION BY lo, hi ORDER BY dn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) q) g
LEFT JOIN series s ON s.bracket_year = g.season % 10000
  AND s.top_seed_team_id = least(g.home_team_id, g.away_team_id)
  AND s.bottom_seed_team_id = greatest(g.home_team_id, g.away_team_id)""")
def _(v):
    from daybefore.plans.features import live_series
    req = v.games.select("id", "date", "home_team_id", "away_team_id", (F.col("game_type") == 3).alias("is_playoff"))
    return live_series(req, v.games, v.series)


# ---- events -----------------------------------------------------------------------------------

_PREV = """
SELECT *, lag(type_key) OVER (PARTITION BY game_id ORDER BY sort_order) AS prev FROM play WHERE type_key IN ('shot-on-goal', 'goal')"""


@query("rebound_flag", "W9", "sort_order is_rebound", "play",
       f"SELECT sort_order, CASE WHEN prev = 'shot-on-goal' THEN 1 ELSE 0 END AS is_rebound FROM ({_PREV}) p")
def _(v):
    shots = v.play.where(F.col("type_key").isin(*EV.ON_TARGET))
    got = prefix.lag_in_blocks(shots, "game_id", "sort_order", "type_key", "prev", block=1024)
    return got.withColumn("is_rebound", F.coalesce((F.col("prev") == "shot-on-goal").cast("int"), F.lit(0)))


from bridge.basic import _GEOMETRY, _MANPOWER  # noqa: E402

SQL["evgeo"] = ("play", _GEOMETRY)
SQL["evman"] = ("play", _MANPOWER)
SQL["evprev"] = ("play", _PREV)
SQL["evfeat"] = ("evgeo evman evprev", """
SELECT p.game_id, p.sort_order, g.shot_distance, g.shot_angle, g.is_behind_net, f.is_pp, f.is_sh, f.is_en,
       CASE lower(p.shot_type) WHEN 'wrist' THEN 0 WHEN 'slap' THEN 1 WHEN 'tip-in' THEN 4 ELSE 10 END AS shot_type_code,
       CASE WHEN p.prev = 'shot-on-goal' THEN 1 ELSE 0 END AS is_rebound, least(coalesce(p.period, 1), 4) AS period,
       CASE WHEN p.type_key = 'goal' THEN 1 ELSE 0 END AS is_goal
FROM evprev p JOIN evgeo g ON g.sort_order = p.sort_order JOIN evman f ON f.sort_order = p.sort_order""")


@query("event_features", "M16", "game_id sort_order shot_distance:d shot_angle:d is_behind_net is_pp is_sh is_en "
       "shot_type_code is_rebound period is_goal", "evfeat", "SELECT * FROM evfeat")
def _(v):
    return events.event_features(v.play.where(F.col("type_key").isin(*EV.ON_TARGET)), block=1024)


SQL["made"] = ("play playgame", """
SELECT game_id, season, date, team_id, count(*) AS cf, sum(hd) AS hdcf FROM (
  SELECT p.game_id, g.season, g.date, CASE WHEN type_key = 'blocked-shot' THEN 3 - owner_team_id ELSE owner_team_id END AS team_id,
         CASE WHEN type_key <> 'blocked-shot' AND 89 - abs(coalesce(x_coord, 0)) BETWEEN 0 AND 20
              AND abs(coalesce(y_coord, 0)) <= 22 THEN 1 ELSE 0 END AS hd
  FROM play p JOIN playgame g ON g.game_id = p.game_id WHERE type_key <> 'faceoff') a GROUP BY 1, 2, 3, 4""")


@query("event_shares", "A1 J10 J16 M17 L14", "game_id team_id cf ca hdcf hdca xgf:d xga:d cf_pct:d hdcf_pct:d xgf_pct:d",
       "made", """
SELECT f.game_id, f.team_id, f.cf, coalesce(o.cf, 0) AS ca, f.hdcf, coalesce(o.hdcf, 0) AS hdca, 0 AS xgf, 0 AS xga,
       f.cf / CAST(f.cf + coalesce(o.cf, 0) AS DOUBLE) AS cf_pct,
       CASE WHEN f.hdcf + coalesce(o.hdcf, 0) > 0 THEN f.hdcf / CAST(f.hdcf + coalesce(o.hdcf, 0) AS DOUBLE) ELSE 0.5 END AS hdcf_pct,
       0.5 AS xgf_pct
FROM made f LEFT JOIN made o ON o.game_id = f.game_id AND o.team_id = 3 - f.team_id""")
def _(v):
    att = events.events_of(v.play, v.playgame, EV.ATTEMPTS, cols=("season", "date", "home_team_id", "away_team_id"))
    return events.event_shares(att, keep=("season", "date"))


# ---- strengths --------------------------------------------------------------------------------

SQL["gtg"] = ("tg", "SELECT match_id AS game_id, match_date AS date, label AS season, game_type, team_id, opp_id, is_home, gf, ga FROM tg")
SQL["std"] = ("gtg standings", """
SELECT t.game_id, t.team_id, t.season, t.date, t.is_home, s.* EXCLUDE (team_id, season)
FROM gtg t ASOF LEFT JOIN standings s ON s.team_id = t.team_id AND s.season = t.season AND t.date > s.as_of_date""")
SQL["league"] = ("standings", _BASE.format(snap="standings"))
SQL["split"] = ("gtg", """
SELECT game_id, team_id, count(*) OVER w AS split_games, coalesce(sum(CASE WHEN gf > ga THEN 1 ELSE 0 END) OVER w, 0) AS split_wins
FROM (SELECT *, date_diff('day', DATE '1970-01-01', date) AS dn FROM gtg) t
WINDOW w AS (PARTITION BY team_id, season, is_home ORDER BY dn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
SQL["teamday"] = ("gtg", "SELECT DISTINCT team_id, season, date FROM gtg")
SQL["met"] = ("gtg", """
SELECT team_id, season, date, opps FROM (
  SELECT team_id, season, date, first_value(opps) OVER (PARTITION BY team_id, season, date ORDER BY game_id) AS opps,
         row_number() OVER (PARTITION BY team_id, season, date ORDER BY game_id) AS rn FROM (
    SELECT team_id, season, date, game_id, list(opp_id) OVER (PARTITION BY team_id, season ORDER BY date, game_id
           ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS opps FROM gtg) a) b WHERE rn = 1""")
SQL["sched"] = ("met standings", """
SELECT e.team_id, e.season, e.date, avg(s.point_pctg) AS schedule_value, count(s.point_pctg) AS schedule_n
FROM (SELECT team_id, season, date, unnest(opps) AS opp_id FROM met) e
ASOF LEFT JOIN standings s ON s.team_id = e.opp_id AND s.season = e.season AND e.date > s.as_of_date
GROUP BY 1, 2, 3""")
SQL["advroll"] = ("shares", strict(", ".join(_mean(c, c) for c in SHARES), "shares", "team_id", "date", "game_id", " ".join(SHARES)))
_BM = "(({x}) * ({n}) + ({m}) * ({w})) / (({n}) + ({w}))"
SQL["tstr"] = ("std league split sched advroll", f"""
SELECT *, 0.65 * ({_BM.format(x='recent', n='10', m='win', w='12')} - 0.5) + 0.2 * team_off_strength + 0.15 * team_def_strength AS team_form_blend
FROM (SELECT *, {_BM.format(x='gf', n='gp', m='lgf', w='20')} - lgf + 0.75 * (xgf - 0.5) AS team_off_strength,
             lga - {_BM.format(x='ga', n='gp', m='lga', w='20')} + 0.75 * (hd - 0.5) AS team_def_strength,
             {_BM.format(x='sv', n='sn', m='0.5', w='10')} - 0.5 AS team_schedule_strength,
             {_BM.format(x='spl', n='sg', m='win', w='6')} - win AS team_split_strength
      FROM (SELECT s.game_id, s.team_id, s.season, s.date, s.is_home, coalesce(s.games_played, 0) AS gp,
                   coalesce(l.gf, CAST(3 AS DOUBLE)) AS lgf, coalesce(l.ga, CAST(3 AS DOUBLE)) AS lga,
                   CASE WHEN coalesce(s.games_played, 0) > 0 THEN s.goal_for / CAST(s.games_played AS DOUBLE) ELSE coalesce(l.gf, 3) END AS gf,
                   CASE WHEN coalesce(s.games_played, 0) > 0 THEN s.goal_against / CAST(s.games_played AS DOUBLE) ELSE coalesce(l.ga, 3) END AS ga,
                   coalesce(s.win_pctg, CAST(0.5 AS DOUBLE)) AS win, coalesce(a.xgf_pct, CAST(0.5 AS DOUBLE)) AS xgf,
                   coalesce(a.hdcf_pct_5v5, a.hdcf_pct, CAST(0.5 AS DOUBLE)) AS hd,
                   least(coalesce(s.l10_points, 10) / CAST(20 AS DOUBLE), CAST(1 AS DOUBLE)) AS recent,
                   coalesce(h.schedule_value, CAST(0.5 AS DOUBLE)) AS sv, coalesce(h.schedule_n, 0) AS sn, p.split_games AS sg,
                   CASE WHEN p.split_games > 0 THEN p.split_wins / CAST(p.split_games AS DOUBLE)
                        ELSE coalesce(s.win_pctg, CAST(0.5 AS DOUBLE)) END AS spl
            FROM std s ASOF LEFT JOIN league l ON l.season = s.season AND s.date > l.as_of_date
            JOIN split p ON p.game_id = s.game_id AND p.team_id = s.team_id
            JOIN advroll a ON a.game_id = s.game_id AND a.team_id = s.team_id
            LEFT JOIN sched h ON h.team_id = s.team_id AND h.season = s.season AND h.date = s.date) i) o""")
_TSTR = "team_off_strength:d team_def_strength:d team_schedule_strength:d team_split_strength:d team_form_blend:d"


def _played(v):
    return rolling.sides(v.games, "id", "date", "home_team_id", "away_team_id", keep=["season"])


def _with_team(v, rows, base):
    """Rows with their team's snapshot and rolling shares."""
    rows = asof.asof_join(rows, v.standings, ["team_id", "season"], "date", "as_of_date", STANDING_MEASURES, base=base)
    rows = rolling.rolling_as_of(rows, v.shares, "team_id", "date", "game_id", SHARES, base=base)
    return rows.withColumnsRenamed({f"rolling_{c}": c for c in SHARES})


@query("schedule_form", "J15", "id team_id schedule_value:d schedule_n", "gtg sched", """
SELECT g.game_id AS id, g.team_id, s.schedule_value, coalesce(s.schedule_n, 0) AS schedule_n
FROM gtg g LEFT JOIN sched s ON s.team_id = g.team_id AND s.season = g.season AND s.date = g.date""")
def _(v):
    return strength.schedule_form(_played(v), _played(v), v.standings, time="date", id="id")


@query("team_strength", "A9 A10", "id team_id " + _TSTR, "tstr", "SELECT game_id AS id, * FROM tstr")
def _(v):
    base = _played(v)
    return strength.team_strength(_with_team(v, base, base), base, v.standings, time="date", id="id", base=base)


SQL["actual"] = ("gtg goalies lateststart", """
SELECT t.game_id, t.team_id, t.season, t.date, t.is_home, g.player_id AS actual, coalesce(g.player_id, l.player_id) AS player_id
FROM gtg t LEFT JOIN goalies g ON g.game_id = t.game_id AND g.team_id = t.team_id AND g.is_home = t.is_home
ASOF LEFT JOIN lateststart l ON l.team_id = t.team_id AND t.date > l.date""")
SQL["cums"] = ("goalies", """
SELECT player_id, season, date, max(cs) AS cs, max(csh) AS csh, max(cn) AS cn FROM (
  SELECT player_id, season, date, sum(saves) OVER w AS cs, sum(shots_against) OVER w AS csh, count(*) OVER w AS cn FROM goalies
  WINDOW w AS (PARTITION BY player_id, season ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x GROUP BY 1, 2, 3""")
SQL["cumv"] = ("gvals", """
SELECT DISTINCT player_id, season, date, sum(value) OVER w AS cv, count(value) OVER w AS cn FROM gvals
WINDOW w AS (PARTITION BY player_id, season ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
SQL["lgs"] = ("goalies", """
SELECT DISTINCT season, date, sum(saves) OVER w AS s, sum(shots_against) OVER w AS a FROM goalies
WINDOW w AS (PARTITION BY season ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
SQL["lgv"] = ("gvals", """
SELECT DISTINCT season, date, sum(value) OVER w AS v, count(value) OVER w AS n FROM gvals
WINDOW w AS (PARTITION BY season ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
SQL["prevs"] = ("goalies", "SELECT player_id, season + 10001 AS season, sum(saves) AS ps, sum(shots_against) AS psh FROM goalies GROUP BY 1, 2")
SQL["prevv"] = ("gvals", "SELECT player_id, season + 10001 AS season, sum(value) AS pv, count(value) AS pn FROM gvals GROUP BY 1, 2")
SQL["mhist"] = ("actual cums cumv lgs lgv prevs prevv", """
SELECT a.*, coalesce(c.cs, 0) AS cs, coalesce(c.csh, 0) AS csh, coalesce(c.cn, 0) - coalesce(c14.cn, 0) AS s14,
       coalesce(c.cn, 0) - coalesce(c7.cn, 0) AS s7, coalesce(cv.cv, 0) AS cv, coalesce(cv.cn, 0) AS cvn,
       coalesce(ps.ps, 0) AS ps, coalesce(ps.psh, 0) AS psh, coalesce(pv.pv, 0) AS pv, coalesce(pv.pn, 0) AS pn,
       CASE WHEN ls.a > 0 THEN ls.s / CAST(ls.a AS DOUBLE) ELSE 0.905 END AS lr,
       CASE WHEN lv.n > 0 THEN lv.v / lv.n ELSE 0 END AS lv
FROM actual a ASOF LEFT JOIN cums c ON c.player_id = a.player_id AND c.season = a.season AND a.date > c.date
ASOF LEFT JOIN cums c14 ON c14.player_id = a.player_id AND c14.season = a.season AND a.date - 14 > c14.date
ASOF LEFT JOIN cums c7 ON c7.player_id = a.player_id AND c7.season = a.season AND a.date - 7 > c7.date
ASOF LEFT JOIN cumv cv ON cv.player_id = a.player_id AND cv.season = a.season AND a.date > cv.date
ASOF LEFT JOIN lgs ls ON ls.season = a.season AND a.date > ls.date
ASOF LEFT JOIN lgv lv ON lv.season = a.season AND a.date > lv.date
LEFT JOIN prevs ps ON ps.player_id = a.player_id AND ps.season = a.season
LEFT JOIN prevv pv ON pv.player_id = a.player_id AND pv.season = a.season""")


def _members(v):
    latest = asof.asof_join(_played(v), v.goalies.select("team_id", F.col("date").alias("_t"), F.col("game_id").alias("_g"),
                                                         F.col("player_id").alias("_l")),
                            ["team_id"], "date", "_t", ["_l"], order=["_g"])
    act = v.goalies.select(F.col("game_id").alias("id"), "team_id", "is_home", "player_id")
    return latest.join(act, ["id", "team_id", "is_home"], "left").withColumn("player_id", F.coalesce("player_id", "_l")).drop(
        "_l", "_t")


@query("member_league_baselines", "A7", "id league_rate:d league_value:d", "games lgs lgv", """
SELECT g.id, CASE WHEN ls.a > 0 THEN ls.s / CAST(ls.a AS DOUBLE) ELSE 0.905 END AS league_rate,
       CASE WHEN lv.n > 0 THEN lv.v / lv.n ELSE 0 END AS league_value
FROM games g ASOF LEFT JOIN lgs ls ON ls.season = g.season AND g.date > ls.date
ASOF LEFT JOIN lgv lv ON lv.season = g.season AND g.date > lv.date""")
def _(v):
    return strength.member_baselines(v.games, v.goalies, v.gvals, time="date")


@query("member_history", "A8 J14", "id team_id player_id cur_saves:d cur_shots:d starts_14 starts_7 cur_value:d cur_value_n "
       "prev_saves:d prev_shots:d prev_value:d prev_value_n", "mhist", """
SELECT game_id AS id, team_id, player_id, cs AS cur_saves, csh AS cur_shots, s14 AS starts_14, s7 AS starts_7, cv AS cur_value,
       cvn AS cur_value_n, ps AS prev_saves, psh AS prev_shots, pv AS prev_value, pn AS prev_value_n FROM mhist""")
def _(v):
    return strength.member_history(_members(v), v.goalies, v.gvals, time="date")


SQL["mstr"] = ("mhist tstr lastday", f"""
SELECT game_id, team_id, is_home, actual, player_id, CASE WHEN player_id IS NULL THEN 0 ELSE talent END AS goalie_talent_strength,
       CASE WHEN player_id IS NULL THEN 0 ELSE s14 - 2 END AS goalie_workload,
       CASE WHEN player_id IS NULL THEN 0 ELSE greatest(s7 - 1, 0) * 0.5 + CASE WHEN coalesce(rest, 2) <= 1 THEN 0.75 ELSE 0 END END AS goalie_fatigue,
       CASE WHEN player_id IS NULL THEN 0 ELSE talent - 0.35 * dfn END AS goalie_team_adj_strength, rest
FROM (SELECT *, (cs + 0.5 * ps + 500 * lr) / greatest(csh + 0.5 * psh + 500, 1) - lr + 0.015 * (
             {_BM.format(x='inner_v', n='cvn + 0.5 * pn', m='lv', w='15')}) AS talent
      FROM (SELECT h.*, t.team_def_strength AS dfn, r.rest,
                   CASE WHEN cvn + pn * 0.5 > 0 THEN ((CASE WHEN cvn > 0 THEN cv / cvn ELSE lv END) * cvn
                        + (CASE WHEN pn > 0 THEN pv / pn ELSE lv END) * (pn * 0.5)) / (cvn + pn * 0.5)
                        ELSE CASE WHEN pn > 0 THEN pv / pn ELSE lv END END AS inner_v
            FROM mhist h JOIN tstr t ON t.game_id = h.game_id AND t.team_id = h.team_id
            JOIN lastday r ON r.team_id = h.team_id AND r.match_date = h.date) i) o""")
_MSTR = "goalie_talent_strength:d goalie_workload:d goalie_fatigue:d goalie_team_adj_strength:d"


@query("member_strength", "A11", "id team_id player_id " + _MSTR, "mstr", "SELECT game_id AS id, * FROM mstr")
def _(v):
    base, who = _played(v), _members(v)
    sp = strength.team_strength(_with_team(v, who, base), base, v.standings, time="date", id="id", base=base)
    rest = rolling.rest_days(v.games, "id", "date", "home_team_id", "away_team_id").select("id", "team_id", "rest_days")
    return strength.member_strength(sp.join(rest, ["id", "team_id"]), v.goalies, v.gvals, time="date", base=who)


SQL["skday"] = ("skroll", """
SELECT *, lead(date) OVER (PARTITION BY team_id, season, player_id ORDER BY date) AS until FROM (
  SELECT team_id, season, player_id, date, rolling_toi_sec, rolling_points, rolling_sog,
         row_number() OVER (PARTITION BY team_id, season, player_id, date ORDER BY game_id DESC) AS rn FROM skroll) x WHERE rn = 1""")
SQL["ranked"] = ("skday teamday", """
SELECT t.team_id, t.season, t.date, k.player_id, k.date AS seen, k.rolling_toi_sec AS toi, coalesce(k.rolling_points, 0) AS pts,
       coalesce(k.rolling_sog, 0) AS sog,
       row_number() OVER (PARTITION BY t.team_id, t.season, t.date ORDER BY k.rolling_toi_sec DESC, k.player_id) AS rn
FROM teamday t JOIN skday k ON k.team_id = t.team_id AND k.season = t.season AND k.date < t.date
  AND (k.until IS NULL OR k.until >= t.date)
WHERE k.rolling_toi_sec IS NOT NULL""")
SQL["lineup"] = ("ranked", """
SELECT team_id, season, date, act / CAST(greatest(top, 1) AS DOUBLE) - 0.8 AS lineup_availability,
       CASE WHEN act > 0 THEN ws / w - 0.6 ELSE 0 END AS top_skater_impact, tt / greatest(dt, 1) - 0.55 AS deployment_concentration
FROM (SELECT team_id, season, date, sum(CASE WHEN rn <= 6 AND seen >= date - 10 THEN 1 ELSE 0 END) AS act,
             sum(CASE WHEN rn <= 6 THEN 1 ELSE 0 END) AS top,
             sum(CASE WHEN rn <= 6 AND seen >= date - 10 THEN greatest(toi, 1) * (pts + CAST(0.05 AS DOUBLE) * sog) END) AS ws,
             sum(CASE WHEN rn <= 6 AND seen >= date - 10 THEN greatest(toi, 1) END) AS w,
             sum(CASE WHEN rn <= 6 THEN toi END) AS tt, sum(toi) AS dt
      FROM ranked WHERE rn <= 12 GROUP BY 1, 2, 3) x""")
_LINEUP = "lineup_availability:d top_skater_impact:d deployment_concentration:d"


@query("lineup_context", "A12 A13 T2 U3", "team_id season date:t " + _LINEUP, "teamday lineup", """
SELECT t.team_id, t.season, t.date, coalesce(l.lineup_availability, 0) AS lineup_availability,
       coalesce(l.top_skater_impact, 0) AS top_skater_impact, coalesce(l.deployment_concentration, 0) AS deployment_concentration
FROM teamday t LEFT JOIN lineup l ON l.team_id = t.team_id AND l.season = t.season AND l.date = t.date""")
def _(v):
    td = _played(v).select("team_id", "season", "date").distinct()
    return strength.lineup_context(td, v.skater_log, time="date", id="game_id")


@query("top_n_form", "A14 T3", "game_id team_id " + " ".join(f"{c}:d" for c in _SK[:7]), "skroll", """
SELECT game_id, team_id, {} FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id, team_id ORDER BY rolling_toi_sec DESC, player_id) AS rn FROM skroll
  WHERE rolling_toi_sec IS NOT NULL) x WHERE rn <= 12 GROUP BY game_id, team_id""".format(
    ", ".join(f"avg({c}) AS {c}" for c in _SK[:7])))
def _(v):
    return rolling.top_n_mean(v.skater_log, ["game_id", "team_id"], "rolling_toi_sec", _SK[:7])


@query("player_training_rows", "L10", "game_id player_id scored_point position_code is_home rolling_points:d", "skroll", """
SELECT game_id, player_id, CASE WHEN points > 0 THEN 1 ELSE 0 END AS scored_point, CASE WHEN is_home THEN 1 ELSE 0 END AS is_home,
       CASE upper(substr(position, 1, 1)) WHEN 'C' THEN 0 WHEN 'L' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS position_code, rolling_points
FROM skroll WHERE rolling_points IS NOT NULL""")
def _(v):
    from daybefore.plans.ml import player_rows
    return player_rows(v.skater_log)


__all__ = ["scans"]
