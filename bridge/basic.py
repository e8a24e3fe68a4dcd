"""Scans, projections, set operations and scalar functions."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from bridge.registry import query
from daybefore.functions import events as EV
from daybefore.functions import market as MK
from daybefore.functions import scalars as S
from daybefore.operators import rating
from daybefore.operators.events import attributed, events_of
from daybefore.operators.rolling import sides
from daybefore.plans import columns as C
from daybefore.sources import scans, store

D = datetime.date

# ---- scans -----------------------------------------------------------------------------------

_GAME_COLS = "id season date:t home_team_id away_team_id home_score away_score"


def _completed(name, types):
    inlist = ", ".join(map(str, types))

    @query(name, "S1", _GAME_COLS, "games", f"""
SELECT id, season, date, home_team_id, away_team_id, home_score, away_score FROM games
WHERE game_type IN ({inlist}) AND game_state IN ('OFF', 'final')""")
    def _(v):
        return scans.completed_games(v.games, types, _GAME_COLS.replace(":t", "").split(), final=("OFF", "final"))


_completed("completed_games_regular", (2,))
_completed("completed_games_all", (2, 3))
_completed("completed_games_playoff", (3,))


@query("standings_scan", "S2", "team_id season as_of_date:t games_played goal_for goal_against points l10_points "
       "point_pctg:d", "standings", "SELECT * FROM standings")
def _(v):
    return v.standings.withColumn("as_of_date", S.as_day("as_of_date"))


@query("starter_scan", "S3 J8", "game_id player_id team_id is_home:b saves shots_against date:t", "goalies games", """
SELECT g.game_id, g.player_id, g.team_id, g.is_home, g.saves, g.shots_against, x.date
FROM goalies g LEFT JOIN games x ON x.id = g.game_id AND x.game_type = 2""")
def _(v):
    starts = v.goalies.drop("date", "season")
    return scans.with_game_columns(starts, v.games.where("game_type = 2"))


@query("goalie_value_scan", "S4", "game_id player_id team_id date:t value:d", "gvals", "SELECT * FROM gvals")
def _(v):
    return scans.typed(v.gvals, ["value"])


@query("missing_source_is_empty", "S4", "game_id n", "", """
SELECT o_orderkey AS game_id, 0 AS n FROM orders""")
def _(v):
    none = scans.read_or_empty(v.spark, v.dir + "/no_such_table", "game_id long, value double")
    per = none.groupBy("game_id").agg(F.count("value").alias("n"))
    ids = v.m.select(F.col("match_id").alias("game_id"))
    return ids.join(per, "game_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("team_stats_scan", "S5", "game_id team_id is_home:b date:t pp_pctg:d sog", "tstats games", """
SELECT s.game_id, s.team_id, s.is_home, x.date, s.pp_pctg, s.sog
FROM tstats s LEFT JOIN games x ON x.id = s.game_id AND x.game_type = 2""")
def _(v):
    return scans.with_game_columns(v.tstats.drop("date"), v.games.where("game_type = 2"))


_CLOCK = "CASE WHEN event_id % 37 = 0 THEN 'n/a' WHEN event_id % 41 = 0 THEN NULL ELSE concat(CAST(floor((600 + " \
         "(event_id * 13) % 900) / 60) AS {t}), ':', CAST((600 + (event_id * 13) % 900) % 60 AS {t})) END"


@query("skater_scan_clock", "S6 F1", "player_id stat_id toi_sec:d", "", """
SELECT user_id AS player_id, event_id AS stat_id,
       CASE WHEN event_id % 37 = 0 OR event_id % 41 = 0 THEN 0 ELSE 600 + (event_id * 13) % 900 END AS toi_sec
FROM events""")
def _(v):
    rows = v.table("events").selectExpr("user_id AS player_id", "event_id AS stat_id",
                                        _CLOCK.format(t="BIGINT").replace("AS BIGINT", "AS BIGINT") + " AS toi")
    return scans.parsed_clock(rows)


@query("skater_scan", "S6 F1", "player_id game_id toi_sec:d date:t season", "games", """
SELECT e.user_id AS player_id, e.event_id AS game_id,
       CASE WHEN event_id % 37 = 0 OR event_id % 41 = 0 THEN 0 ELSE 600 + (event_id * 13) % 900 END AS toi_sec, g.date, g.season
FROM events e LEFT JOIN games g ON g.id = e.event_id""")
def _(v):
    rows = v.table("events").selectExpr("user_id AS player_id", "event_id AS game_id", _CLOCK.format(t="BIGINT") + " AS toi")
    return scans.skater_scan(rows, v.games)


@query("shot_events", "S7 J9", "game_id sort_order type_key:s season", "play playgame", """
SELECT p.game_id, p.sort_order, p.type_key, g.season FROM play p JOIN playgame g ON g.game_id = p.game_id
WHERE p.type_key IN ('shot-on-goal', 'goal')""")
def _(v):
    return events_of(v.play, v.playgame, EV.ON_TARGET, cols=("season", "home_team_id", "away_team_id"))


@query("shot_attempts", "S8 J9", "game_id sort_order type_key:s season date:t", "play playgame", """
SELECT p.game_id, p.sort_order, p.type_key, g.season, g.date FROM play p JOIN playgame g ON g.game_id = p.game_id
WHERE p.type_key <> 'faceoff'""")
def _(v):
    return events_of(v.play, v.playgame, EV.ATTEMPTS, cols=("season", "date", "home_team_id", "away_team_id"))


@query("share_scan", "S9 P2", "game_id team_id cf_pct:d cf_pct_5v5:d", "shares",
       "SELECT game_id, team_id, cf_pct, cf_pct_5v5 FROM shares")
def _(v):
    text = v.shares.select("game_id", "team_id", F.col("cf_pct").cast("string").alias("cf_pct"),
                           F.coalesce(F.col("cf_pct_5v5").cast("string"), F.lit("n/a")).alias("cf_pct_5v5"))
    return scans.typed(text, ["cf_pct", "cf_pct_5v5"], [])


@query("games_between_dates", "S11", "id date:t game_type", "games", """
SELECT id, date, game_type FROM games WHERE date BETWEEN DATE '1996-03-01' AND DATE '1999-06-30' AND game_type IN (2, 3)""")
def _(v):
    return scans.games_between(v.games, D(1996, 3, 1), D(1999, 6, 30))


@query("odds_between_dates", "S12", "game_id date:t quote_id home_moneyline", "odds", """
SELECT game_id, date, quote_id, home_moneyline FROM odds WHERE date BETWEEN DATE '1996-03-01' AND DATE '1999-06-30'""")
def _(v):
    return v.odds.where(F.col("date").between(F.lit(D(1996, 3, 1)), F.lit(D(1999, 6, 30))))


@query("scored_features", "S14 J13", "match_id home_score away_score p:d", "pred m", """
SELECT p.match_id, m.home_score, m.away_score, p.p FROM pred p
LEFT JOIN (SELECT match_id, home_score, CASE WHEN match_id % 5 = 0 THEN NULL ELSE away_score END AS away_score FROM m) m
  ON m.match_id = p.match_id
WHERE m.home_score IS NOT NULL AND m.away_score IS NOT NULL""")
def _(v):
    games = v.m.withColumn("away_score", F.when(F.col("match_id") % 5 != 0, F.col("away_score")))
    return scans.with_scores(v.pred, games, on="match_id", id="match_id")


@query("display_lookup", "S15", "match_id nation_id team_name:s person_name:s", "m", """
SELECT m.match_id, m.home_id AS nation_id, coalesce(n.n_name, 'unknown team') AS team_name,
       coalesce(c.c_name, 'unknown') AS person_name
FROM m LEFT JOIN nation n ON n.n_nationkey = m.home_id LEFT JOIN customer c ON c.c_custkey = m.cust_id + 100""")
def _(v):
    rows = v.m.select("match_id", F.col("home_id").alias("nation_id"), (F.col("cust_id") + 100).alias("person"))
    rows = scans.lookup(rows, v.table("nation"), "nation_id", "n_nationkey", {"n_name": "team_name"},
                        {"team_name": "unknown team"})
    return scans.lookup(rows, v.table("customer"), "person", "c_custkey", {"c_name": "person_name"},
                        {"person_name": "unknown"})


@query("source_fallback", "S16", "match_id match_date:t", "m", "SELECT match_id, match_date FROM m WHERE game_type = 3")
def _(v):
    return scans.first_non_empty(
        lambda: scans.read_or_empty(v.spark, v.dir + "/no_such_store", "match_id long, match_date date"),
        lambda: v.m.where("game_type = 3").select("match_id", "match_date"))


@query("normalised_sources", "S17", "game_id player_id saves:d date:t season", "goalies games", """
SELECT g.game_id, g.player_id, g.saves, x.date, x.season FROM goalies g LEFT JOIN games x ON x.id = g.game_id""")
def _(v):
    from daybefore.sources.context import Context
    ctx = Context(v.games, v.standings, v.goalies.drop("date", "season"), v.gvals, v.tstats, v.shares, v.skaters)
    return ctx.normalised().goalies


# ---- projections and predicates --------------------------------------------------------------

@query("contract_projection", "P1", "match_id season p:d elo_diff:d note:s", "pred",
       "SELECT match_id, season, p, CAST(NULL AS DOUBLE) AS elo_diff, CAST(NULL AS VARCHAR) AS note FROM pred")
def _(v):
    return S.contract(v.pred, {"match_id": "long", "season": "long", "p": "double", "elo_diff": "double",
                               "note": "string"})


@query("safe_cast", "P2", "event_id k:d bad:d d:t bad_d:t", "", """
SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS bad,
       CAST(ts AS DATE) AS d, CAST(NULL AS DATE) AS bad_d
FROM events""")
def _(v):
    e = v.table("events")
    return e.select("event_id", S.safe_number(F.regexp_extract("props", "[0-9]+", 0)).alias("k"),
                    S.safe_number(F.col("props")).alias("bad"), S.as_day(F.col("ts").cast("string")).alias("d"),
                    S.as_day("props").alias("bad_d"))


@query("neutral_fill", "P3", "stat_id home_sog:d metric:d", "stat", """
SELECT stat_id, coalesce(num, 30.0) AS home_sog, coalesce(metric, 0.5) AS metric FROM stat""")
def _(v):
    df = v.stat.select("stat_id", F.col("num").cast("double").alias("home_sog"), "metric")
    df = df.withColumn("metric", F.coalesce("metric", F.lit(float("nan"))))
    return S.neutral_fill(df, ["home_sog", "metric"], C.NEUTRAL_FILLS)


@query("truthy_default", "P4", "team_id season as_of_date:t wins:d games_played:d", "snap", """
SELECT team_id, season, as_of_date, CASE WHEN wins IS NULL OR wins = 0 THEN 0.5 ELSE wins END AS wins,
       games_played FROM snap""")
def _(v):
    return v.snap.withColumns({"wins": S.or_default(F.col("wins").cast("double"), 0.5),
                               "games_played": S.or_default("games_played", 0, zero_is_missing=False)})


@query("exclude_seasons", "P7", "match_id season", "pred",
       "SELECT match_id, season FROM pred WHERE coalesce(season NOT IN (1996, 1998), TRUE)")
def _(v):
    return scans.excluding(v.pred, "season", [1996, 1998])


@query("drop_missing", "P8", "sort_order x_coord y_coord", "play",
       "SELECT sort_order, x_coord, y_coord FROM play WHERE x_coord IS NOT NULL AND y_coord IS NOT NULL")
def _(v):
    return v.play.dropna(subset=["x_coord", "y_coord"])


@query("required_fields", "P9", "field:s n_missing", "stat", """
SELECT 'stat_id' AS field, sum(CASE WHEN stat_id IS NULL THEN 1 ELSE 0 END) AS n_missing FROM stat
UNION ALL SELECT 'num', sum(CASE WHEN num IS NULL THEN 1 ELSE 0 END) FROM stat
UNION ALL SELECT 'metric', sum(CASE WHEN metric IS NULL THEN 1 ELSE 0 END) FROM stat""")
def _(v):
    return S.missing_counts(v.stat, ["stat_id", "num", "metric"])


@query("sink_normalised", "P10", "stat_id stat_date:s at_text:s metric:d", "", """
SELECT event_id AS stat_id, strftime(ts, '%Y-%m-%d') AS stat_date,
       CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS at_text,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS metric FROM events""")
def _(v):
    e = v.table("events").select(
        F.col("event_id").alias("stat_id"), F.to_date("ts").alias("stat_date"),
        F.when(F.col("event_id") % 2 == 0, F.to_date("ts").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("at_text"),
        F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("metric"))
    return S.sink_text(e)


@query("holdout_split", "P11", "part:s match_id", "pred", """
SELECT CASE WHEN season = 2000 THEN 'test' ELSE 'train' END AS part, match_id FROM pred""")
def _(v):
    train, test = scans.holdout(v.pred, "season", 2000)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


# ---- order, set operations, keyed merges ------------------------------------------------------

@query("first_n_by_date", "T1", "match_id match_date:t", "m",
       "SELECT match_id, match_date FROM m ORDER BY match_date, match_id LIMIT 100")
def _(v):
    return v.m.orderBy("match_date", "match_id").limit(100)


@query("single_row", "T6", "match_id home_id away_id", "m",
       "SELECT match_id, home_id, away_id FROM m ORDER BY match_date DESC, match_id DESC LIMIT 1")
def _(v):
    return v.m.orderBy(F.desc("match_date"), F.desc("match_id")).limit(1)


@query("sides_union", "U1", "match_id match_date:t team_id opp_id is_home:b gf ga won:d", "tg", """
SELECT match_id, match_date, team_id, opp_id, is_home, gf, ga, CASE WHEN gf > ga THEN 1 ELSE 0 END AS won FROM tg""")
def _(v):
    return sides(v.m)


@query("typed_frames_union", "U2", "match_id game_type series_game_number", "m", """
SELECT match_id, game_type, CAST(NULL AS BIGINT) AS series_game_number FROM m WHERE game_type = 2
UNION ALL SELECT match_id, game_type, 1 FROM m WHERE game_type = 3""")
def _(v):
    a = v.m.where("game_type = 2")
    b = v.m.where("game_type = 3").withColumn("series_game_number", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True)


@query("last_wins_dedupe", "U4", "game_id quote_id home_moneyline", "odds", """
SELECT game_id, quote_id, home_moneyline FROM (
  SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY quote_id DESC) AS rn FROM odds) x WHERE rn = 1""")
def _(v):
    return store.last_wins(v.odds, ["game_id"], ["quote_id"])


def _store_path(v, name):
    import uuid
    from daybefore.session import checkpoint_dir
    return f"{checkpoint_dir(v.spark).rstrip('/')}/store-{uuid.uuid4().hex}/{name}"


@query("upsert_store", "S18 S19 S20 U5", "match_id season p:d", "pred",
       "SELECT match_id, season, CASE WHEN season >= 1999 THEN p + 1 ELSE p END AS p FROM pred")
def _(v):
    path = _store_path(v, "pred")
    first = v.pred.where("season < 2001")
    second = v.pred.where("season >= 1999").withColumn("p", F.col("p") + 1)
    for batch in (first, second, second):  # the rerun must change nothing
        store.upsert(path, batch.select("match_id", "season", "p"), ["match_id"], ["p"], "season")
    return store.read(v.spark, path)


@query("upsert_dry_run", "S21", "n", "pred", "SELECT count(*) AS n FROM pred")
def _(v):
    n = store.upsert(_store_path(v, "never"), v.pred, ["match_id"], ["p"], "season", dry_run=True)
    return v.pred.agg(F.lit(n).alias("n"))


@query("date_range", "U6", "date:t n", "m", """
SELECT CAST(r.d AS DATE) AS date, count(m.match_id) AS n
FROM (SELECT unnest(generate_series((SELECT min(match_date) FROM m), (SELECT max(match_date) FROM m), INTERVAL 1 DAY)) AS d) r
LEFT JOIN m ON m.match_date = CAST(r.d AS DATE) GROUP BY 1""")
def _(v):
    lo, hi = v.m.agg(F.min("match_date"), F.max("match_date")).first()
    per = v.m.groupBy(F.col("match_date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return scans.date_range(v.spark, lo, hi).join(per, "date", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("rows_by_type", "A23", "game_type n", "m", "SELECT game_type, count(*) AS n FROM m GROUP BY game_type")
def _(v):
    return v.m.groupBy("game_type").agg(F.count(F.lit(1)).alias("n"))


# ---- scalar functions -------------------------------------------------------------------------

@query("position_codes", "F2", "event_id code", "", """
SELECT event_id, CASE upper(substr(event_type, 1, 1)) WHEN 'C' THEN 0 WHEN 'L' THEN 1 WHEN 'R' THEN 2 WHEN 'D' THEN 3
       ELSE 3 END AS code FROM events""")
def _(v):
    return v.table("events").select("event_id", S.position_code("event_type").alias("code"))


@query("shot_kind_codes", "F3", "sort_order code", "play", """
SELECT sort_order, CASE lower(shot_type) WHEN 'wrist' THEN 0 WHEN 'slap' THEN 1 WHEN 'snap' THEN 2 WHEN 'backhand' THEN 3
  WHEN 'tip-in' THEN 4 WHEN 'deflection' THEN 5 WHEN 'bat' THEN 6 WHEN 'between-legs' THEN 7 WHEN 'poke' THEN 8
  WHEN 'wrap-around' THEN 9 ELSE 10 END AS code FROM play""")
def _(v):
    return v.play.select("sort_order", EV.shot_kind_code("shot_type").alias("code"))


_DIGITS = """
SELECT *, coalesce(TRY_CAST(substr(sc, 1, 1) AS INT), 1) AS ag, coalesce(TRY_CAST(substr(sc, 2, 1) AS INT), 5) AS sa,
       coalesce(TRY_CAST(substr(sc, 3, 1) AS INT), 5) AS sh, coalesce(TRY_CAST(substr(sc, 4, 1) AS INT), 1) AS hg
FROM (SELECT *, coalesce(situation_code, '1551') AS sc FROM play) p0"""
_MANPOWER = f"""
SELECT *, CASE WHEN og = 0 THEN 1 ELSE 0 END AS is_en, CASE WHEN mine > theirs AND og = 1 THEN 1 ELSE 0 END AS is_pp,
       CASE WHEN mine < theirs AND og = 1 THEN 1 ELSE 0 END AS is_sh
FROM (SELECT *, CASE WHEN owner_team_id = home_team_id THEN sh ELSE sa END AS mine,
             CASE WHEN owner_team_id = home_team_id THEN sa ELSE sh END AS theirs,
             CASE WHEN owner_team_id = home_team_id THEN ag ELSE hg END AS og FROM ({_DIGITS}) p1) p2"""


@query("manpower_flags", "F4", "sort_order is_pp is_sh is_en", "play", _MANPOWER)
def _(v):
    return v.play.withColumns(EV.manpower(F.col("situation_code"), F.col("owner_team_id"), F.col("home_team_id")))


_GEOMETRY = """
SELECT *, sqrt((gx - x) * (gx - x) + y * y) AS shot_distance,
       degrees(atan2(abs(y), greatest(abs(gx - x), CAST(0.01 AS DOUBLE)))) AS shot_angle,
       CASE WHEN abs(x) > 89 THEN 1 ELSE 0 END AS is_behind_net
FROM (SELECT *, CAST(coalesce(x_coord, 0) AS DOUBLE) AS x, CAST(coalesce(y_coord, 0) AS DOUBLE) AS y,
             CASE WHEN coalesce(x_coord, 0) >= 0 THEN CAST(89 AS DOUBLE) ELSE CAST(-89 AS DOUBLE) END AS gx FROM play) g"""


@query("shot_geometry", "F5", "sort_order shot_distance:d shot_angle:d is_behind_net", "play", _GEOMETRY)
def _(v):
    x, y = F.col("x_coord"), F.col("y_coord")
    return v.play.select("sort_order", EV.distance(x, y).alias("shot_distance"), EV.angle(x, y).alias("shot_angle"),
                         EV.behind_net(x).alias("is_behind_net"))


@query("danger_and_attacker", "F6 F7", "sort_order attack_team_id is_unblocked hd", "play", """
SELECT sort_order, CASE WHEN type_key = 'blocked-shot' THEN CASE WHEN owner_team_id = home_team_id THEN away_team_id
         ELSE home_team_id END ELSE owner_team_id END AS attack_team_id,
       CASE WHEN type_key IN ('goal', 'shot-on-goal', 'missed-shot') THEN 1 ELSE 0 END AS is_unblocked,
       CASE WHEN type_key IN ('goal', 'shot-on-goal', 'missed-shot') AND 89 - abs(coalesce(x_coord, 0)) BETWEEN 0 AND 20
            AND abs(coalesce(y_coord, 0)) <= 22 THEN 1 ELSE 0 END AS hd
FROM play WHERE type_key <> 'faceoff'""")
def _(v):
    return attributed(v.play.where(F.col("type_key").isin(*EV.ATTEMPTS)))


@query("period_and_goal", "F8", "sort_order period is_goal", "play", """
SELECT sort_order, least(coalesce(period, 1), 4) AS period, CASE WHEN type_key = 'goal' THEN 1 ELSE 0 END AS is_goal
FROM play""")
def _(v):
    return v.play.select("sort_order", EV.period_capped(F.col("period")).alias("period"),
                         (F.col("type_key") == "goal").cast("int").alias("is_goal"))


@query("season_labels", "F9", "o_orderkey season previous bracket", "", """
SELECT o_orderkey, y * 10001 + 1 AS season, (y - 1) * 10001 + 1 AS previous, y + 1 AS bracket
FROM (SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS y
      FROM orders) s""")
def _(v):
    o = v.table("orders").select("o_orderkey", S.season_of(F.to_date("o_orderdate")).alias("season"))
    return o.withColumns({"previous": S.previous_season("season"), "bracket": S.bracket_year("season")})


@query("rating_expectation", "F10", "match_id e:d", "m", """
SELECT match_id, 1 / (1 + pow(CAST(10 AS DOUBLE), ((1500 + away_score * 10) - (1500 + home_score * 10) - 50) / CAST(400 AS DOUBLE))) AS e FROM m""")
def _(v):
    m = v.m.withColumns({"h": F.col("home_score") * 10 + 1500, "a": F.col("away_score") * 10 + 1500})
    return m.select("match_id", rating.expected_home("h", "a").alias("e"))


_IMPLIED = """
SELECT *, CASE WHEN home_moneyline > 0 THEN 100.0 / (home_moneyline + 100.0)
               WHEN home_moneyline < 0 THEN -home_moneyline / (-home_moneyline + 100.0) END AS ih,
       CASE WHEN away_moneyline > 0 THEN 100.0 / (away_moneyline + 100.0)
            WHEN away_moneyline < 0 THEN -away_moneyline / (-away_moneyline + 100.0) END AS ia
FROM (SELECT game_id, date, snapshot_type, quote_id, CAST(home_moneyline AS DOUBLE) AS home_moneyline,
             CAST(away_moneyline AS DOUBLE) AS away_moneyline FROM odds) o0"""


@query("implied_probability", "F11", "quote_id ih:d ia:d", "odds", f"SELECT quote_id, ih, ia FROM ({_IMPLIED}) q")
def _(v):
    return v.odds.select("quote_id", MK.implied(F.col("home_moneyline")).alias("ih"),
                         MK.implied(F.col("away_moneyline")).alias("ia"))


_DEVIG = f"""
SELECT *, CASE WHEN ih IS NULL OR ia IS NULL THEN ih ELSE ih / (ih + ia) END AS home_prob,
       CASE WHEN ih IS NULL OR ia IS NULL THEN ia ELSE ia / (ih + ia) END AS away_prob FROM ({_IMPLIED}) q"""


@query("devigged_pair", "F12", "quote_id home_prob:d away_prob:d", "odds", f"SELECT * FROM ({_DEVIG}) d")
def _(v):
    none = F.lit(None).cast("double")
    h, a = MK.quote_pair(none, none, F.col("home_moneyline"), F.col("away_moneyline"))
    return v.odds.select("quote_id", h.alias("home_prob"), a.alias("away_prob"))


@query("row_scores", "F13 F14", "match_id log_loss:d brier:d log_edge:d", "pred", """
SELECT match_id, CASE WHEN y = 1 THEN -ln(greatest(least(p, 1 - 1e-9), 1e-9)) ELSE -ln(1 - greatest(least(p, 1 - 1e-9), 1e-9)) END AS log_loss,
       (p - y) * (p - y) AS brier, ln(p / (1 - p / 2)) AS log_edge FROM pred""")
def _(v):
    p, y = F.col("p"), F.col("y")
    return v.pred.select("match_id", MK.row_log_loss(p, y).alias("log_loss"), MK.row_brier(p, y).alias("brier"),
                         MK.log_edge(p, 1 - p / 2).alias("log_edge"))


@query("record_text", "F20", "team_id season as_of_date:t record:s", "standings", """
SELECT team_id, season, as_of_date, concat(CAST(wins AS BIGINT), '-', CAST(losses AS BIGINT), '-', CAST(ot_losses AS BIGINT)) AS record
FROM standings""")
def _(v):
    return v.standings.withColumn("record", S.record_text("wins", "losses", "ot_losses"))


@query("run_ids", "F21", "match_id run_id:s", "pred", """
SELECT match_id, concat(strftime(match_date, '%Y-%m-%d'), '|v2.3|goals|goals_model|lambda3=0.1') AS run_id FROM pred""")
def _(v):
    return v.pred.select("match_id", S.run_id("match_date", F.lit("v2.3"),
                                              F.lit("goals|goals_model|lambda3=0.1")).alias("run_id"))


@query("json_snapshot", "F22", "match_id snapshot:s", "pred", """
SELECT match_id, concat('{"match_id":', match_id, ',"match_date":"', strftime(match_date, '%Y-%m-%d'), '","goalie":null,"y":', y, '}') AS snapshot
FROM pred""")
def _(v):
    body = F.struct("match_id", F.date_format("match_date", "yyyy-MM-dd").alias("match_date"),
                    F.lit(None).cast("long").alias("goalie"), "y")
    return v.pred.select("match_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("snapshot"))


@query("final_and_outcome", "F23", "match_id final:b outcome", "m", """
SELECT match_id, upper(game_state) IN ('OFF', 'FINAL') AS final,
       CASE WHEN upper(game_state) IN ('OFF', 'FINAL') THEN CASE WHEN home_score > away_score THEN 1 ELSE 0 END END AS outcome
FROM m""")
def _(v):
    f = S.is_final("game_state")
    return v.m.select("match_id", f.alias("final"), S.outcome(f, "home_score", "away_score").alias("outcome"))
