"""Composite jobs: features, store, snapshots, serving, evaluation and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from bridge.basic import _store_path
from bridge.evaluated import BENCH, BENCH_SQL, DAILY, DAILY_SQL
from bridge.feature_sql import feature_columns, features_sql, side_sql
from bridge.registry import query
from bridge.timed import _mean
from bridge.views import SQL
from daybefore.operators import market
from daybefore.operators.rolling import rolling_mean_prior, sides
from daybefore.plans import backtest, materialize, ml, serve
from daybefore.plans.columns import (DAILY_KEYS, EVENT_FEATURES, FEATURES, GOALIE_STRENGTHS, LEAN, LINEUP, PLAYER_FEATURES, SERIES,
                                     SERVING_KEYS, SHARES, STORE_CONTRACT, TEAM_STRENGTHS)
from daybefore.plans.features import attach_series, build_features, game_spine
from daybefore.session import scratch, settled
from daybefore.sources import scans, store

# ---- flagship ---------------------------------------------------------------------------------

SQL["tgform"] = ("tg", """
SELECT match_id, team_id, first_value(r) OVER (PARTITION BY team_id, match_date ORDER BY match_id) AS r FROM (
  SELECT match_id, team_id, match_date, {} FROM tg
  WINDOW w AS (PARTITION BY team_id ORDER BY match_date, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) x""".format(_mean("gf", "r")))


@query("form_difference", "W2 U1 J7 P5", "match_id home_form:d away_form:d diff_form:d", "m tgform", """
SELECT m.match_id, h.r AS home_form, a.r AS away_form, h.r - a.r AS diff_form FROM m
JOIN tgform h ON h.match_id = m.match_id AND h.team_id = m.home_id JOIN tgform a ON a.match_id = m.match_id AND a.team_id = m.away_id""")
def _(v):
    form = rolling_mean_prior(sides(v.m), "team_id", "match_date", "match_id", ["gf"])
    both = form.groupBy("match_id").agg(F.max(F.when(F.col("is_home"), F.col("rolling_gf"))).alias("home_form"),
                                        F.max(F.when(~F.col("is_home"), F.col("rolling_gf"))).alias("away_form"))
    return both.withColumn("diff_form", F.col("home_form") - F.col("away_form"))


# ---- features ---------------------------------------------------------------------------------

_META = "game_id season date:t home_team_id away_team_id"
_FEAT = " ".join(f"{c}:d" for c in feature_columns())
_PAIRS = """
SELECT id AS sid, id AS game_id, season, date, game_type, home_team_id, away_team_id, CAST(NULL AS BIGINT) AS home_asked,
       CAST(NULL AS BIGINT) AS away_asked, CASE WHEN home_score > away_score THEN 1 ELSE 0 END AS target FROM games WHERE game_type = {t}"""
features_sql("r", _PAIRS.format(t=2), "games", "actual", "pairday2")
features_sql("y", _PAIRS.format(t=3), "games", "actual", "pairday")


@query("features_batch", "M1 P5 P6 J7", f"{_META} target {_FEAT}", "rfeat", "SELECT * FROM rfeat")
def _(v):
    return build_features(v.context, game_type=2)


@query("features_playoff", "M1 M3", f"{_META} target {_FEAT} {' '.join(SERIES)}", "yfeat games series seats pstate", """
SELECT f.*, p.series_game_number, p.home_series_wins, p.away_series_wins, h.seed - a.seed AS seed_diff
FROM yfeat f JOIN series s ON s.bracket_year = f.season % 10000 AND s.top_seed_team_id = least(f.home_team_id, f.away_team_id)
  AND s.bottom_seed_team_id = greatest(f.home_team_id, f.away_team_id) AND s.round_number <> 0
LEFT JOIN pstate p ON p.id = f.game_id
LEFT JOIN seats h ON h.bracket_year = f.season % 10000 AND h.team_id = f.home_team_id
LEFT JOIN seats a ON a.bracket_year = f.season % 10000 AND a.team_id = f.away_team_id""")
def _(v):
    return attach_series(build_features(v.context, game_type=3), v.games, v.series)


# requests: every customer asks for one pairing on a date of its own, some with overrides
features_sql("q", """
SELECT c_custkey AS sid, CAST(NULL AS BIGINT) AS game_id, (CASE WHEN month(d) >= 10 THEN year(d) ELSE year(d) - 1 END) * 10001 + 1 AS season,
       d AS date, CAST(NULL AS INT) AS game_type, h AS home_team_id, (h + 1 + c_custkey % 31) % 32 AS away_team_id,
       CASE WHEN c_custkey % 3 = 0 THEN h * 3 + c_custkey % 4 END AS home_asked, CAST(NULL AS BIGINT) AS away_asked, CAST(NULL AS INT) AS target
FROM (SELECT c_custkey, c_nationkey AS h, DATE '1995-02-01' + CAST(c_custkey * 7 % 2300 AS INT) AS d FROM customer) c""", "", "latest", "pairday")


def requests(v):
    c = v.table("customer")
    h = F.col("c_nationkey").cast("long")
    return c.select(
        F.col("c_custkey").alias("spine_id"), h.alias("home_team_id"), ((h + 1 + F.col("c_custkey") % 31) % 32).alias("away_team_id"),
        F.date_add(F.lit("1995-02-01").cast("date"), (F.col("c_custkey") * 7 % 2300).cast("int")).alias("date"),
        F.when(F.col("c_custkey") % 3 == 0, h * 3 + F.col("c_custkey") % 4).alias("home_goalie_id"))


@query("features_on_request", "M2 J5 W6", f"{_META} {_FEAT}", "qfeat", "SELECT * FROM qfeat")
def _(v):
    return build_features(v.context, requests(v))


# ---- store and snapshots ----------------------------------------------------------------------

_STORE = " ".join(f"{c}:{ {'double': 'd', 'string': 's', 'date': 't'}.get(t, 'l')}" for c, t in STORE_CONTRACT.items())
SQL["stored"] = ("rfeat yfeat series seats pstate", """
SELECT *, 'v2.0' AS feature_version FROM (
  SELECT *, CAST(NULL AS BIGINT) AS series_game_number, CAST(NULL AS BIGINT) AS home_series_wins,
         CAST(NULL AS BIGINT) AS away_series_wins, CAST(NULL AS BIGINT) AS seed_diff FROM rfeat
  UNION ALL
  SELECT f.*, p.series_game_number, p.home_series_wins, p.away_series_wins, h.seed - a.seed AS seed_diff
  FROM yfeat f JOIN series s ON s.bracket_year = f.season % 10000 AND s.top_seed_team_id = least(f.home_team_id, f.away_team_id)
    AND s.bottom_seed_team_id = greatest(f.home_team_id, f.away_team_id) AND s.round_number <> 0
  LEFT JOIN pstate p ON p.id = f.game_id
  LEFT JOIN seats h ON h.bracket_year = f.season % 10000 AND h.team_id = f.home_team_id
  LEFT JOIN seats a ON a.bracket_year = f.season % 10000 AND a.team_id = f.away_team_id) u""")


@query("feature_store", "M5 S10 S19 P1 T1 A23", _STORE, "stored", "SELECT * FROM stored")
def _(v):
    path = _store_path(v, "features")
    materialize.materialize(v.context, v.series, path)
    return materialize.stored_features(v.spark, path)


side_sql("z", """
SELECT * EXCLUDE (rn) FROM (
  SELECT game_id AS sid, season, date, team_id, is_home, CAST(NULL AS BIGINT) AS game_id, CAST(NULL AS BIGINT) AS asked,
         row_number() OVER (PARTITION BY team_id, date ORDER BY game_id DESC, is_home) AS rn FROM gtg) x WHERE rn = 1""", "gtg", "latest", False)
_TEAMFORM = ["point_pctg", "win_pctg", "l10_points", *SHARES, *TEAM_STRENGTHS, *LINEUP, "elo"]


@query("team_form_snapshots", "M6", "team_id as_of_date:t season reg_win_pctg:d goal_diff:d pp_pctg:d faceoff_pctg:d sog:d "
       + " ".join(f"{c}:d" for c in _TEAMFORM), "zside", f"""
SELECT team_id, date AS as_of_date, season, regulation_win_pctg AS reg_win_pctg, goal_differential AS goal_diff,
       rolling_pp_pctg AS pp_pctg, rolling_faceoff_winning_pctg AS faceoff_pctg, rolling_sog AS sog, {', '.join(_TEAMFORM)} FROM zside""")
def _(v):
    return materialize.form_snapshots(materialize.form_sides(v.context, game_spine(v.context.games, None)))[0]


@query("goalie_form_snapshots", "M6", "player_id as_of_date:t goalie_sv_pctg:d goalie_gsax:d goalie_talent_strength:d "
       "goalie_workload:d goalie_fatigue:d", "zside", """
SELECT DISTINCT player_id, date AS as_of_date, goalie_sv AS goalie_sv_pctg, goalie_gsax, goalie_talent_strength, goalie_workload, goalie_fatigue
FROM zside WHERE player_id IS NOT NULL""")
def _(v):
    return materialize.form_snapshots(materialize.form_sides(v.context, game_spine(v.context.games, None)))[1]


@query("latest_form", "J2 T6", "id as_of_date:t goal_for", "games standings", """
SELECT g.id, s.as_of_date, s.goal_for FROM games g
ASOF LEFT JOIN standings s ON s.team_id = g.home_team_id AND g.date >= s.as_of_date""")
def _(v):
    req = v.games.select("id", "date", F.col("home_team_id").alias("team_id"))
    return materialize.latest_form(req, v.standings, "team_id")


# ---- serving ----------------------------------------------------------------------------------

_RATED = """
SELECT id AS game_id, date, season, home_team_id, away_team_id, upper(game_state) IN ('OFF', 'FINAL') AS is_finalized,
       concat(strftime(date, '%Y-%m-%d'), '|v2.3|goals') AS run_id, d.p_final_home AS home_win_probability,
       d.expected_home AS expected_home_goals, d.p_tie AS regulation_tie_probability,
       CASE WHEN upper(game_state) IN ('OFF', 'FINAL') THEN CASE WHEN home_score > away_score THEN 1 ELSE 0 END END AS home_win_outcome
FROM games g JOIN dist d ON d.match_id = g.id"""


@query("serving_rows", "M7 M8 F21 F23 U6", "game_id date:t season home_team_id away_team_id is_finalized:b run_id:s "
       "home_win_probability:d expected_home_goals:d regulation_tie_probability:d home_win_outcome", "games dist", _RATED)
def _(v):
    from bridge.evaluated import _dist
    rated = _dist(v).withColumnRenamed("match_id", "game_id")
    return serve.serving_rows(v.games, rated, "v2.3", "goals", "2026-01-01T00:00:00")


_RECORDS = ("game_id game_date:s home_win_prob:d away_win_prob:d predicted_winner_team_id "
            "model_versions:s input_snapshot:s status:s")
_RECORDS_SQL = """
SELECT id AS game_id, strftime(date, '%Y-%m-%d') AS game_date, p AS home_win_prob, 1 - p AS away_win_prob,
       CASE WHEN p > 0.5 THEN home_team_id ELSE away_team_id END AS predicted_winner_team_id,
       '{"win_model":"win","score_model":"debug_fallback","decision_threshold":0.5}' AS model_versions,
       concat('{"game_id":', id, ',"game_date":"', strftime(date, '%Y-%m-%d'), '","game_type":', game_type, ',"home_team_id":', home_team_id,
              ',"away_team_id":', away_team_id, ',"home_goalie_id":null,"away_goalie_id":null}') AS input_snapshot, 'ok' AS status
FROM games g JOIN pred p ON p.match_id = g.id"""


def _predicted(v):
    p = v.games.join(v.pred.select(F.col("match_id").alias("id"), F.col("p").alias("home_prob")), "id")
    return p.select(F.col("id").alias("game_id"), "date", "game_type", "home_team_id", "away_team_id", "home_prob",
                 (1 - F.col("home_prob")).alias("away_prob"), F.lit(3.0).alias("home_gf"), F.lit(2.5).alias("away_gf"),
                 F.when(F.col("home_prob") > 0.5, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("winner_team_id"),
                 F.lit(0.5).alias("threshold"), F.lit("win").alias("model_name"), F.lit("debug_fallback").alias("score_model_name"))


@query("prediction_records", "M15 F22 P9", _RECORDS, "games pred", _RECORDS_SQL)
def _(v):
    return serve.prediction_records(_predicted(v))


@query("written_predictions", "S20 S21 M15", _RECORDS, "games pred", _RECORDS_SQL)
def _(v):
    """Half of the records first, then all of them over wrong ones, twice, and a dry run that writes nothing."""
    path, rows = _store_path(v, "records"), _predicted(v)
    serve.write_predictions(rows.where("game_id % 2 = 0").withColumn("home_prob", F.lit(0.25)), path)
    for _ in range(2):
        n = serve.write_predictions(rows, path)
    serve.write_predictions(rows.withColumn("home_prob", F.lit(0.75)), path, dry_run=True)
    return store.read(v.spark, path).where(F.lit(n) == rows.count())


def _committed(v):
    """Predictions, benchmarks and daily rows in one store: a wrong commit, a dead one, then the right one twice."""
    path = _store_path(v, "serving")
    bench = _cut(market.market_benchmark(v.served, market.normalize_odds(v.odds, "quote_id")))

    def writes(rows):
        tables = {"predictions": (v.served, SERVING_KEYS, "prediction_date"), "benchmarks": (rows, [k for k in SERVING_KEYS if k in rows.columns], "date"),
                  "benchmarks_daily": (market.market_benchmark_daily(rows), DAILY_KEYS, "date")}
        return {name: store.Write(df.withColumn("year", F.year(day)), keys, [day], "year") for name, (df, keys, day) in tables.items()}
    store.commit(v.spark, path, writes(bench.withColumn("brier", F.col("brier") + 1)))
    failing = writes(bench.withColumn("brier", F.raise_error(F.lit("the run dies")).cast("double")))
    try:
        store.commit(v.spark, path, failing)
        raise AssertionError("the run should have died")
    except Exception as exc:
        if "the run dies" not in str(exc):
            raise
    for _ in range(2):
        store.commit(v.spark, path, writes(bench))
    return path


@query("committed_benchmarks", "S20 S18 M8", BENCH, "bench", BENCH_SQL)
def _(v):
    return store.read(v.spark, _committed(v), "benchmarks")


@query("committed_daily", "S20 S18 M8", DAILY, "bench", DAILY_SQL)
def _(v):
    return store.read(v.spark, _committed(v), "benchmarks_daily")


# ---- training and evaluation (no SQL form) ----------------------------------------------------
# Comparison, matchups, players and scores fit all trees of the library's defaults; the other fits few, so their checks stay quick.

TREES = 5


def _feature_rows(v):
    """Light regular-season rows for the fits: rolling form, shares and rating differences."""
    from daybefore.operators.rating import elo
    form = rolling_mean_prior(sides(v.m), "team_id", "match_date", "match_id", ["gf", "ga"])
    both = form.groupBy("match_id").agg(*[
        F.max(F.when(F.col("is_home") == h, F.col(f"rolling_{c}"))).alias(f"{n}_{c}")
        for n, h in (("home", True), ("away", False)) for c in ("gf", "ga")])
    m = elo(v.m).join(both, "match_id")
    return m.select(F.col("match_id").alias("game_id"), F.col("match_date").alias("date"), "season", "game_type", "home_score",
                    "away_score", F.col("home_id").alias("home_team_id"), F.col("away_id").alias("away_team_id"),
                    (F.col("home_score") > F.col("away_score")).cast("int").alias("target"), "elo_diff", "home_elo", "away_elo",
                    "home_gf", "home_ga", "away_gf", "away_ga",
                    F.col("home_gf").alias("home_goals_for_per_game"), F.col("away_gf").alias("away_goals_for_per_game"))


COLS = ["elo_diff", "home_gf", "home_ga", "away_gf", "away_ga"]
_METRICS = "n_games accuracy:d log_loss:d brier:d roc_auc:d mean_predicted_prob:d actual_home_rate:d"


def _cut(df):
    from daybefore.session import cut_lineage
    return cut_lineage(df)


@query("scaled_inputs", "L1", "game_id f0:d f1:d")
def _(v):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    rows = ml.prepare(_cut(_feature_rows(v)), COLS)  # the scaler reads them twice
    out = Pipeline(stages=ml.inputs(COLS, True)).fit(rows).transform(rows)
    a = vector_to_array("features")
    return out.select("game_id", a[0].alias("f0"), a[1].alias("f1"))


@query("model_comparison", "L2 L5", "feature_set:s model:s " + _METRICS)
def _(v):
    train, test = scans.holdout(_cut(_feature_rows(v)), "season", 2000)
    return ml.compare(train, test, "target", ml.win_recipes(), {"rates": COLS, "rating": ["elo_diff"]})


@query("win_training", "L3 L6 S22", "part:s " + _METRICS)
def _(v):
    rows = _cut(_feature_rows(v))
    payload, report = ml.train_win(rows, 2000, features=COLS)
    path = _store_path(v, "win_model")
    payload.save(v.spark, path)
    again = ml.load_payload(v.spark, path)
    _, test = scans.holdout(ml.prepare(rows, COLS), "season", 2000)
    loaded = ml.probability_metrics(ml.score(again.model, test), "p", "target")
    return report.withColumn("part", F.lit("trained")).unionByName(loaded.withColumn("part", F.lit("loaded")))


@query("feature_importance", "T4", "feature:s importance:d")
def _(v):
    train, _ = scans.holdout(ml.prepare(_cut(_feature_rows(v)), COLS), "season", 2000)
    model = ml.fit_classifier(train, ml.win_recipes(TREES)["gradient_boosting"], COLS, "target")
    return ml.importances(model, COLS, 3)


@query("playoff_training", "L4 L7 A18", "threshold:d " + _METRICS)
def _(v):
    rows = _cut(_feature_rows(v).where("game_type = 3"))
    payload, report = ml.train_playoff(rows, 2000, features=COLS, recipe=ml.playoff_recipe(2), folds=2)
    return report.withColumn("threshold", F.lit(payload.threshold))


def _events(v):
    from daybefore.functions.events import ON_TARGET
    from daybefore.operators.events import event_features, events_of
    shots = events_of(v.play, v.playgame, ON_TARGET, cols=("season", "home_team_id", "away_team_id"))
    return event_features(shots)


@query("event_model_training", "L8 L14", "model:s " + _METRICS)
def _(v):
    return ml.train_events(_cut(_events(v)), 20, recipes=ml.pair_recipes(TREES))[1]


@query("event_scoring", "L14 M17", "game_id team_id cf xgf:d xgf_pct:d")
def _(v):
    from daybefore.functions.events import ATTEMPTS
    from daybefore.operators.events import event_shares, events_of
    feats = _cut(_events(v))
    payload, _ = ml.train_events(feats, 20, recipes={"logistic": ml.pair_recipes()["logistic"]})
    att = events_of(v.play, v.playgame, ATTEMPTS, cols=("season", "date", "home_team_id", "away_team_id"))
    return event_shares(att, ml.score_events(feats, payload))


@query("player_training", "L9 A22", "model:s macro_f1:d")
def _(v):
    rows = ml.player_rows(v.skater_log)
    return ml.train_players(_cut(rows), 19992000, recipes=ml.pair_recipes())[1]


@query("score_regression", "L11 A21", "side:s mae:d baseline_mae:d")
def _(v):
    train, test = scans.holdout(ml.prepare(_cut(_feature_rows(v)), COLS), "season", 2000)
    return ml.score_report(ml.fit_scores(train, COLS), train, test)


@query("goals_model", "L12 L13", "game_id lambda_home:d lambda_away:d lambda3:d p_final_home:d")
def _(v):
    train, test = scans.holdout(ml.prepare(_cut(_feature_rows(v)), COLS), "season", 2000)
    return ml.fit_goals(train, COLS).distribution(test)


@query("matchup_prediction", "L15", "game_id game_type home_prob:d home_gf:d winner_team_id model_name:s score_model_name:s")
def _(v):
    rows = _cut(_feature_rows(v))
    train, test = scans.holdout(rows, "season", 2000)
    tr = ml.prepare(train, COLS)
    win = ml.Payload(ml.fit_classifier(tr, ml.win_recipes()["logistic"], COLS, "target"), COLS, "win")
    post = ml.Payload(ml.fit_classifier(tr.where("game_type = 3"), ml.playoff_recipe(), COLS, "target"), COLS, "playoff", 0.55)
    scored = ml.Payload(ml.fit_scores(tr, COLS), COLS, "score_model")
    return serve.predict(test, win, post, scored, None)


@query("walk_forward", "M11", "season " + _METRICS)
def _(v):
    scored = backtest.backtest(_feature_rows(v), features=COLS, calibrate=False, min_train=3)
    return backtest.fold_metrics(scored, "p", "target")[0]


@query("goals_walk_forward", "M12", "season n_test goals_accuracy:d goals_log_loss:d win_accuracy:d win_log_loss:d goals_rps:d "
       "goals_exact_score_accuracy:d")
def _(v):
    return backtest.goals_backtest(_feature_rows(v), features=COLS, calibrate=False, min_train=4)


@query("date_range_scoring", "M7 M8 S20", "date:t feature_version:s n_games n_with_closing_odds model_brier:d")
def _(v):
    cols = ["elo_diff", "home_sog", "away_sog", "diff_goal_diff"]
    ctx = v.context
    last = v.games.agg(F.max("season")).first()[0]  # the last season is scored by a model of those before it
    lo, hi = v.games.where(F.col("season") == last).agg(F.min("date"), F.max("date")).first()
    with scratch():  # the rows of the fit go before the season is scored
        feats = settled(lambda: scans.with_scores(build_features(ctx, game_type=2), ctx.games).where(F.col("date") < F.lit(lo)))
        payload = ml.Payload(ml.fit_goals(ml.prepare(feats, cols), cols), cols, "goals")
    done = serve.score_dates(ctx, lo, hi, payload, v.odds, path=_store_path(v, "serving"))
    return done.daily


@query("series_evaluation", "M13 M14", "series_id season team_a_id team_b_id team_a_won n_games p_goals:d")
def _(v):
    # eight clubs instead of thirty-two, so that pairs meet often enough to finish a series
    eight = v.m.withColumns({"home_id": F.col("home_id") % 8, "away_id": (F.col("home_id") % 8 + 1 + F.col("away_id") % 7) % 8})
    from bridge.views import Views
    small = Views(v.spark, v.dir)
    small.__dict__["m"] = eight
    ctx = small.context
    regular = scans.with_scores(build_features(ctx, game_type=2), ctx.games)
    return backtest.series_backtest(ctx, small.series, regular, features=["elo_diff", "home_sog", "away_sog", "diff_goal_diff"])


__all__ = ["EVENT_FEATURES", "FEATURES", "GOALIE_STRENGTHS", "LEAN", "PLAYER_FEATURES"]
