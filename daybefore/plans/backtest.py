"""Walk-forward evaluation: each season is scored by a model of all earlier ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybefore.functions.scores import score_quality, series_probability
from daybefore.operators.metrics import fold_summary, probability_metrics
from daybefore.operators.pairs import completed_series, seat_seeds
from daybefore.plans.columns import FEATURES
from daybefore.plans.features import SPINE, build_features
from daybefore.plans.ml import (Payload, Recipe, fit_calibrated, fit_classifier, fit_goals, prepare, score,
                                win_recipes)
from daybefore.session import cut_lineage
from daybefore.sources.context import Context
from daybefore.sources.scans import PLAYOFF, excluding


def fold_sizes(df: DataFrame, season: str = "season", min_train: int = 2, exclude: Sequence = ()) -> DataFrame:
    """The folds of a walk-forward run: test season, training and test row counts.

    Seasons are few, so ordering their counts is a small job whatever the row count.
    """
    from pyspark.sql import Window
    counts = excluding(df, season, exclude).groupBy(season).agg(F.count(F.lit(1)).alias("n_test"))
    w = Window.orderBy(season)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    out = counts.select(season, F.sum("n_test").over(earlier).alias("n_train"), "n_test",
                        F.row_number().over(w).alias("_i"))
    return out.where(F.col("_i") > min_train).select(season, F.coalesce("n_train", F.lit(0)).alias("n_train"), "n_test")


def walk_forward(df: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], season: str = "season",
                 min_train: int = 2, exclude: Sequence = ()) -> DataFrame:
    """Rows of every tested season with the columns ``fit(train)(test)`` adds.

    The input is cut to a checkpoint once; each fold then filters it.
    """
    rows = cut_lineage(excluding(df, season, exclude))
    seasons = [r[0] for r in rows.select(season).distinct().orderBy(season).collect()]
    out = None
    for i, s in enumerate(seasons):
        if i < min_train:
            continue
        scorer = fit(rows.where(F.col(season).isin(*seasons[:i]) if i else F.lit(False)))
        part = scorer(rows.where(F.col(season) == s))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold has enough training seasons")
    return out


def fold_metrics(scored: DataFrame, p: str, y: str, season: str = "season") -> tuple[DataFrame, DataFrame]:
    """Per-fold metrics, and the pooled metrics next to the mean over folds."""
    per = probability_metrics(scored, p, y, [season])
    pooled = probability_metrics(scored, p, y)
    means = fold_summary(per, ["accuracy", "log_loss", "brier", "roc_auc"])
    both = pooled.withColumn("_k", F.lit(0)).join(means.withColumn("_k", F.lit(0)), "_k").drop("_k")
    return per, both


def backtest(df: DataFrame, recipe: Recipe | None = None, features: Sequence[str] = FEATURES, label: str = "target",
             id: str = "game_id", season: str = "season", calibrate: bool = True, min_train: int = 2,
             exclude: Sequence = (), folds: int = 5) -> DataFrame:
    """Out-of-sample ``p`` for every tested row."""
    recipe = recipe or win_recipes()["logistic"]

    def fit(train):
        model = (fit_calibrated(train, recipe, features, label, id, "isotonic", folds) if calibrate
                 else fit_classifier(train, recipe, features, label))
        return lambda test: score(model, test)
    return walk_forward(prepare(df, features), fit, season, min_train, exclude)


def goals_backtest(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "target", id: str = "game_id",
                   season: str = "season", calibrate: bool = True, min_train: int = 2, exclude: Sequence = (),
                   max_goals: int = 10, folds: int = 5) -> DataFrame:
    """Per fold: goals model and win model on the same rows, ranked probability score and exact hits."""
    recipe = win_recipes()["logistic"]

    def fit(train):
        goals = fit_goals(train, features, scale=False)
        win = (fit_calibrated(train, recipe, features, label, id, "isotonic", folds) if calibrate
               else fit_classifier(train, recipe, features, label))

        def scorer(test):
            d = score_quality(goals.distribution(test, max_goals), "home_score", "away_score", max_goals)
            return score(win, d.drop("grid"), "p_win")
        return scorer
    scored = walk_forward(prepare(df, features), fit, season, min_train, exclude)
    g = probability_metrics(scored, "p_final_home", label, [season])
    w = probability_metrics(scored, "p_win", label, [season])
    q = scored.groupBy(season).agg(F.avg("rps").alias("goals_rps"), F.avg("exact_hit").alias("goals_exact_score_accuracy"))
    return g.select(season, F.col("n_games").alias("n_test"), F.col("accuracy").alias("goals_accuracy"),
                    F.col("log_loss").alias("goals_log_loss")).join(
        w.select(season, F.col("accuracy").alias("win_accuracy"), F.col("log_loss").alias("win_log_loss")), season).join(
        q, season)


def series_backtest(ctx: Context, series: DataFrame, regular: DataFrame, features: Sequence[str] = FEATURES,
                    season: str = "season", min_train: int = 2, max_goals: int = 10,
                    playoff: Payload | None = None) -> DataFrame:
    """One row per completed series with the exact series probability from the goals model.

    ``regular`` are scored regular-season feature rows.  Every series is asked twice at its
    start date, with A and with B as the home side, in one feature plan.
    """
    done = completed_series(ctx.games.where(F.col("game_type") == PLAYOFF),
                            seat_seeds(series).select((
                                (F.col("bracket_year") - 1) * 10000 + F.col("bracket_year")).cast("long").alias("season"),
                                "team_id", "seed"),
                            "season", "id", "date", "home_team_id", "away_team_id")
    done = done.withColumn("series_id", F.col("first_id"))

    def ask(host, home, away):
        return done.select(F.concat_ws("-", F.col("series_id").cast("string"), F.lit(host)).alias(SPINE), "series_id",
                           F.lit(host).alias("host"), F.col(home).alias("home_team_id"),
                           F.col(away).alias("away_team_id"), F.col("start_date").alias("date"), "season")
    asked = ask("A", "team_a_id", "team_b_id").unionByName(ask("B", "team_b_id", "team_a_id"))
    feats = prepare(build_features(ctx, asked.drop("series_id", "host")), features)
    feats = cut_lineage(feats.join(asked.select(F.col(SPINE).alias("game_id"), "series_id", "host"), "game_id"))
    reg = cut_lineage(prepare(regular, features))
    seasons = [r[0] for r in reg.select(season).distinct().orderBy(season).collect()]
    rates = None
    for i, s in enumerate(seasons):
        if i < min_train:
            continue
        model = fit_goals(reg.where(F.col(season).isin(*seasons[:i])), features, scale=False)
        part = model.distribution(feats.where(F.col(season) == s), max_goals).select("series_id", "host", "p_final_home")
        rates = part if rates is None else rates.unionByName(part)
    if rates is None:
        raise ValueError("no season has enough training seasons")

    def both_hosts(rows, p):
        return rows.groupBy("series_id").agg(
            F.max(F.when(F.col("host") == "A", F.col(p))).alias("_pa"),
            F.max(F.when(F.col("host") == "B", F.col(p))).alias("_pb")).where(
            F.col("_pa").isNotNull() & F.col("_pb").isNotNull())
    p = series_probability(both_hosts(rates, "p_final_home"), "_pa", "_pb").select(
        "series_id", F.col("p_a_wins").alias("p_goals"))
    out = done.join(p, "series_id")
    if playoff is not None:
        diff = done.select("series_id", "seed_diff_a_home")
        rows = feats.join(diff, "series_id").withColumns({
            "series_game_number": F.lit(1.0), "home_series_wins": F.lit(0.0), "away_series_wins": F.lit(0.0),
            "seed_diff": F.when(F.col("host") == "A", F.col("seed_diff_a_home")).otherwise(-F.col("seed_diff_a_home"))})
        q = series_probability(both_hosts(score(playoff.model, prepare(rows, playoff.features), "_q"), "_q"),
                               "_pa", "_pb").select("series_id", F.col("p_a_wins").alias("p_playoff"))
        out = out.join(q, "series_id", "left")
    return out
