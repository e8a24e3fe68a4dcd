"""Model queries fit as many trees as the library's defaults name; the trees themselves are left out here."""

import datetime

import pytest

import bridge.jobs as jobs
from bridge.registry import QUERIES
from bridge.views import Views
from daybefore.plans import ml


def _matches(spark):
    day = datetime.date(1998, 1, 1)
    rows = [(i, day, 1998 + i // 60, 3 if i % 4 == 0 else 2, i % 5, i % 3, i % 7, (i + 1) % 7, i % 2, *[float(i * k % 11) for k in (1, 3, 5, 7, 2)],
             0.0, 0.0) for i in range(180)]
    return spark.createDataFrame(rows, "game_id long, date date, season long, game_type int, home_score int, away_score int, home_team_id long, "
                                 f"away_team_id long, target int, {', '.join(f'{c} double' for c in jobs.COLS)}, "
                                 "home_goals_for_per_game double, away_goals_for_per_game double")


def _skaters(spark):
    rows = [(i, 19992000 if i % 3 == 0 else 19981999, "C", i % 2 == 0, float(i % 2), *[float(i % k) for k in range(2, 10)]) for i in range(90)]
    names = [c for c in ml.PLAYER_FEATURES if c.startswith("rolling_")]
    return spark.createDataFrame(rows, f"game_id long, season long, position string, is_home boolean, points double, {', '.join(f'{c} double' for c in names)}")


# 500 trees of both kinds for both feature sets; F4: 300 for the playoffs, 500 a side for the scores; F6: 300; F7: 500 a side
@pytest.mark.parametrize("name, trees", [
    ("model_comparison", [500, 500, 500, 500]), ("matchup_prediction", [300, 500, 500]), ("player_training", [300]), ("score_regression", [500, 500])])
def test_all_trees_are_fitted(spark, monkeypatch, name, trees):
    asked = []

    def counted(kind, size):
        def make(**params):
            asked.append(params[size])
            return kind(**{**params, size: 1})
        return make
    for kind, size in (("GBTClassifier", "maxIter"), ("GBTRegressor", "maxIter"), ("RandomForestClassifier", "numTrees")):
        monkeypatch.setattr(ml, kind, counted(getattr(ml, kind), size))
    monkeypatch.setattr(jobs, "_feature_rows", lambda v: _matches(spark))
    monkeypatch.setattr(Views, "skater_log", _skaters(spark))
    assert QUERIES[name](spark, "nowhere").count() > 0
    assert sorted(asked) == trees
