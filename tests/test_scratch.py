"""Tables written between steps don't outlive the step that reads them."""

import datetime
import os

import pytest

from daybefore.plans import serve
from daybefore.plans.ml import GoalsModel, Payload
from daybefore.session import FREES, checkpoint_dir, scratch, settled, written
from daybefore.sources import store


def _kept(spark):
    at = checkpoint_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(at) if f.startswith(("table-", "rdd-"))}


def test_only_the_result_stays(spark):
    before, conf = _kept(spark), spark.conf.get(FREES, None)

    def build():
        a = written(spark.range(5).toDF("x"))
        return settled(lambda: written(a).selectExpr("x + 1 AS x"))
    got = settled(build)
    assert len(_kept(spark) - before) == 1
    assert sorted(r[0] for r in got.collect()) == [1, 2, 3, 4, 5]
    with scratch():
        written(got)
        with pytest.raises(ZeroDivisionError):
            with scratch():
                written(got)
                raise ZeroDivisionError
    assert len(_kept(spark) - before) == 1
    assert spark.conf.get(FREES, None) == conf


def test_last_row_of_a_key_wins_in_every_share(spark, tmp_path):
    day = datetime.date(2001, 1, 1)
    rows = spark.createDataFrame([(k, f"p{k % 3}" if k % 7 else None, day, v) for k in [*range(40), None] for v in (1, 3, 2) if k is not None] + [(None, "p0", day, 1), (None, "p0", day, 2)],
                                 "k long, p string, d date, v int").repartition(5)
    n = store.commit(spark, str(tmp_path), {"t": store.Write(rows, ["k"], ["v"], "p")})
    got = store.read(spark, str(tmp_path), "t")
    assert n == {"t": 41} and got.columns == ["k", "p", "d", "v"]
    assert sorted((r["k"] if r["k"] is not None else -1, r["v"]) for r in got.collect()) == [(-1, 2), *[(k, 3) for k in range(40)]]


def test_scoring_leaves_its_rows_once(spark, tmp_path, monkeypatch):
    """Of what scoring wrote on the way, the scored rows and the benchmark stay, as Parquet."""
    day = datetime.date(2001, 1, 2)
    games = spark.createDataFrame([(i, day, 20002001, 2, i % 3, (i + 1) % 3, 2, 1, "OFF") for i in range(6)],
                                  "id long, date date, season long, game_type int, home_team_id long, away_team_id long, home_score int, away_score int, game_state string")

    class Fixed(GoalsModel):
        def distribution(self, df, max_goals=10):
            names = ["p_final_home", "expected_home", "expected_away", "most_likely_home", "most_likely_away", "p_tie", "lambda_home", "lambda_away", "lambda3"]
            return df.selectExpr("game_id", *[f"0.5D AS {n}" for n in names])

    class Tables:
        pass
    Tables.games = games
    monkeypatch.setattr(serve, "day_features", lambda ctx, g: written(g.selectExpr("id AS game_id", "1.0D AS x")))
    odds = games.selectExpr("id AS game_id", "date", "'closing' AS snapshot_type", "id AS quote_id", "-110 AS home_moneyline", "100 AS away_moneyline")
    before = _kept(spark)
    done = serve.score_dates(Tables, day, day, Payload(Fixed(None, None, 0.0), ["x"], "goals"), odds, path=str(tmp_path / "s"))
    left = _kept(spark) - before
    assert len(left) == 2 and all(f.startswith("table-") for f in left)
    assert done.written == (6, 6, 1) and done.daily.first()["n_games"] == 6


def test_feature_store_leaves_only_the_store(spark, tmp_path, monkeypatch):
    from daybefore.plans import materialize
    day = datetime.date(2001, 1, 2)
    rows = spark.createDataFrame([(i, 20002001, day, 2, i % 3, 0.5) for i in range(6)], "game_id long, season long, date date, game_type int, team_id long, elo double")
    monkeypatch.setattr(materialize, "store_rows", lambda *a: written(rows).select("*"))
    monkeypatch.setattr(materialize, "form_sides", lambda ctx, r: written(r))
    monkeypatch.setattr(materialize, "form_snapshots", lambda full, version: (
        full.selectExpr("team_id", "date AS as_of_date", "season", "elo"), full.selectExpr("game_id AS player_id", "team_id", "date AS as_of_date")))
    before = _kept(spark)
    done = materialize.materialize(None, None, str(tmp_path / "s"))
    assert (done.features, done.teams, done.goalies, done.by_type) == (6, 3, 6, {2: 6})
    assert _kept(spark) == before
    assert materialize.stored_features(spark, str(tmp_path / "s")).count() == 6
