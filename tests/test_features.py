"""Invariants of the feature plan on the smallest tables: parity and no look-ahead."""

import pytest
from pyspark.sql import functions as F

from bridge.views import Views
from daybefore.plans import materialize
from daybefore.plans.features import SPINE, build_features

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def batch(spark):
    v = Views(spark, SF)
    return v, {r["game_id"]: r.asDict() for r in build_features(v.context, game_type=2).collect()}


def same(a, b, skip=()):
    for c in a:
        if c in skip or c not in b:
            continue
        x, y = a[c], b[c]
        ok = x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 1e-9)
        assert ok, (c, x, y)


def test_requests_for_the_games_equal_the_batch(batch):
    """Same columns from the request path; only the starter is the latest one, not the recorded one."""
    v, rows = batch
    ask = v.games.where("game_type = 2").select(F.col("id").alias(SPINE), "season", "date", "home_team_id", "away_team_id")
    got = {r["game_id"]: r.asDict() for r in build_features(v.context, ask, h2h_types=[2]).collect()}
    assert got.keys() == rows.keys() and rows
    goalie = [c for c in next(iter(rows.values())) if "goalie" in c]
    for g, r in rows.items():
        same(r, got[g], [*goalie, "target", "game_type"])


def test_later_rows_change_nothing(batch):
    """Cutting every table at a date leaves the features of the games before it unchanged."""
    v, rows = batch
    dates = sorted(r["date"] for r in rows.values())
    cut = dates[len(dates) // 2]
    ctx = v.context
    early = ctx.with_tables(**{
        n: getattr(ctx, n).where(F.col("as_of_date" if n == "standings" else "date") < F.lit(cut))
        for n in ("games", "standings", "goalies", "goalie_values", "team_stats", "shares", "skaters")})
    got = {r["game_id"]: r.asDict() for r in build_features(early, game_type=2).collect()}
    assert got.keys() == {g for g, r in rows.items() if r["date"] < cut}
    for g, r in got.items():
        same(r, rows[g])


def test_stored_training_rows_equal_computed_ones(spark, batch, tmp_path):
    """From the store where there are rows, else computed; a dry run stores nothing."""
    v, rows = batch
    path = str(tmp_path / "features")
    dry = materialize.materialize(v.context, v.series, path, dry_run=True)
    assert not (tmp_path / "features").exists() and materialize.stored_features(spark, path).isEmpty()
    computed = {k: {r["game_id"]: r.asDict() for r in materialize.training_rows(v.context, path, k, v.series).collect()} for k in (2, 3)}
    done = materialize.materialize(v.context, v.series, path)
    assert done == dry and done.features == sum(done.by_type.values()) == sum(map(len, computed.values())) and done.teams and done.goalies
    for kind, want in computed.items():
        got = {r["game_id"]: r.asDict() for r in materialize.training_rows(v.context, path, kind, v.series).collect()}
        assert got.keys() == want.keys() and (kind == 3 or got.keys() == rows.keys())
        for g, r in got.items():
            same(r, want[g])


def test_the_plan_stays_small(batch):
    """What is left to do once the shared tables are written: few shuffles, each source read at most twice."""
    plan = build_features(batch[0].context, game_type=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 25


def test_sides_stay_narrow_and_null_keys_have_no_team(spark, batch):
    """Team values travel as one column; a side without team or date gets what follows from no values, as before."""
    from daybefore.plans.features import TEAM, packed_sides, side_features
    v = batch[0]
    some = v.tg.select(F.concat_ws("-", "match_id", "is_home").alias(SPINE), F.col("label").alias("season"), F.col("match_date").alias("date"),
                       F.col("match_id").alias("game_id"), "team_id", "is_home", F.lit(None).cast("long").alias("_override")).orderBy("match_id", "is_home").limit(6)
    odd = some.withColumns({"team_id": F.when(F.substring(SPINE, -4, 4) == "true", F.col("team_id"))})
    packed = packed_sides(v.context, odd)
    assert len(packed.columns) <= 32 and TEAM in packed.columns
    rows = {r[SPINE]: r for r in side_features(v.context, odd).collect()}
    assert len(rows) == 6
    for r in rows.values():
        if r["team_id"] is None:
            assert r["elo"] is None and r["as_of_date"] is None and r["team_off_strength"] is None and r["team_split_strength"] == 0.0
        else:
            assert r["elo"] is not None and r["team_off_strength"] is not None
