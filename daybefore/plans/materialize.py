"""The feature store job and the form snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybefore.functions.scalars import contract
from daybefore.operators.asof import asof_join
from daybefore.plans.columns import (GOALIE_STRENGTHS, LINEUP, PLAYOFF_CONTRACT, SHARES, STORE_CONTRACT,
                                     STORE_VERSION, TEAM_STATS, TEAM_STRENGTHS, TRAINING_CONTRACT)
from daybefore.plans.features import SPINE, attach_series, build_features, game_spine, side_features
from daybefore.session import scratch, settled
from daybefore.sources.context import Context
from daybefore.sources import store
from daybefore.sources.scans import PLAYOFF, REGULAR, first_non_empty


def store_rows(ctx: Context, series: DataFrame, game_type: str = "all", limit: int | None = None,
               version: str = STORE_VERSION) -> DataFrame:
    """Contract rows of the chosen types, tagged with a version; the first ``limit`` by (date, game)."""
    types = {"2": [REGULAR], "3": [PLAYOFF], "all": [REGULAR, PLAYOFF]}.get(game_type)
    if types is None:
        raise ValueError("game_type is '2', '3' or 'all'")
    spine = game_spine(ctx.games, None).where(F.col("game_type").isin(types))
    df = build_features(ctx, spine, member_mode="actual", h2h_types="by_type", series=series if PLAYOFF in types else None)  # one plan for both types
    rows = contract(df.withColumn("feature_version", F.lit(version)), STORE_CONTRACT)
    return rows.orderBy("date", "game_id").limit(limit) if limit is not None else rows


def form_sides(ctx: Context, rows: DataFrame) -> DataFrame:
    """Side columns of the last game of each (team, date) of the rows (game, season, date, two teams)."""
    def side(name, is_home):
        return F.struct(F.col(f"{name}_team_id").alias("team_id"), F.lit(is_home).alias("is_home"))
    both = rows.select(F.col("game_id").alias("_g"), "season", "date", F.inline(F.array(
        side("home", True), side("away", False))))
    none = F.lit(None).cast("long")
    both = both.select("*", F.concat_ws("-", F.lpad(F.col("_g").cast("string"), 20, "0"), F.col("is_home").cast("string")).alias(SPINE),
                       none.alias("game_id"), none.alias("_override"))
    w = Window.partitionBy("team_id", "date").orderBy(F.col("_g").desc(), F.col("is_home").cast("int"))
    last = both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_g")
    return side_features(ctx, last, "latest", use_rest=False)


def form_snapshots(full: DataFrame, version: str = STORE_VERSION) -> tuple[DataFrame, DataFrame]:
    """Team form per (team, date) and goalie form per (goalie, date) from :func:`form_sides`.

    Rest is left out of the goalie part.
    """
    team = full.select(
        "team_id", F.col("date").alias("as_of_date"), "season", "point_pctg", "win_pctg",
        F.col("regulation_win_pctg").alias("reg_win_pctg"), F.col("goal_differential").alias("goal_diff"),
        "l10_points", F.col("rolling_pp_pctg").alias("pp_pctg"),
        F.col("rolling_faceoff_winning_pctg").alias("faceoff_pctg"),
        *[F.col(f"rolling_{c}").alias(c) for c in TEAM_STATS[2:]], *SHARES, *TEAM_STRENGTHS, *LINEUP, "elo",
        F.lit(version).alias("feature_version"))
    wg = Window.partitionBy("player_id", "date").orderBy(F.col(SPINE).desc())
    goalie = full.where(F.col("player_id").isNotNull()).withColumn("_rn", F.row_number().over(wg)).where(
        F.col("_rn") == 1).select(
        "player_id", "team_id", F.col("date").alias("as_of_date"), F.col("goalie_sv").alias("goalie_sv_pctg"),
        "goalie_gsax", *GOALIE_STRENGTHS, F.lit(version).alias("feature_version"))
    return team, goalie


@dataclass
class Written:
    features: int
    teams: int
    goalies: int
    by_type: dict


def materialize(ctx: Context, series: DataFrame, path: str, game_type: str = "all", limit: int | None = None,
                version: str = STORE_VERSION, dry_run: bool = False) -> Written:
    """Build the three tables and upsert them into the store at ``path`` in one commit; with ``dry_run`` only count."""
    with scratch():  # what is kept is in the store; rows are wide, so no step leaves a second copy of them
        rows = settled(lambda: store_rows(ctx, series, game_type, limit, version))
        counts = {r["game_type"]: r["count"] for r in rows.groupBy("game_type").count().collect()}
        team, goalie = form_snapshots(settled(lambda: form_sides(ctx, rows)), version)
        month = F.date_format("as_of_date", "yyyy-MM")
        writes = {"game_features": store.Write(rows, ["game_id"], ["date"], "season"),
                  "team_form": store.Write(team.withColumn("month", month), ["team_id", "as_of_date"], ["season"], "month"),
                  "goalie_form": store.Write(goalie.withColumn("month", month), ["player_id", "as_of_date"], ["team_id"], "month")}
        n = store.count(writes) if dry_run else store.commit(rows.sparkSession, path, writes)
    return Written(n["game_features"], n["team_form"], n["goalie_form"], counts)


def stored_features(spark, path: str, game_type: int | None = None) -> DataFrame:
    """Feature-store scan; empty with the contract schema when nothing is stored yet."""
    df = store.read(spark, path, "game_features")
    if df is None:
        df = spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in STORE_CONTRACT.items()))
    return df if game_type is None else df.where(F.col("game_type") == game_type)


def latest_form(requests: DataFrame, form: DataFrame, entity: str, time: str = "date") -> DataFrame:
    """Latest stored form on or before each request's date."""
    cols = [c for c in form.columns if c not in (entity, "as_of_date", "month")]
    return asof_join(requests, form, [entity], time, "as_of_date", cols, inclusive=True)


def training_rows(ctx: Context, path: str | None, game_type: int = REGULAR, series: DataFrame | None = None) -> DataFrame:
    """Stored rows if there are any, else computed ones, in the training contract."""
    spark = ctx.games.sparkSession

    def compute():
        base = build_features(ctx, game_type=game_type)
        return attach_series(base, ctx.games, series) if game_type == PLAYOFF else base

    df = compute() if path is None else first_non_empty(lambda: stored_features(spark, path, game_type), compute)
    return contract(df, PLAYOFF_CONTRACT if game_type == PLAYOFF else TRAINING_CONTRACT)
