"""The seven input tables as one container of DataFrames with fixed schemas."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybefore.functions.scalars import as_day, safe_number
from daybefore.operators.rolling import rolling_mean_prior
from daybefore.plans.columns import SHARES, SKATER_STATS, STANDING_MEASURES, TEAM_STATS
from daybefore.sources.scans import first_non_empty, read_or_empty

SCHEMAS = {
    "games": {"id": "long", "season": "long", "game_type": "int", "date": "date", "home_team_id": "long",
              "away_team_id": "long", "home_score": "int", "away_score": "int", "game_state": "string"},
    "standings": {"team_id": "long", "season": "long", "as_of_date": "date",
                  **{c: "double" for c in STANDING_MEASURES}},
    "goalies": {"game_id": "long", "player_id": "long", "team_id": "long", "is_home": "boolean", "saves": "double",
                "shots_against": "double", "date": "date", "season": "long"},
    "goalie_values": {"game_id": "long", "player_id": "long", "team_id": "long", "date": "date", "value": "double",
                      "season": "long"},
    "team_stats": {"game_id": "long", "team_id": "long", "is_home": "boolean", "date": "date",
                   **{c: "double" for c in TEAM_STATS}},
    "shares": {"game_id": "long", "team_id": "long", "season": "long", "date": "date",
               **{c: "double" for c in SHARES}},
    "skaters": {"game_id": "long", "player_id": "long", "team_id": "long", "is_home": "boolean",
                "position": "string", "toi_sec": "double", **{c: "double" for c in SKATER_STATS},
                "date": "date", "season": "long"},
}


def _conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Cast to the schema; unknown columns are kept out, missing ones become NULL."""
    have = set(df.columns)

    def one(name, kind):
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        if kind == "date":
            return as_day(name).alias(name)
        if kind in ("double", "long", "int"):
            return safe_number(name, kind).alias(name)
        return F.col(name).cast(kind).alias(name)

    return df.select(*[one(n, k) for n, k in schema.items()])


@dataclass(frozen=True)
class Context:
    """Input tables. ``normalised`` gives every table its schema, a date and a season."""

    games: DataFrame
    standings: DataFrame
    goalies: DataFrame
    goalie_values: DataFrame
    team_stats: DataFrame
    shares: DataFrame
    skaters: DataFrame

    def normalised(self) -> "Context":
        out = {}
        for f in fields(self):
            df = getattr(self, f.name)
            if "season_id" in df.columns and "season" not in df.columns:
                df = df.withColumnRenamed("season_id", "season")
            if f.name == "goalie_values" and "gsax" in df.columns:
                df = df.withColumnRenamed("gsax", "value")
            need = [c for c in ("date", "season") if c in SCHEMAS[f.name] and c not in df.columns]
            if need and f.name != "games":
                g = self.games.select(F.col("id").alias("game_id"), *need)
                df = df.join(g, "game_id", "left")
            rolled = [c for c in df.columns if c.startswith("rolling_")] if f.name == "skaters" else []
            out[f.name] = _conform(df, SCHEMAS[f.name] | {c: "double" for c in rolled})
        if "rolling_toi_sec" not in out["skaters"].columns:
            out["skaters"] = rolling_mean_prior(out["skaters"], "player_id", "date", "game_id",
                                                [*SKATER_STATS, "toi_sec"])
        return Context(**out)

    def with_tables(self, **tables: DataFrame) -> "Context":
        return replace(self, **tables)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "Context":
        """Read ``root/<table>``; optional tables that do not exist are empty."""
        def ddl(name):
            return ", ".join(f"`{c}` {k}" for c, k in SCHEMAS[name].items())
        return cls(**{n: read_or_empty(spark, f"{root.rstrip('/')}/{n}", ddl(n)) for n in SCHEMAS})


def shares_or_computed(stored, compute) -> DataFrame:
    """Stored share table if it has rows, else computed from the events."""
    return first_non_empty(stored, compute)
