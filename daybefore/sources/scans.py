"""Scans with pushed filters and pruned columns, enrichment joins, lookups and fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybefore.functions.scalars import as_day, clock_seconds, safe_number

FINAL_STATES = ("OFF", "FINAL")
REGULAR, PLAYOFF = 2, 3


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or an empty one with ``schema`` when it does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def completed_games(games: DataFrame, types: Sequence[int] = (REGULAR, PLAYOFF), columns: Sequence[str] | None = None,
                    state: str = "game_state", kind: str = "game_type",
                    final: Sequence[str] = FINAL_STATES) -> DataFrame:
    """Finished games of the given types; both filters reach the file scan."""
    out = games.where(F.col(kind).isin(*types) & F.col(state).isin(*final))
    return out.select(*columns) if columns else out


def games_between(games: DataFrame, start, end, types: Sequence[int] = (REGULAR, PLAYOFF), time: str = "date",
                  kind: str = "game_type") -> DataFrame:
    """Games in an inclusive date range, any state."""
    if end < start:
        raise ValueError("end must not be before start")
    return games.where(F.col(time).between(F.lit(start), F.lit(end)) & F.col(kind).isin(*types))


def with_game_columns(rows: DataFrame, games: DataFrame, game: str = "game_id", id: str = "id",
                      columns: Sequence[str] = ("date",)) -> DataFrame:
    """Left join the named game columns onto per-game rows."""
    return rows.join(games.select(F.col(id).alias(game), *columns), game, "left")


def parsed_clock(rows: DataFrame, clock: str = "toi", out: str = "toi_sec") -> DataFrame:
    return rows.withColumn(out, clock_seconds(clock))


def skater_scan(rows: DataFrame, games: DataFrame, clock: str = "toi") -> DataFrame:
    """Player rows of games with ice time in seconds and the game's date and season; NULL where the game is unknown."""
    return with_game_columns(parsed_clock(rows, clock), games, columns=("date", "season"))


def typed(rows: DataFrame, numbers: Sequence[str], dates: Sequence[str] = ("date",)) -> DataFrame:
    """Coerce the named columns that exist; bad values become NULL."""
    cols = {c: safe_number(c) for c in numbers if c in rows.columns}
    cols |= {c: as_day(c) for c in dates if c in rows.columns}
    return rows.withColumns(cols) if cols else rows


def first_non_empty(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The first source that has a row (one-row probe each); the last one if none has."""
    for make in sources[:-1]:
        df = make()
        if not df.isEmpty():
            return df
    return sources[-1]()


def lookup(rows: DataFrame, dim: DataFrame, on: str, key: str, columns: Mapping[str, str],
           fallback: Mapping[str, str] | None = None) -> DataFrame:
    """Attach display columns of a dimension, with fallback text where the key is unknown."""
    d = dim.select(F.col(key).alias(on), *[F.col(c).alias(a) for c, a in columns.items()])
    out = rows.join(d, on, "left")
    for c, text in (fallback or {}).items():
        out = out.withColumn(c, F.coalesce(c, F.lit(text)))
    return out


def with_scores(features: DataFrame, games: DataFrame, on: str = "game_id", id: str = "id",
                hs: str = "home_score", as_: str = "away_score") -> DataFrame:
    """Score labels joined onto features once per game; rows without both scores are dropped."""
    s = games.select(F.col(id).alias(on), hs, as_).dropDuplicates([on])
    return features.join(s, on, "left").dropna(subset=[hs, as_])


def excluding(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose column is none of ``values``; null is none of them."""
    return df.where(~F.coalesce(F.col(column).isin(*values), F.lit(False))) if values else df


def holdout(df: DataFrame, season: str, test_season) -> tuple[DataFrame, DataFrame]:
    """Training and test rows; a row without season trains."""
    test = F.coalesce(F.col(season) == F.lit(test_season), F.lit(False))
    return df.where(~test), df.where(test)


def date_range(spark: SparkSession, start, end) -> DataFrame:
    """One row per day, both ends included."""
    if end < start:
        raise ValueError("end must not be before start")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
