"""Casts, defaults, shrinkage and season arithmetic, all as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_day(col: Column | str) -> Column:
    """Calendar day of a date or timestamp; text that is no date becomes NULL."""
    return F.to_date(_c(col).try_cast("timestamp_ntz"))


def safe_number(col: Column | str, to: str = "double") -> Column:
    """Bad text and NaN become NULL."""
    c = _c(col).try_cast("double")
    c = F.when(~F.isnan(c), c)
    return c if to == "double" else c.cast(to)


def no_nan(col: Column | str) -> Column:
    c = _c(col).cast("double")
    return F.when(~F.isnan(c), c)


def or_default(col: Column | str, default, zero_is_missing: bool = True) -> Column:
    """``x or d``: missing becomes the default, and so does a true zero unless told not to."""
    c = _c(col)
    missing = c.isNull() | (c == 0) if zero_is_missing else c.isNull()
    return F.when(missing, F.lit(default)).otherwise(c)


def bayes_mean(x, m, n, w) -> Column:
    """Shrink ``x`` seen ``n`` times towards ``m`` with weight ``w``; ``m`` when n + w <= 0."""
    x, m, n, w = (v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v))
                  for v in (x, m, n, w))
    m = F.coalesce(m.cast("double"), F.lit(0.0))
    x = F.coalesce(x.cast("double"), m)
    n = F.greatest(F.coalesce(n.cast("double"), F.lit(0.0)), F.lit(0.0))
    w = F.greatest(F.coalesce(w.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(n + w <= 0, m).otherwise((x * n + m * w) / F.when(n + w > 0, n + w))


def share(f: Column | str, a: Column | str) -> Column:
    """f / (f + a), and 0.5 when both sides are 0."""
    f, a = _c(f).cast("double"), _c(a).cast("double")
    return F.when(f + a > 0, f / (f + a)).otherwise(F.lit(0.5))


def clock_seconds(col: Column | str) -> Column:
    """``MM:SS`` text to seconds; missing or malformed text is 0."""
    p = F.split(_c(col), ":")
    mins = F.try_element_at(p, F.lit(1)).try_cast("int")
    secs = F.try_element_at(p, F.lit(2)).try_cast("int")
    return F.coalesce(mins * 60 + secs, F.lit(0)).cast("double")


# Position letter codes, any other letter or none is 3.
POSITION_CODES = {"C": 0, "L": 1, "R": 2, "D": 3}


def position_code(col: Column | str) -> Column:
    letter = F.upper(F.substring(_c(col), 1, 1))
    table = F.create_map(*[F.lit(v) for kv in POSITION_CODES.items() for v in kv])
    return F.coalesce(table[letter], F.lit(3))


def season_of(day: Column | str) -> Column:
    """YYYYYYYY season label of a date; a season starts in October."""
    d = _c(day)
    start = F.when(F.month(d) >= 10, F.year(d)).otherwise(F.year(d) - 1)
    return (start * 10000 + start + 1).cast("long")


def previous_season(season: Column | str) -> Column:
    """The label of the season before; NULL if the label is not eight digits."""
    s = _c(season).cast("long")
    eight = (s >= 10000000) & (s <= 99999999)
    return F.when(eight, s - 10001)


def bracket_year(season: Column | str) -> Column:
    return (_c(season).cast("long") % 10000).cast("int")


def record_text(wins: Column | str, losses: Column | str, ot_losses: Column | str) -> Column:
    return F.concat_ws("-", *[F.coalesce(_c(c).cast("long"), F.lit(0)).cast("string")
                              for c in (wins, losses, ot_losses)])


def run_id(day: Column | str, feature_version: Column | str, model_version: Column | str) -> Column:
    return F.concat_ws("|", F.date_format(_c(day), "yyyy-MM-dd"), _c(feature_version), _c(model_version))


def is_final(state: Column | str, final: Sequence[str] = ("OFF", "FINAL")) -> Column:
    return F.coalesce(F.upper(_c(state).cast("string")).isin(*final), F.lit(False))


def outcome(final: Column | str, home_score: Column | str, away_score: Column | str) -> Column:
    """1 / 0 home win once final with both scores, else NULL. A tie counts as 0."""
    h, a = _c(home_score), _c(away_score)
    return F.when(_c(final) & h.isNotNull() & a.isNotNull(), (h.cast("double") > a.cast("double")).cast("int"))


def sink_text(df: DataFrame) -> DataFrame:
    """Normalise every column for a JSON-like sink.

    NaN becomes NULL, dates become ISO text, midnight timestamps become ISO dates and
    other timestamps ISO date-times.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.when(F.date_trunc("day", c) == c, F.date_format(c, "yyyy-MM-dd")).otherwise(
                F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
        out.append(c.alias(f.name))
    return df.select(*out)


def contract(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Exactly ``columns`` (name to type), in order: missing ones NULL, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in columns.items()])


def neutral_fill(df: DataFrame, cols: Sequence[str], fills: Mapping[str, float],
                 default: float = 0.5) -> DataFrame:
    """Fill NULL and NaN per column; a column without an entry gets ``default``."""
    names = set(cols)
    return df.select(*[
        F.coalesce(no_nan(c), F.lit(float(fills.get(c, default)))).alias(c) if c in names else F.col(c)
        for c in df.columns])


def missing_counts(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column with its NULL count, in one pass.

    A column that is not in the schema at all raises before any data is read.
    """
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"required columns absent: {absent}")
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_missing")) for c in required])
    return agg.select(F.inline(pairs))
