"""Prior-n rolling statistics and rest days, strictly before the row's date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybefore.functions.scalars import no_nan
from daybefore.operators.asof import asof_lookup
from daybefore.operators.daystate import DAY, attach, before, day_end_state, days_of


def _clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: no_nan(c) for c in cols})


def _means(cols: Sequence[str], min_obs: int, prefix: str = "rolling_"):
    def exprs(w):
        return {f"{prefix}{c}": F.when(F.count(c).over(w) >= min_obs, F.avg(c).over(w)) for c in cols}
    return exprs


def means(cols: Sequence[str], min_obs: int = 3, prefix: str = "rolling_"):
    """For an as-of merge: mean of each column over the last rows, NULL below ``min_obs`` values."""
    def exprs(value, recent, _):
        return {f"{prefix}{c}": F.when(F.count(no_nan(value(c))).over(recent) >= min_obs, F.avg(no_nan(value(c))).over(recent)) for c in cols}
    return exprs


def ratio(num: str, den: str, min_obs: int = 3, out: str = "rate"):
    """For an as-of merge: sum(num) / sum(den) over the last rows."""
    def exprs(value, recent, _):
        n, d = no_nan(value(num)), no_nan(value(den))
        enough = (F.count(n).over(recent) >= min_obs) & (F.count(d).over(recent) >= min_obs)
        total = F.sum(d).over(recent)
        return {out: F.when(enough & (total != 0), F.sum(n).over(recent) / F.when(total != 0, total))}
    return exprs


def _ratio(num: str, den: str, min_obs: int, out: str):
    def exprs(w):
        enough = (F.count(num).over(w) >= min_obs) & (F.count(den).over(w) >= min_obs)
        total = F.sum(den).over(w)
        return {out: F.when(enough & (total != 0), F.sum(num).over(w) / F.when(total != 0, total))}
    return exprs


def mean_states(hist: DataFrame, entity: str, time: str, id: str, cols: Sequence[str], n: int = 10,
                min_obs: int = 3) -> DataFrame:
    return day_end_state(_clean(hist, cols), [entity], time, [id], n, cols, _means(cols, min_obs))


def ratio_states(hist: DataFrame, entity: str, time: str, id: str, num: str, den: str, n: int = 10,
                 min_obs: int = 3, out: str = "rate") -> DataFrame:
    return day_end_state(_clean(hist, [num, den]), [entity], time, [id], n, [num, den],
                         _ratio(num, den, min_obs, out))


def rolling_mean_prior(df: DataFrame, entity: str, time: str, id: str, cols: Sequence[str], n: int = 10,
                       min_obs: int = 3) -> DataFrame:
    """Mean of each column over the entity's last ``n`` rows before the row's date.

    NULL below ``min_obs`` non-null values in those rows; NULLs take up a slot.
    """
    return attach(df, before(mean_states(df, entity, time, id, cols, n, min_obs), [entity]), [entity], time)


def rolling_ratio_prior(df: DataFrame, entity: str, time: str, id: str, num: str, den: str, n: int = 10,
                        min_obs: int = 3, out: str = "rate") -> DataFrame:
    """sum(num) / sum(den) over the entity's last ``n`` rows before the row's date."""
    return attach(df, before(ratio_states(df, entity, time, id, num, den, n, min_obs, out), [entity]),
                  [entity], time)


def rolling_as_of(spine: DataFrame, hist: DataFrame, entity: str, time: str, id: str, cols: Sequence[str],
                  n: int = 10, min_obs: int = 3, spine_time: str | None = None,
                  base: DataFrame | None = None) -> DataFrame:
    """:func:`rolling_mean_prior` for arbitrary (entity, date) requests."""
    t = spine_time or time
    states = mean_states(hist, entity, time, id, cols, n, min_obs)
    got = asof_lookup(days_of(base or spine, [entity], t), states, [entity])
    return attach(spine, got, [entity], t)


def ratio_as_of(spine: DataFrame, hist: DataFrame, entity: str, time: str, id: str, num: str, den: str,
                n: int = 10, min_obs: int = 3, out: str = "rate", spine_time: str | None = None,
                base: DataFrame | None = None) -> DataFrame:
    """:func:`rolling_ratio_prior` for arbitrary (entity, date) requests."""
    t = spine_time or time
    states = ratio_states(hist, entity, time, id, num, den, n, min_obs, out)
    return attach(spine, asof_lookup(days_of(base or spine, [entity], t), states, [entity]), [entity], t)


def sides(matches: DataFrame, id: str = "match_id", time: str = "match_date", home: str = "home_id",
          away: str = "away_id", hs: str = "home_score", as_: str = "away_score",
          keep: Sequence[str] = ()) -> DataFrame:
    """Two rows per match, one per side: team, opponent, goals for and against, won.

    Both rows come from one pass over the matches.
    """
    def side(team, opp, gf, ga, is_home):
        return F.struct(
            F.col(team).alias("team_id"), F.col(opp).alias("opp_id"), F.lit(is_home).alias("is_home"),
            F.col(gf).alias("gf"), F.col(ga).alias("ga"),
            F.coalesce((F.col(gf) > F.col(ga)).cast("double"), F.lit(0.0)).alias("won"))
    both = F.array(side(home, away, hs, as_, True), side(away, home, as_, hs, False))
    return matches.select(id, time, *keep, F.inline(both))


def rest_states(played: DataFrame, entity: str, time: str) -> DataFrame:
    """(entity, day) with the day itself as value, for looking up the last day played."""
    return days_of(played, [entity], time).withColumn("_last", F.col(DAY))


def rest_days(matches: DataFrame, id: str = "match_id", time: str = "match_date", home: str = "home_id",
              away: str = "away_id") -> DataFrame:
    """Per match and side: days since the team's last earlier match day, and the back-to-back flag."""
    long = matches.select(id, time, F.explode(F.array(home, away)).alias("team_id"))
    days = days_of(long, ["team_id"], time)
    w = Window.partitionBy("team_id").orderBy(DAY)
    gap = days.withColumn("rest_days", F.datediff(F.col(DAY), F.lag(DAY).over(w)))
    out = attach(long, gap, ["team_id"], time)
    return out.withColumn("is_b2b", F.coalesce((F.col("rest_days") == 1).cast("int"), F.lit(0)))


def top_n_mean(df: DataFrame, keys: Sequence[str], rank_col: str, cols: Sequence[str], n: int = 12,
               tie: str = "player_id") -> DataFrame:
    """Mean of ``cols`` over the ``n`` rows of each key with the highest ``rank_col``."""
    w = Window.partitionBy(*keys).orderBy(F.col(rank_col).desc(), F.col(tie))
    top = df.where(F.col(rank_col).isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return top.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])
