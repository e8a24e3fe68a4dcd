"""Joint score distribution from two rates and a shared covariance term."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EPS = 1e-9
MAX_GOALS = 10


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Written as a one-element transform: a plain column used inside a lambda would be inlined
    there by the optimizer and computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _terms(rate: Column, n: int) -> Column:
    """rate^k / k! for k = 0..n."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.pow(rate, k) / F.factorial(k).cast("double"))


def poisson_pmf(rate: Column, max_goals: int = MAX_GOALS) -> Column:
    """Poisson mass on 0..max_goals, renormalised over that range."""
    terms = _terms(F.greatest(rate.cast("double"), F.lit(EPS)), max_goals)
    return let(terms, lambda t: let(_total(t), lambda z: F.transform(t, lambda v: v / z)))


_DIST = ("grid array<double>, p_home_win double, p_away_win double, p_tie double, expected_home double, "
         "expected_away double, top int")


def _cells(h: np.ndarray, a: np.ndarray, s: np.ndarray, max_goals: int) -> tuple[np.ndarray, np.ndarray]:
    """Joint mass per row, flat and home-major, and which rows lack a rate.

    Rows of the grid follow from each other: ``i P(i,j) = r1 P(i-1,j) + r3 P(i-1,j-1)``.
    """
    n = max_goals + 1
    missing = np.isnan(h) | np.isnan(a) | np.isnan(s)
    h, a = np.maximum(h, EPS), np.maximum(a, EPS)
    s = np.minimum(np.maximum(s, 0.0), np.maximum(np.minimum(h, a) - EPS, 0.0))
    s = np.where(s <= EPS, 0.0, s)
    r1, r2 = np.maximum(h - s, EPS), np.maximum(a - s, EPS)
    g = np.zeros((len(h), n, n))
    g[:, 0, 0] = np.exp(-(r1 + r2 + s))
    for j in range(1, n):
        g[:, 0, j] = g[:, 0, j - 1] * r2 / j
    for i in range(1, n):
        g[:, i, :] = r1[:, None] * g[:, i - 1, :]
        g[:, i, 1:] += s[:, None] * g[:, i - 1, :-1]
        g[:, i, :] /= i
    total = g.sum(axis=(1, 2))
    empty = ~(total > 0) & ~missing
    g[empty] = 0.0
    g[empty, 0, 0] = 1.0
    g /= np.where(total > 0, total, 1.0)[:, None, None]
    return g.reshape(len(h), n * n), missing


def _distribution(max_goals: int):
    """Vectorised over an Arrow batch: one numpy row per input row."""
    n = max_goals + 1

    def run(lh: pa.Array, la: pa.Array, l3: pa.Array) -> pa.Array:
        flat, missing = _cells(*(x.to_numpy(zero_copy_only=False) for x in (lh, la, l3)), max_goals)
        i, j = (x.ravel() for x in np.indices((n, n)))
        read = flat @ np.stack([i > j, i < j, i == j, i, j], axis=1).astype("float64")
        at = pa.array(np.arange(len(flat) + 1, dtype="int32") * (n * n))
        grid = pa.ListArray.from_arrays(at, pa.array(flat.ravel()), mask=pa.array(missing))
        top = flat.argmax(axis=1).astype("int32") if len(flat) else np.zeros(0, "int32")
        parts = [grid, *(pa.array(c, mask=missing) for c in np.ascontiguousarray(read.T)), pa.array(top, mask=missing)]
        return pa.StructArray.from_arrays(parts, [c.split()[0] for c in _DIST.split(", ")])
    return F.arrow_udf(run, _DIST)


def score_distribution(df: DataFrame, lh: str, la: str, l3: str, max_goals: int = MAX_GOALS) -> DataFrame:
    """Add the joint grid and everything read off it.

    ``grid`` is flat and home-major: cell ``i * (max_goals + 1) + j`` is P(home=i, away=j).  No
    shuffle.  The grid is an Arrow-batched numpy function: nested higher-order functions took
    0.6 ms a row here, and the same arithmetic as plain columns is copied once per use
    whenever a filter on a result is pushed down through it.
    """
    n = max_goals + 1
    rate_h, rate_a = F.col(lh).cast("double"), F.col(la).cast("double")
    out = df.withColumn("_d", _distribution(max_goals)(rate_h, rate_a, F.col(l3).cast("double")))
    both = rate_h + rate_a
    home_share = F.when(both <= 0, F.lit(0.5)).otherwise(rate_h / F.when(both > 0, both))
    final = F.col("_d.p_home_win") + F.col("_d.p_tie") * home_share
    names = ["grid", "p_home_win", "p_away_win", "p_tie", "expected_home", "expected_away"]
    return out.select(
        *df.columns, *[F.col(f"_d.{c}").alias(c) for c in names],
        F.greatest(F.least(final, F.lit(1.0)), F.lit(0.0)).alias("p_final_home"),
        (F.col("_d.top") / n).cast("int").alias("most_likely_home"),
        (F.col("_d.top") % n).cast("int").alias("most_likely_away"))


def _quality(max_goals: int):
    """Ranked probability score and exact hit from rates and result; the grid stays in the batch."""
    n = max_goals + 1

    def run(lh: pd.Series, la: pd.Series, l3: pd.Series, hs: pd.Series, as_: pd.Series) -> pd.DataFrame:
        flat, missing = _cells(*(x.to_numpy(dtype="float64", na_value=np.nan) for x in (lh, la, l3)), max_goals)
        i, j = (x.ravel() for x in np.indices((n, n)))
        diffs = np.arange(-max_goals, max_goals + 1)
        upto = flat @ ((i - j)[:, None] <= diffs).astype("float64")  # mass up to each goal difference
        home, away = (x.to_numpy(dtype="float64", na_value=np.nan) for x in (hs, as_))
        missing = missing | np.isnan(home) | np.isnan(away)
        actual = np.clip(np.where(missing, 0.0, home - away), -max_goals, max_goals)
        gap = upto / np.maximum(upto[:, -1:], 1e-12) - (actual[:, None] <= diffs)
        top = flat.argmax(axis=1) if len(flat) else np.zeros(0, int)
        hit = (top // n == home) & (top % n == away)
        return pd.DataFrame({"rps": np.where(missing, np.nan, (gap * gap).sum(axis=1) / (2.0 * max_goals)),
                             "exact_hit": np.where(missing, np.nan, hit.astype("float64"))})  # NaN becomes NULL
    return F.pandas_udf(run, "rps double, exact_hit double")


def score_quality(df: DataFrame, home_score: str, away_score: str, max_goals: int = MAX_GOALS,
                  rates: tuple[str, str, str] = ("lambda_home", "lambda_away", "lambda3")) -> DataFrame:
    """Add ``rps`` (ranked probability score of the goal difference) and ``exact_hit``, from the rates; NULL without rates or result."""
    rows = df.withColumn("_q", _quality(max_goals)(*[F.col(c).cast("double") for c in rates], F.col(home_score).cast("int"), F.col(away_score).cast("int")))
    return rows.select(*df.columns, F.col("_q.rps").alias("rps"), F.col("_q.exact_hit").alias("exact_hit"))


def series_probability(df: DataFrame, p_home_a: str, p_home_b: str, pattern: str = "AABBABA",
                       wins_needed: int = 4) -> DataFrame:
    """Exact best-of-n outcome by the (wins, losses) recursion, unrolled over the games.

    ``p_home_a`` is the home side's win chance when A hosts, ``p_home_b`` when B hosts.
    State ``_w{w}`` after g games is the mass of live series with w wins for A.
    """
    pattern = pattern.upper()
    if len(pattern) != 2 * wins_needed - 1 or set(pattern) - {"A", "B"}:
        raise ValueError(f"host pattern must be {2 * wins_needed - 1} letters A or B")
    a_home, b_home = F.col(p_home_a).cast("double"), F.col(p_home_b).cast("double")
    ok = a_home.between(0.0, 1.0) & b_home.between(0.0, 1.0)
    out = df.withColumns({"_pa": F.when(ok, a_home), "_pb": F.when(ok, 1.0 - b_home),
                          "p_a_wins": F.lit(0.0), "_w0": F.lit(1.0)})
    live = {0}
    for g, host in enumerate(pattern, start=1):
        p = F.col("_pa") if host == "A" else F.col("_pb")
        nxt: dict[int, Column] = {}
        won, lost = F.lit(0.0), F.lit(0.0)
        for w in sorted(live):
            m = F.col(f"_w{w}")
            losses = g - 1 - w
            up, down = m * p, m * (1.0 - p)
            if w + 1 == wins_needed:
                won = won + up
            else:
                nxt[w + 1] = nxt.get(w + 1, F.lit(0.0)) + up
            if losses + 1 == wins_needed:
                lost = lost + down
            else:
                nxt[w] = nxt.get(w, F.lit(0.0)) + down
        cols = {f"_w{w}": c for w, c in nxt.items()}
        cols["p_a_wins"] = F.col("p_a_wins") + won
        if g >= wins_needed:
            cols[f"p_len_{g}"] = won + lost
        out = out.withColumns(cols)
        live = set(nxt)
    lengths = range(wins_needed, 2 * wins_needed)
    expected = sum((F.col(f"p_len_{g}") * float(g) for g in lengths), F.lit(0.0))
    out = out.withColumn("expected_games", expected)
    out = out.withColumn("p_a_wins", F.when(F.col("_pa").isNotNull(), F.col("p_a_wins")))
    return out.drop("_pa", "_pb", *[f"_w{w}" for w in range(wins_needed)])
