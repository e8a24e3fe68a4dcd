"""Edge rows, brute force on small tables, and invariants."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from daybefore.functions import market as MK
from daybefore.functions import scalars as S
from daybefore.functions import scores
from daybefore.operators import asof, market, metrics, pairs, prefix, rating, rolling
from daybefore.sources import scans, store

D = datetime.date


def day(i):
    return D(2024, 1, 1) + datetime.timedelta(days=i)


@pytest.fixture(scope="module")
def stats(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        v = rng.choice([None, float("nan"), 0.0, rng.random() * 10, rng.random() * 10])
        rows.append((i, rng.randrange(4), day(rng.randrange(40)), v, rng.choice([None, 0.0, 3.0, 5.0])))
    return rows, spark.createDataFrame(rows, "id long, e long, d date, x double, n double").cache()


def brute_prior(rows, e, d, n=10):
    return sorted((r for r in rows if r[1] == e and r[2] < d), key=lambda r: (r[2], r[0]))[-n:]


def clean(vals):
    return [v for v in vals if v is not None and not math.isnan(v)]


def test_rolling_mean_is_strictly_before_the_date(stats):
    rows, df = stats
    got = {r["id"]: r["rolling_x"] for r in rolling.rolling_mean_prior(df, "e", "d", "id", ["x"]).collect()}
    assert len(got) == len(rows)
    for r in rows:
        vals = clean([p[3] for p in brute_prior(rows, r[1], r[2])])
        want = sum(vals) / len(vals) if len(vals) >= 3 else None
        assert got[r[0]] == (pytest.approx(want, abs=1e-9) if want is not None else None)


def test_ratio_needs_three_of_both_and_a_denominator(stats):
    rows, df = stats
    got = {r["id"]: r["rate"] for r in rolling.rolling_ratio_prior(df, "e", "d", "id", "x", "n").collect()}
    for r in rows:
        prior = brute_prior(rows, r[1], r[2])
        num, den = clean([p[3] for p in prior]), clean([p[4] for p in prior])
        ok = len(num) >= 3 and len(den) >= 3 and sum(den) != 0
        assert got[r[0]] == (pytest.approx(sum(num) / sum(den), abs=1e-9) if ok else None)


def test_request_form_equals_batch_form_and_ignores_the_future(spark, stats):
    rows, df = stats
    batch = {r["id"]: r["rolling_x"] for r in rolling.rolling_mean_prior(df, "e", "d", "id", ["x"]).collect()}
    spine = df.select("id", "e", "d")
    late = spark.createDataFrame([(9999, 1, day(60), 1000.0, 1.0)], df.schema)
    asked = rolling.rolling_as_of(spine, df.unionByName(late), "e", "d", "id", ["x"]).collect()
    assert {r["id"]: r["rolling_x"] for r in asked} == pytest.approx(batch, nan_ok=True)


def test_asof_strict_and_inclusive_on_the_same_day(spark):
    left = spark.createDataFrame([(1, day(5)), (1, day(6)), (2, day(5)), (None, day(5))], "k long, d date")
    snap = spark.createDataFrame([(1, day(5), 1.0), (1, day(3), 2.0)], "k long, s date, v double")
    strict = {(r["k"], r["d"]): r["v"] for r in asof.asof_join(left, snap, ["k"], "d", "s", ["v"]).collect()}
    incl = {(r["k"], r["d"]): r["v"] for r in asof.asof_join(left, snap, ["k"], "d", "s", ["v"], True).collect()}
    assert strict == {(1, day(5)): 2.0, (1, day(6)): 1.0, (2, day(5)): None, (None, day(5)): None}
    assert incl[(1, day(5))] == 1.0


@pytest.fixture(scope="module")
def matches(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        h = rng.randrange(5)
        rows.append((i, day(rng.randrange(60)), rng.randrange(2), h, (h + 1 + rng.randrange(4)) % 5,
                     rng.randrange(5), rng.randrange(5)))
    return rows, spark.createDataFrame(
        rows, "match_id long, match_date date, season long, home_id long, away_id long, home_score int, away_score int").cache()


def brute_elo(rows):
    out = {}
    for s in {r[2] for r in rows}:
        cur, start, on = {}, {}, {}
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: (r[1], r[0])):
            h, a = r[3], r[4]
            for t in (h, a):
                if on.get(t) != r[1]:
                    start[t], on[t] = cur.get(t, 1500.0), r[1]
            out[r[0]] = (start[h], start[a])
            rh, ra = cur.get(h, 1500.0), cur.get(a, 1500.0)
            e = 1 / (1 + 10 ** ((ra - rh - 50) / 400))
            y = 1 if r[5] > r[6] else 0
            cur[h], cur[a] = rh + 5 * (y - e), ra + 5 * ((1 - y) - (1 - e))
    return out


@pytest.mark.parametrize("passes", [6, 1])
def test_rating_by_passes(matches, passes):
    rows, df = matches
    want = brute_elo(rows)
    got = {r["match_id"]: (r["home_elo"], r["away_elo"]) for r in rating.elo(df, passes=passes).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_rating_of_many_matches_equals_the_row_fold(spark):
    """10,000 matches of skewed teams in two leagues' seasons, ids shared between them, null dates left out."""
    rng, rows, ratings, want = random.Random(3), [], {}, {}
    for n in range(10_000):
        h = 0 if rng.random() < .3 else rng.randrange(40)
        rows.append((n // 2, None if n % 997 == 5 else day(n // 60), n % 2, h, (h + 1 + rng.randrange(39)) % 40, rng.randrange(5), rng.randrange(5)))
    for i, d, s, h, a, hs, as_ in sorted((r for r in rows if r[1]), key=lambda r: (r[2], r[1], r[0])):
        rh, ra = ratings.get((s, h), 1500.0), ratings.get((s, a), 1500.0)
        want[s, i] = (rh, ra)
        up = 5 * ((hs > as_) - 1 / (1 + 10 ** ((ra - rh - 50) / 400)))
        ratings[s, h], ratings[s, a] = rh + up, ra - up
    df = spark.createDataFrame(rows, "match_id long, match_date date, season long, home_id long, away_id long, home_score int, away_score int")
    out = rating.elo(df, same_day="rows").collect()
    assert len(out) == len(rows)
    for r in out:
        seen = (r["home_elo"], r["away_elo"])
        assert seen == (None, None) if r["match_date"] is None else seen == pytest.approx(want[r["season"], r["match_id"]], abs=1e-9)


@pytest.mark.parametrize("same_day", ["rows", "date"])
def test_rating_in_pieces_equals_one_piece(spark, same_day):
    """Long dense seasons, a season without name, a team without name, matches without teams, days longer than a piece."""
    rng, rows = random.Random(5), []
    for n in range(4_000):
        h = rng.randrange(6)
        rows.append((n, day(n // 900), None if n % 3 == 0 else n % 3, None if h == 5 else h, None if h == 5 and n % 2 else (h + 1 + rng.randrange(4)) % 5, rng.randrange(5), rng.randrange(5)))
    df = spark.createDataFrame(rows, "match_id long, match_date date, season long, home_id long, away_id long, home_score int, away_score int")
    whole = {r["match_id"]: (r["home_elo"], r["away_elo"]) for r in rating.elo(df, same_day=same_day).collect()}
    cut = {r["match_id"]: (r["home_elo"], r["away_elo"]) for r in rating.elo(df, same_day=same_day, window=150, passes=1).collect()}
    assert whole.keys() == cut.keys() == set(range(4_000))
    assert all(None not in whole[i] and cut[i] == pytest.approx(whole[i], abs=1e-9) for i in whole)


def test_a_piece_is_folded_in_a_few_microseconds_a_match():
    """Before, tuples by team and Arrow scalars took 8 to 10 microseconds a match where lists by team number take about 2."""
    import time
    import numpy as np
    import pyarrow as pa
    rng, n = np.random.default_rng(1), 200_000
    h = rng.integers(0, 32, n)
    part = pa.table({"_w": pa.array(np.zeros(n), pa.int32()), "season": np.full(n, 1995), "_d": np.sort(rng.integers(0, 360, n)), "_id": np.arange(n),
                     "_h": h, "_a": (h + 1 + rng.integers(0, 31, n)) % 32, "_y": pa.array(rng.integers(0, 2, n), pa.int32())})
    none = pa.table({c: pa.array([], pa.float64() if c in ("_rating", "_at", "_other") else pa.int64()) for c in ("_w", "season", "_team", *rating._STATE)})
    key = (pa.scalar(0, pa.int32()), pa.scalar(1995))
    begun = time.perf_counter()
    ends, steps = (rating._fold(["season"], 5.0, 50.0, 1500.0, e)(key, part, none) for e in (True, False))
    assert time.perf_counter() - begun < 2 * n * 4.5e-6
    assert (ends.num_rows, steps.num_rows) == (32, n)
    last = {t: r for h, a, x, y in zip(*(steps.column(c).to_pylist() for c in ("_h", "_a", "_home_after", "_away_after"))) for t, r in ((h, x), (a, y))}
    assert dict(zip(ends.column("_team").to_pylist(), ends.column("_rating").to_pylist())) == last


def test_head_to_head_counts_every_earlier_meeting(matches):
    rows, df = matches
    for r in pairs.head_to_head(df, df).collect():
        met = [m for m in rows if m[1] < r["match_date"] and {m[3], m[4]} == {r["home_id"], r["away_id"]}]
        wins = sum((m[5] > m[6]) if m[3] == r["home_id"] else (m[6] > m[5]) for m in met)
        assert (r["h2h_n"], r["h2h_home_wins"]) == (len(met), wins)
        assert r["h2h_home_win_pctg"] == (wins / len(met) if met else None)


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_series_state_does_not_depend_on_the_block(matches, block):
    rows, df = matches
    for r in pairs.series_state(df, block=block).collect():
        key = (r["match_date"], r["match_id"])
        met = [m for m in rows if (m[1], m[0]) < key and m[2] == r["season"] and {m[3], m[4]} == {r["home_id"], r["away_id"]}]
        wins = sum((m[5] > m[6]) == (m[3] == r["home_id"]) for m in met)
        assert (r["series_game_number"], r["home_series_wins"], r["away_series_wins"]) == (len(met) + 1, wins, len(met) - wins)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_lag_in_blocks_is_lag(spark, block):
    df = spark.createDataFrame([(i % 2, i * 5, f"v{i}" if i % 3 else None) for i in range(30)], "g long, o long, v string")
    got = {r["o"]: r["p"] for r in prefix.lag_in_blocks(df, "g", "o", "v", "p", block).collect()}
    for g in (0, 1):
        seq = [(i * 5, f"v{i}" if i % 3 else None) for i in range(30) if i % 2 == g]
        for (_, pv), (o, _) in zip([(None, None), *seq], seq):
            assert got[o] == pv


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (1.0, 0), (0.0, 1)], "p double, y int")
    ps, ns = [0.4, 0.8, 0.0], [0.1, 0.4, 1.0]
    want = sum((a > b) + 0.5 * (a == b) for a in ps for b in ns) / 9
    assert metrics.auc(df, "p", "y").first()[0] == pytest.approx(want)


def test_calibration_uses_the_floating_edges(spark):
    df = spark.createDataFrame([(p, 1) for p in (0.0, 0.2, 0.3, 0.6, 0.7, 1.0)], "p double, y int")
    five = {r["bin"]: r["n"] for r in metrics.calibration(df, "p", "y", 5).collect()}
    assert five == {0: 1, 1: 2, 2: 1, 3: 1, 4: 1}  # 0.6 is below 3 * 0.2


def test_lowest_threshold_wins_ties(spark):
    df = spark.createDataFrame([(0.2, 0), (0.9, 1)], "p double, y int")
    r = metrics.best_threshold(df, "p", "y").first()
    assert (r["threshold"], r["accuracy"]) == (pytest.approx(0.30), 1.0)


@pytest.mark.parametrize("rates", [(3.1, 2.7, 0.35), (2.9, 2.4, 0.2), (2.6, 2.2, 0.0), (1.0, 1.0, 9.0)])
def test_score_distribution(spark, rates):
    df = spark.createDataFrame([rates], "h double, a double, s double")
    r = scores.score_distribution(df, "h", "a", "s").first()
    assert min(r["grid"]) >= 0 and sum(r["grid"]) == pytest.approx(1.0)
    assert r["p_home_win"] + r["p_away_win"] + r["p_tie"] == pytest.approx(1.0)
    if rates[2] == 0.0:
        def pmf(m):
            v = [math.exp(-m) * m ** k / math.factorial(k) for k in range(11)]
            return [x / sum(v) for x in v]
        want = [x * y for x in pmf(rates[0]) for y in pmf(rates[1])]
        assert r["grid"] == pytest.approx(want, abs=1e-12)


def test_series_probability_symmetry_and_closed_form(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.57, 0.43), (1.0, 0.0)], "a double, b double")
    even, skew, sure = scores.series_probability(df, "a", "b").collect()
    assert even["p_a_wins"] == pytest.approx(0.5)
    p = 0.57
    assert skew["p_a_wins"] == pytest.approx(sum(math.comb(3 + k, k) * p ** 4 * (1 - p) ** k for k in range(4)))
    assert (sure["p_a_wins"], sure["p_len_4"], sure["expected_games"]) == (1.0, 1.0, 4.0)
    assert sum(skew[f"p_len_{g}"] for g in (4, 5, 6, 7)) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        scores.series_probability(df, "a", "b", "AAB")


def test_odds_edges(spark):
    q = spark.createDataFrame([
        (1, day(0), "Opening", 1, 100, -100), (1, day(1), None, 2, 0, -150), (2, day(0), "odd", 3, -200, 150),
        (2, day(0), "closing", 4, -110, -110), (3, day(0), "opening", 5, None, 120)],
        "game_id long, date date, snapshot_type string, quote_id long, home_moneyline int, away_moneyline int")
    got = {r["game_id"]: r for r in market.normalize_odds(q, "quote_id").collect()}
    assert got[1]["opening_home_prob"] == pytest.approx(0.5) and got[1]["date"] == day(0)
    assert got[1]["closing_home_prob"] is None and got[1]["closing_away_prob"] == pytest.approx(0.6)
    assert got[2]["closing_home_prob"] == pytest.approx(0.5) and got[2]["opening_home_prob"] is None
    assert got[3]["opening_home_prob"] is None and got[3]["opening_away_prob"] == pytest.approx(100 / 220)
    assert all(r["provider"] == "unknown" for r in got.values())


def test_row_scores_are_null_without_outcome(spark):
    df = spark.createDataFrame([(0.5, None), (1.0, 0)], "p double, y int")
    a, b = df.select(MK.row_log_loss(F.col("p"), F.col("y")).alias("l"), MK.row_brier(F.col("p"), F.col("y")).alias("b")).collect()
    assert a["l"] is None and a["b"] is None
    assert b["l"] == pytest.approx(-math.log(1e-9), rel=1e-6) and b["b"] == 1.0


def test_upsert_is_idempotent_and_last_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x", 1, 1.0), (1, "x", 2, 2.0), (2, "y", 1, 3.0)], "k long, part string, v int, p double")
    b = spark.createDataFrame([(1, "x", 3, 9.0), (3, "x", 1, 4.0)], a.schema)
    assert store.upsert(path, a, ["k"], ["v"], "part", dry_run=True) == 2
    assert store.upsert(path, a, ["k"], ["v"], "part") == 2
    for _ in range(2):
        assert store.upsert(path, b, ["k"], ["v"], "part") == 2
        assert {r["k"]: r["p"] for r in store.read(spark, path).collect()} == {1: 9.0, 2: 3.0, 3: 4.0}


def test_scalars(spark):
    df = spark.createDataFrame([("12:34", 0.0, None), (None, 2.0, 5.0), ("bad", None, 1.0)], "t string, x double, y double")
    rows = df.select(S.clock_seconds("t"), S.or_default("x", 0.5), S.bayes_mean(F.col("x"), F.col("y"), 0, 0)).collect()
    assert [tuple(r) for r in rows] == [(754.0, 0.5, 0.0), (0.0, 2.0, 5.0), (0.0, 0.5, 1.0)]
    d = spark.createDataFrame([(D(2023, 10, 1),), (D(2024, 9, 30),)], "d date").select(S.season_of("d").alias("s"))
    assert [r["s"] for r in d.collect()] == [20232024, 20232024]
    assert d.select(S.previous_season("s"), S.bracket_year("s")).first() == (20222023, 2024)
    with pytest.raises(ValueError):
        S.missing_counts(df, ["nope"])
    with pytest.raises(ValueError):
        scans.date_range(spark, day(2), day(1))
