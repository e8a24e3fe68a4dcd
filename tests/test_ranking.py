"""Ranking, isotonic fits and score quality against plain single-machine forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybefore.functions import scores
from daybefore.operators import isotonic, metrics


def pooled(points):
    """Adjacent violators pooled one by one over (score, weight, label) points."""
    sums = {}
    for x, w, y in points:
        a = sums.setdefault(x, [0.0, 0.0])
        a[0] += w
        a[1] += w * y
    blocks = []
    for x in sorted(sums):
        blocks.append([x, x, *sums[x]])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            _, hi, w, t = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = hi, blocks[-1][2] + w, blocks[-1][3] + t
    return [(lo, hi, w, t / w) for lo, hi, w, t in blocks]


def _points(kind):
    r = random.Random(4)
    x = {"rising": lambda i: i, "falling": lambda i: -i, "ties": lambda i: r.choice([0.1, 0.5, 0.5, 0.5, 0.9]), "wide": lambda i: r.gauss(0, 1e9)}[kind]
    return [(float(x(i)), r.choice([1.0, 1.0, 1000.0, 0.25]), float(r.random() < (0.2 + 0.6 * i / 900))) for i in range(900)]


@pytest.mark.parametrize("kind", ["rising", "falling", "ties", "wide"])
def test_isotonic_blocks_equal_plain_pooling(spark, kind):
    groups = {g: _points(kind)[:600 + 100 * g] for g in range(3)}
    df = spark.createDataFrame([(g, *p) for g, points in groups.items() for p in points], "g int, x double, w double, y double")
    noise = spark.createDataFrame([(0, None, 1.0, 1.0), (0, 5.0, 0.0, 1.0), (0, 5.0, 1.0, None), (0, float("nan"), 1.0, 1.0)], df.schema)
    got = isotonic.isotonic_blocks(df.unionByName(noise).repartition(7), "x", "y", "w", ["g"]).collect()
    for g, points in groups.items():
        mine = sorted((r["lo"], r["hi"], r["weight"], r["value"]) for r in got if r["g"] == g)
        want = pooled(points)
        assert [(a, b) for a, b, _, _ in mine] == [(a, b) for a, b, _, _ in want]
        assert np.allclose([m[2:] for m in mine], [w[2:] for w in want], rtol=1e-12, atol=1e-12)


def test_isotonic_function(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0), (4.0, 1)], "x double, y int")
    fit = isotonic.fit_isotonic(df, "x", "y")
    assert (fit.at, fit.values) == ([1.0, 2.0, 3.0, 4.0], [0.0, 0.5, 0.5, 1.0])
    again = isotonic.Isotonic.loads(fit.dumps())
    asked = spark.createDataFrame([(0.0,), (1.5,), (2.5,), (3.5,), (9.0,), (None,)], "x double")
    assert [r[0] for r in asked.select(again.apply(F.col("x"))).collect()] == [0.0, 0.25, 0.5, 0.75, 1.0, None]


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e9, -4e8), (1e-12, 0.5), (-3.0, 2.0)])
def test_auc_of_any_range(spark, scale, shift):
    r = random.Random(2)
    rows = [(g, (0.0 if r.random() < 0.9 else r.gauss(0, 1)) * scale + shift, int(r.random() < 0.4)) for g in (0, 1) for _ in range(700)]
    rows += [(2, 1.0, 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    got = {x["g"]: x["roc_auc"] for x in metrics.auc(df, "s", "y", ["g"]).collect()}
    for g in (0, 1):
        pos = [s for h, s, y in rows if h == g and y]
        neg = [s for h, s, y in rows if h == g and not y]
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
        assert got[g] == pytest.approx(want, abs=1e-12)
    assert got[2] is None and 3 not in got
    whole = metrics.auc(df.where("g = 1"), "s", "y").first()["roc_auc"]
    assert whole == pytest.approx(got[1], abs=1e-12)


def test_score_quality_equals_the_grid(spark):
    rows = [(i, 0.2 + i % 7, 0.3 + i % 5, 0.1 * (i % 3), i % 9, i % 4) for i in range(60)] + [(90, None, 1.0, 0.0, 1, 1), (91, 1.0, 1.0, 0.0, None, 1), (92, 2.0, 1.0, 0.0, 40, 0)]
    df = spark.createDataFrame(rows, "id int, lambda_home double, lambda_away double, lambda3 double, hs int, a int")
    got = {r["id"]: r for r in scores.score_quality(df, "hs", "a").collect()}
    for r in scores.score_distribution(df, "lambda_home", "lambda_away", "lambda3").collect():
        if r["grid"] is None or r["hs"] is None:
            assert got[r["id"]]["rps"] is None and got[r["id"]]["exact_hit"] is None
            continue
        g, actual = np.array(r["grid"]).reshape(11, 11), max(-10, min(10, r["hs"] - r["a"]))
        cdf = np.cumsum([np.trace(g, -d) for d in range(-10, 11)])
        want = sum((c / cdf[-1] - (actual <= d)) ** 2 for c, d in zip(cdf, range(-10, 11))) / 20
        assert got[r["id"]]["rps"] == pytest.approx(want, abs=1e-12)
        assert got[r["id"]]["exact_hit"] == float((r["most_likely_home"], r["most_likely_away"]) == (r["hs"], r["a"]))
