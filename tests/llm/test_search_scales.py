"""Cosines of vectors of any finite size, ties, and too few candidates."""

import numpy as np
import pytest

from daybefore.llm import one_bit_search

SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1e-310, 1.0])
def test_scores_do_not_depend_on_length(spark, scale):
    x = np.random.default_rng(5).standard_normal((80, 8))
    d = spark.createDataFrame([(i, [float(c) * scale for c in v]) for i, v in enumerate(x)], SCHEMA)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = one_bit_search.search(d, d.filter("vec_id % 50 = 0")).collect()
    assert len(got) == 10
    for q in (0, 50):
        s = unit @ unit[q]
        s[q] = -2
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [i for _, i, _ in mine] == list(np.argsort(-s)[:5])
        assert [v for _, _, v in mine] == pytest.approx(sorted(s, reverse=True)[:5], abs=1e-12 if scale > 1e-300 else 1e-2)


def test_ties_and_few_candidates(spark):
    d = spark.createDataFrame([(0, [1e200, 1e200]), (3, [1e200, 9e199]), (2, [2.0, 2.0]), (1, [1.0, 1.0]), (7, [1.0]), (8, [float("inf"), 1.0])], SCHEMA)
    got = [(r["rank"], r["vec_id"]) for r in one_bit_search.search(d, d.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3)]
    assert one_bit_search.search(d.filter("vec_id = 0"), d.filter("vec_id = 0")).count() == 0
