"""Search over tables in which the rows of an id stand several times."""

import numpy as np
import pytest

from daybefore.llm import one_bit_search


@pytest.mark.parametrize("kind", ["equal rows", "several vectors"])
def test_repeated_rows_are_one_candidate(spark, kind):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((60, 16)), 5, axis=0)
    if kind == "several vectors":
        x = x + 0.05 * rng.standard_normal(x.shape)
    ids = np.repeat(np.arange(60), 5)
    mixed = rng.permutation(len(ids))
    d = spark.createDataFrame([(int(ids[i]), [float(y) for y in x[i]]) for i in mixed], "vec_id long, embedding array<double>").coalesce(1)
    got = one_bit_search.search(d, d.filter("vec_id % 20 = 0")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 60, 20):
        scores = (unit @ unit[ids == q].T).max(axis=1).reshape(60, 5).max(axis=1)
        scores[q] = -2
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[1] for r in mine] == np.argsort(-scores)[:5].tolist()
        assert np.allclose([r[2] for r in mine], np.sort(scores)[::-1][:5])
