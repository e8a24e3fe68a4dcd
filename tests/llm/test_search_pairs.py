"""Chunks and query blocks meet without a copy of either in a shuffle or in the driver."""

import numpy as np
import pytest

from daybefore.llm import one_bit_search


@pytest.fixture
def vectors(spark):
    x = np.random.default_rng(11).standard_normal((300, 16))
    return x, spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def test_nothing_is_broadcast_or_copied(spark, vectors):
    d = vectors[1]
    plan = one_bit_search.search(d, d.filter("vec_id % 50 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan


def test_best_over_many_chunks_and_blocks(spark, vectors, monkeypatch):
    x, d = vectors
    monkeypatch.setattr(one_bit_search, "CHUNK_ROWS", 7)
    monkeypatch.setattr(one_bit_search, "BLOCK_ROWS", 4)
    monkeypatch.setattr(one_bit_search, "HELD_ROWS", 60)
    got = one_bit_search.search(d, d.filter("vec_id % 10 = 0")).collect()
    assert len(got) == 150
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 10):
        s = unit @ unit[q]
        s[q] = -2
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [i for _, i, _ in mine] == list(np.argsort(-s)[:5])
        assert np.allclose([v for _, _, v in mine], np.sort(s)[::-1][:5])
