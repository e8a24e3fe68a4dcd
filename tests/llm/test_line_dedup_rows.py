"""Rows without id, and lines whose spread the sketch alone decides."""

from daybefore.llm import line_dedup

SCHEMA = "doc_id long, text string, source string"


def test_rows_without_id_never_keep(spark):
    rows = [(None, f"own {i}\nshared", f"s{i}") for i in range(6)] + [(None, "own 0\nshared", "s0"), (7, "mine\nshared", "s7"), (8, "other\nshared", "s8")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), min_sites=5).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_removed"]) for r in out) == sorted(
        [("None", f"own {i}", 1) for i in (0, 0, 1, 2, 3, 4, 5)] + [("7", "mine\nshared", 0), ("8", "other", 1)])
    nameless = line_dedup.dedup_lines(spark.createDataFrame(rows[:6], SCHEMA), min_sites=5).collect()
    assert all(r["n_removed"] == 1 for r in nameless)


def test_far_above_the_threshold_the_sketch_decides(spark):
    lines = spark.range(40_000).selectExpr("id AS doc_id", "concat('s', id % 9000) AS site", "cast(concat('k', id % 2) AS binary) AS key")
    few = spark.range(12_000).selectExpr("id AS doc_id", "concat('s', id % 400) AS site", "cast('near' AS binary) AS key")
    narrow = spark.range(12_000).selectExpr("id AS doc_id", "concat('s', id % 300) AS site", "cast('below' AS binary) AS key")
    got = {bytes(r["key"]): r["keeper"] for r in line_dedup.spread_lines(lines.union(few).union(narrow), 400).collect()}
    assert got == {b"k0": 0, b"k1": 1, b"near": 0}
