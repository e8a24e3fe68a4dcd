"""Rows with null and repeated ids get a decision each in the n-gram stage."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_only_true_repeats_go(spark):
    texts = [(None, "a b c d e f g"), (None, "h i j k l m n"), (None, ""), (7, "o p q r s t u"), (7, "v w x y z a b"), (8, "o p q r s t u"), (7, "o p q r s t u"), (None, "a b c d e f g")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], SCHEMA)
    got = corpus_pipeline.ngram_jaccard_join(spark, docs, "").collect()
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, texts[:5]))


def test_equal_looking_nulls_are_different_rows(spark):
    rows = [(1, "", "x", None, 0), (1, "", None, "x", 0), (1, "", "x", None, 0)]
    assert corpus_pipeline._keyed(spark.createDataFrame(rows, SCHEMA)).select("row").distinct().count() == 2
