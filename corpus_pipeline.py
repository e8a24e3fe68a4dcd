"""A training corpus from raw documents: five stages, each over all that the one before kept.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next one's ``docs``.  All but the last return the columns of
``documents``.

Every row gets its own decision: rows are told apart by a 64-bit digest of all their columns, so
rows without id, or with an id that stands several times, neither share nor escape one.  Rows that agree in
all columns are one row from the n-gram stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybefore.llm import decontaminate, line_dedup, ngram_join, quality, sentencepiece_bpe
from daybefore.llm.common import stored
from daybefore.llm.queries import MODEL_PATH, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, a digest of all columns that tells nulls apart from what they stand beside."""
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]).alias("row"))


def _kept(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row`` isn't in ``rejected``."""
    return docs.join(rejected.select("row").distinct(), "row", "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of low quality go."""
    docs = _keyed(docs)
    scored = quality.score(docs, table(spark, sf_dir, "labels"), row_col="row")
    return _kept(docs, scored.filter(F.col("predicted") == 0)).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in their first document only; documents left without any line go."""
    cleaned = line_dedup.dedup_lines(docs, carry=["lang", "source"])
    return (cleaned.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
            .withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays (rows without id come last, ties go to the smaller digest), of equal rows one."""
    docs = _keyed(docs)
    groups = ngram_join.components(docs, id_col="row").select(F.col("doc_id").alias("row"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").cast("long").alias("id"), "row")
    first = (docs.select("row", "doc_id").distinct().join(groups, "row").groupBy("component_id").agg(F.min(order).alias("first"))
             .select(F.col("first.row").alias("row")))
    return docs.dropDuplicates(["row"]).join(first, "row", "left_semi").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    docs = _keyed(docs)
    return _kept(docs, decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), row_col="row").filter("contaminated")).select(*COLUMNS)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining document and the text decoded from them."""
    return sentencepiece_bpe.encode(docs, MODEL_PATH).withColumn("n_tokens", F.size("ids").cast("long")).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: The classifier's floating-point model and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return stored(STAGES[-1][1](spark, docs, sf_dir))
