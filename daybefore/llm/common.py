"""Small helpers the operators share."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybefore.session import checkpoint_dir

#: Rows handed to a Python helper at once, so that long texts don't pile up.
SLICE = 512


def document_columns(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever else the table holds, and the row key as ``row`` if named; a null text counts as empty."""
    row = [F.col(row_col).cast("long").alias("row")] if row_col else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *row, F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """``mapInArrow`` in slices of bounded row count; ``make`` runs once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = fn(batch.slice(at, SLICE))
                if out is not None:
                    yield out
    return df.mapInArrow(run, schema)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def held_out(key: Column, folds: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == remainder, F.lit(True))


def stored(df: DataFrame, **options) -> DataFrame:
    """``df`` written to the shared checkpoint folder as Parquet, with the writer's ``options``, and read again.

    Cuts the lineage with columnar files that every executor can reach; they stay until the
    folder is cleaned, as checkpoints do.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
