"""Nearest neighbours through randomly rotated one-bit codes.

Vectors are brought to unit length, so cosine is an inner product, and taken relative to their mean.
Each residual is rotated by one random orthogonal matrix and kept as one sign bit per dimension
plus three scalars: its length, the inner product of its direction with its code, and its inner
product with the mean.  For a query the packed bits and the scalars give an unbiased estimate of
every inner product and a bound on its error that holds but with a tiny probability (about
exp(-EPSILON^2 / 2) per vector).  Only vectors whose upper bound reaches the k-th largest lower
bound of different ids are reranked on the original vectors in double precision.

The index covers every row and lives in chunks of bounded size; queries form blocks of bounded size.
Both are written, and each chunk meets each block once where a task reads some of both: neither is copied
through a shuffle or a broadcast, so no task or driver holds all of either.  A task keeps its k best per
query; one aggregation by query ends the search.

Edge rows: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, neither do rows without id; with fewer than k candidates all are
returned; ties go to the smaller id; all rows of an id, equal or not, are one candidate with their best
score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybefore.llm.common import stored

K = 5
#: Width of the error bound in standard deviations.
EPSILON = 3.0
CHUNK_ROWS, BLOCK_ROWS = 8192, 512
#: Bytes of vectors in a chunk at most, and of a row group of chunks.
CHUNK_BYTES, GROUP_BYTES = 1 << 22, 1 << 24
#: Rows found by a task before it drops those that aren't among the best.
HELD_ROWS = 500_000
SEED = 20240607


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits, and (residual length, direction . code, unit . center) per row."""
    rest = unit - center
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ turn.T
    agreement = np.abs(turned).sum(1) / np.sqrt(unit.shape[1])
    return np.packbits(turned > 0, axis=1), np.stack([length, agreement, unit @ center], axis=1)


def estimate(bits: np.ndarray, scalars: np.ndarray, queries: np.ndarray, center: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (query x row) and their error bounds."""
    size = queries.shape[1]
    rest = queries - center
    codes = (np.unpackbits(bits, axis=1, count=size).astype(np.float32) * 2 - 1) / np.sqrt(size, dtype=np.float32)
    length, agreement, to_center = scalars.T
    agreement = np.maximum(agreement, 1e-9)
    inner = (rest @ turn.T).astype(np.float32) @ codes.T
    guess = inner * (length / agreement) + (to_center[None, :] + (queries @ center)[:, None] - center @ center)
    spread = np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement / np.sqrt(max(size - 1, 1))
    return guess, epsilon * np.linalg.norm(rest, axis=1)[:, None] * (length * spread)[None, :] + 1e-5


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows by the power of two that brings their largest component below 1: exact, and squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _matrix(blob: bytes, size: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(blob, dtype=kind).reshape(-1, size)


def _by_id(ids: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Largest lower bound of each different id (query x id)."""
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
    return low if len(first) == len(ids) else np.maximum.reduceat(low[:, order], first, axis=1)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best different ids, each by its best row; ties go to the smaller id."""
    order = np.lexsort((ids, -score))
    first = np.unique(ids[order], return_index=True)[1]
    return order[np.sort(first)[:k]]


def _top(found: list[pd.DataFrame], k: int) -> list[pd.DataFrame]:
    """The ``k`` best different ids of each query, as one frame."""
    best = pd.concat(found).groupby(["query_id", "vec_id"], as_index=False)["score"].max().sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return [best.groupby("query_id").head(k)]


def _packed(rows: DataFrame, many: int, size: int) -> DataFrame:
    """Rows as (ids, vectors) blobs of at most ``many`` rows, within each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, many):
                part = batch.slice(at, many)
                ids = np.asarray(part.column("vec_id"), dtype=np.int64)
                v = np.asarray(part.column("v").flatten(), dtype=np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["ids", "vectors"])
    return rows.mapInArrow(run, "ids binary, vectors binary")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, epsilon: float = EPSILON, seed: int = SEED,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest rows of ``vectors`` for each row of ``queries``, itself excepted."""
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    result = "query_id long, vec_id long, score double"
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = sizes["size"] if sizes else 1
    rows, asked = rows.filter(F.size("v") == size), asked.filter(F.size("v") == size)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    means = rows.withColumn("norm", norm).filter((F.col("norm") > 0) & (F.col("norm") < float("inf"))).agg(*[F.avg(F.col("v")[i] / F.col("norm")) for i in range(size)]).first()
    center = np.array([x or 0.0 for x in means])
    turn = rotation(size, seed)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist()):
                bits, scalars = encode(_unit(_matrix(blob, size)), center, turn)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids, blob, bits.tobytes(), scalars.tobytes())], ["ids", "vectors", "bits", "scalars"])
    # a row holds megabytes: row groups are closed by size from the first row on
    narrow = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
    many = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (8 * size)))
    chunks = stored(_packed(rows, many, size).mapInArrow(index, "ids binary, vectors binary, bits binary, scalars binary"), **narrow)
    blocks = stored(_packed(asked.repartition(max(1, -(-asked.count() // BLOCK_ROWS))), BLOCK_ROWS, size).toDF("query_ids", "query_vectors"), **narrow)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, out, held = (size + 7) // 8, [], 0
        for batch in batches:
            for r in batch.to_pylist():
                ids, v = np.frombuffer(r["ids"], np.int64), _scaled(_matrix(r["vectors"], size))
                query_ids, q = np.frombuffer(r["query_ids"], np.int64), _matrix(r["query_vectors"], size)
                units, q = _unit(q), _scaled(q)
                guess, bound = estimate(_matrix(r["bits"], width, np.uint8), _matrix(r["scalars"], 3), units, center, turn, epsilon)
                own = query_ids[:, None] == ids[None, :]
                low = _by_id(ids, np.where(own, -np.inf, guess - bound))
                at = low.shape[1] - min(k, low.shape[1])
                needed = np.partition(low, at, axis=1)[:, at]
                mine = []
                for j in range(len(query_ids)):
                    near = np.flatnonzero((guess[j] + bound[j] >= needed[j]) & ~own[j])
                    if len(near):
                        w = v[near]
                        score = (w @ q[j]) / (np.sqrt((w * w).sum(1)) * np.sqrt((q[j] * q[j]).sum()))
                        best = _best(ids[near], score, k)
                        mine.append(pd.DataFrame({"query_id": query_ids[j], "vec_id": ids[near][best], "score": score[best]}))
                if mine:
                    out.append(pd.concat(mine))
                    held += len(out[-1])
                if held > HELD_ROWS:
                    out = _top(out, k)
                    if len(out[0]) > HELD_ROWS // 2:  # a task with many queries
                        yield pa.RecordBatch.from_pandas(out[0], preserve_index=False)
                        out = []
                    held = sum(map(len, out))
        if out:
            yield pa.RecordBatch.from_pandas(_top(out, k)[0], preserve_index=False)
    pairs = chunks.hint("shuffle_replicate_nl").crossJoin(blocks)
    found = pairs.mapInArrow(meet, result).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
