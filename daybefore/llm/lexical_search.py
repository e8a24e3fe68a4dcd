"""Ranked lexical search: one automaton of all item terms counts them straight from each text.

No index of the documents is built.  The terms of the asked items, each guarded by a blank on
both sides, form one Aho-Corasick automaton; a normalised text runs through it once, and what it
reports are term numbers, counted per document.  Those few counts are written once; from
them come the corpus figures (documents, terms, document frequencies) and, once these are known, the
scores: every term number leads to the items that hold it.  Each task keeps only its best ``k``
documents per item, so the pairs of document and item never leave the task.

Items are dealt into shards of a bounded size (``shard_chars``), worked off one after the other: the
driver and a task hold one shard, however many items are asked.

Edge rows: null and empty texts have no terms, count neither for ``N`` nor for ``L`` and are
never returned; repeated document rows are documents of their own; rows without id rank after all
others of the same score; items without terms find nothing; items equal in id and text are
answered once, different texts under one id once each; without documents or items nothing is returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybefore.llm.common import arrow_map, document_columns, stored
from daybefore.llm.decontaminate import words_of

#: Documents returned per item.
K = 50
#: Characters of item text in one shard.
SHARD_CHARS = 2_000_000
#: Cells of the score table a task holds at once.
CELLS = 1 << 21
#: Groups in which task results meet before the last ranking.
MEETINGS = 64


def automaton_of(terms: list[bytes]) -> ahocorasick.Automaton:
    """Reports the number of a term wherever it stands between blanks."""
    automaton = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        automaton.add_word(f" {term.decode()} ", number)
    automaton.make_automaton()
    return automaton


def counts_in(text: str, automaton: ahocorasick.Automaton) -> tuple[int, Counter]:
    """Terms of the text with repeats, and how often each known one occurs."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), Counter()
    return len(words), Counter(map(itemgetter(1), automaton.iter(f" {b' '.join(words).decode()} ")))


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``doc_id``, ``n`` terms, and the numbers ``terms`` of known terms with their counts ``tfs``, per document with a term."""
    def make():
        automaton = automaton_of(terms)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            found = [counts_in(text, automaton) for text in batch.column("text").to_pylist()]
            rows = [i for i, (n, _) in enumerate(found) if n]
            if not rows:
                return None
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), pa.array([found[i][0] for i in rows], pa.int64()),
                 pa.array([list(found[i][1]) for i in rows], pa.list_(pa.int32())), pa.array([list(found[i][1].values()) for i in rows], pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tfs"])
        return run
    return arrow_map(docs, make, "doc_id long, n long, terms array<int>, tfs array<long>")


def _scores(n: np.ndarray, owner: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, starts: np.ndarray, lists: np.ndarray,
            width: int, total: int, length: int) -> np.ndarray:
    """Documents by items; ``owner`` names each count's document, ``lists[starts[t]:starts[t + 1]]`` the items with term t.

    The sums stay below 2^53, where adding doubles is exact.
    """
    m = 50 + (50 * n * total) // length
    part = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[owner]))
    size = starts[terms + 1] - starts[terms]
    at = np.repeat(starts[terms] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    cells = np.repeat(owner, size) * width + lists[at]
    return np.bincount(cells, np.repeat(part, size), len(n) * width).astype(np.int64).reshape(len(n), width)


def _best(scores: np.ndarray, ids: np.ndarray, void: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first rows of each column by score, then id, those without id last."""
    order = np.lexsort((ids, void, -scores), axis=0)[:k]
    return tuple(np.take_along_axis(x, order, 0) for x in (scores, ids, void))


def _ranked(hits: DataFrame, weights: list[int], items: list[list[int]], total: int, length: int, k: int) -> DataFrame:
    """Each task's best documents: ``item`` (number), ``doc_id``, ``score``."""
    width = len(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: list[list[int]] = [[] for _ in weights]
        for item, own in enumerate(items):
            for t in own:
                of[t].append(item)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in of]))).astype(np.int64)
        lists, w = np.array([x for own in of for x in own], np.int64), np.array(weights, np.int64)
        step, best = max(1, CELLS // width), (np.zeros((0, width), np.int64),) * 2 + (np.zeros((0, width), bool),)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sizes = part.column("terms").value_lengths().to_numpy()
                owner = np.repeat(np.arange(part.num_rows), sizes)
                scores = _scores(part.column("n").to_numpy(), owner, part.column("terms").flatten().to_numpy().astype(np.int64),
                                 part.column("tfs").flatten().to_numpy(), w, starts, lists, width, total, length)
                void = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                ids = part.column("doc_id").fill_null(0).to_numpy()
                new = _best(scores, *(np.broadcast_to(x[:, None], scores.shape) for x in (ids, void)), k)
                best = _best(*(np.concatenate(x) for x in zip(best, new)), k)
        scores, ids, void = best
        row, item = np.nonzero(scores)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids[row, item], pa.int64(), mask=void[row, item]), pa.array(scores[row, item], pa.int64())],
                                             ["item", "doc_id", "score"])
    return hits.mapInArrow(run, "item int, doc_id long, score long")


def _first(df: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return df.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def _shard(docs: DataFrame, items: DataFrame, id_name: str, k: int) -> DataFrame | None:
    rows = [(r[0], sorted(set(words_of(r[1])))) for r in items.collect()]  # bounded by shard_chars
    rows = [r for r in rows if r[1]]
    terms = sorted({t for _, own in rows for t in own})
    number = {t: i for i, t in enumerate(terms)}
    hits = stored(term_counts(docs, terms))
    total, length = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total or not rows:
        return None
    df = {r[0]: r[1] for r in hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # one row a term of the shard
    weights = [math.floor(1000 * math.log((2 * total + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))]
    best = _ranked(hits, weights, [[number[t] for t in own] for _, own in rows], total, length, k)
    best = _first(best.withColumn("meeting", F.pmod(F.spark_partition_id(), F.lit(MEETINGS))), ["item", "meeting"], k, "near").drop("near", "meeting")
    names = docs.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, {id_name} {items.schema[0].dataType.simpleString()}")
    return _first(best, ["item"], k, "rank").join(F.broadcast(names), "item").select(id_name, "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, shard_chars: int = SHARD_CHARS, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Each item's ``k`` best documents: the item's id, ``rank``, ``doc_id``, ``score``."""
    asked = items.select(F.col(item_col), F.coalesce(F.col(item_text_col), F.lit("")).alias("item_text")).distinct()
    docs = document_columns(docs, id_col, text_col)
    chars = asked.agg(F.sum(F.length("item_text"))).first()[0] or 0
    shards = max(1, math.ceil(chars / shard_chars))
    parts = []
    for s in range(shards):
        part = _shard(docs, asked.filter(F.pmod(F.xxhash64(item_col, "item_text"), F.lit(shards)) == s), item_col, k)
        if part is not None:
            parts.append(part if shards == 1 else stored(part))  # written, so that the shard's terms can go
    if not parts:
        kind = items.schema[item_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"`{item_col}` {kind}, rank int, doc_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
