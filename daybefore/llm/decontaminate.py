"""Benchmark decontamination: one automaton over all item windows, each text read once.

Texts are normalised to words between single blanks (A-Z lower-cased; words are runs of digits,
letters and anything beyond ASCII).  Every window of ``window`` consecutive item words, or a whole
shorter item, is a pattern of one Aho-Corasick automaton.  A normalised text runs through it once;
positions of matches become word numbers, and hit words character ranges of the original text.

The items are dealt into shards of a bounded number of words (``shard_words``), so the
automaton a task holds is bounded whatever the size of the benchmark; each further shard is
one more pass in the same stage, without a shuffle.  A usual benchmark is one shard.

Edge rows: null or empty texts have no words, hits or items; an item without words matches
nothing; an item without id marks words but is not listed; equal items are listed each.  Repeated
document rows are answered each.  An empty benchmark hits nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate
from math import ceil

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybefore.llm.common import arrow_map, document_columns

WINDOW = 13
SHARD_WORDS = 40_000

#: A-Z to a-z, other ASCII that is neither letter nor digit to a blank; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_STATE = "doc_id long, text string, marks binary, items array<string>"
_RESULT = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _automaton(items: list[tuple[str | None, list[bytes]]], window: int) -> ahocorasick.Automaton:
    """The automaton of all windows; its values are (number of words, item ids)."""
    owners: dict[tuple[bytes, ...], set] = {}
    for item, words in items:
        for at in range(max(1, len(words) - window + 1)):
            owners.setdefault(tuple(words[at:at + window]), set()).add(item)
    automaton = ahocorasick.Automaton()
    for key, who in owners.items():
        automaton.add_word(_joined(key), (len(key), who - {None}))
    automaton.make_automaton()
    return automaton


def _joined(words) -> str:
    return (b" " + b" ".join(words) + b" ").decode()


def _mark(text: str, words: list[bytes], automaton: ahocorasick.Automaton, marks: bytearray, found: set) -> None:
    """Mark the words of all occurrences and gather their items; ``text`` is normalised."""
    ends = None
    for end, (length, who) in automaton.iter(text):
        if ends is None:  # positions of the blanks after each word
            ends = list(accumulate((len(w.decode()) + 1 for w in words)))
        k = bisect_left(ends, end) + 1
        marks[k - length:k] = b"\1" * length
        found |= who


def _spans(text: str, marks: bytearray) -> list[dict[str, int]]:
    """Character ranges of the runs of marked words."""
    out: list[dict[str, int]] = []
    joined = False
    for m, hit in zip(_WORD.finditer(text), marks):
        if hit:
            if joined:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
        joined = bool(hit)
    return out


def _pass(docs: DataFrame, items: list[tuple[str | None, list[bytes]]], window: int, last: bool) -> DataFrame:
    keys = [k for k in ("row", "doc_id") if k in docs.columns]

    def make():
        automaton = _automaton(items, window)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column("text").to_pylist()
            before = zip(batch.column("marks").to_pylist(), batch.column("items").to_pylist())
            rows = []
            for text, (old_marks, old_items) in zip(texts, before):
                words = words_of(text)
                marks, found = bytearray(old_marks or bytes(len(words))), set(old_items or ())
                if words and items:
                    _mark(_joined(words), words, automaton, marks, found)
                rows.append((len(words), marks, sorted(found)))
            lists = pa.array([r[2] for r in rows], pa.list_(pa.string()))
            if not last:
                return pa.RecordBatch.from_arrays([*map(batch.column, keys), batch.column("text"), pa.array([bytes(r[1]) for r in rows], pa.binary()), lists],
                                                  [*keys, "text", "marks", "items"])
            hits = [r[1].count(1) for r in rows]
            spans = [_spans(t, r[1]) if n else [] for t, r, n in zip(texts, rows, hits)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [*map(batch.column, keys), pa.array([r[0] for r in rows], pa.int64()), pa.array(hits, pa.int64()), lists, pa.array(spans, kind)],
                [*keys, "n_words", "n_hit", "items", "spans"])
        return run
    return arrow_map(docs, make, ("row long, " if "row" in keys else "") + (_RESULT if last else _STATE))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
         id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         row_col: str | None = None) -> DataFrame:
    """Per document row (with ``row`` if named): ``n_words``, ``n_hit``, ``items`` found, ``spans`` of the original text, ``contaminated``."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, ceil(chars / (5 * shard_words)))
    docs = document_columns(docs, id_col, text_col, row_col)
    out = docs.select(*docs.columns, F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("array<string>").alias("items"))
    for k in range(shards):
        mine = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k).collect()  # bounded by shard_words
        split = [(r["item"], w) for r in mine if (w := words_of(r["text"]))]
        out = _pass(out, split, window, k == shards - 1)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
