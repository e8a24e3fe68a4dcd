"""SentencePiece BPE encoding by a table over prefixes, and decoding.

The encoding of a prefix of a text ends in exactly one token, and that token can be told
locally: among the pieces that end at this position it is the only one whose encoding next
to the last token of the shorter prefix is just these two tokens.  So one pass of an
Aho-Corasick automaton fills a table *prefix -> last token*, and the ids are read from its
end backwards.  The work is linear in the text, also for words of any length.

Two tokens are compatible when merging their joined characters gives the two back.  Inside
each token the merges run as they do alone, so the test replays both merge traces in order of
score and looks for a pair across the border that would come first.

Texts are cut where no merge can cross: before a run of blanks and around characters that
the vocabulary lacks (written as bytes).  Both follow from the vocabulary and are
checked when it is loaded.

Edge rows: null and empty texts have no ids and decode to the empty text; repeated rows stay.
"""

from __future__ import annotations

import codecs
import re
from array import array
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from daybefore.llm.common import arrow_map, document_columns

BLANK = "▁"
#: Parts remembered per worker, and the longest part that is; both bound memory only.
REMEMBERED, REMEMBERED_CHARS = 300_000, 40


@dataclass(frozen=True)
class Vocabulary:
    """What the encoder needs of a model file; about 1 MB, sent to every task."""
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    byte_ids: tuple[int, ...]
    silent: frozenset[int]
    unknown: int


def load_vocabulary(path: str) -> Vocabulary:
    """Read a BPE model with byte fallback and without user-defined pieces."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    pieces = tuple(sp.id_to_piece(i) for i in range(size))
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(sp.is_byte(i) for i in byte_ids) or any(sp.is_unused(i) for i in range(size)):
        raise ValueError("the model needs byte fallback and no unused pieces")
    silent = frozenset(i for i in range(size) if sp.is_control(i))
    normal = [p for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    known = set(normal)
    if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in normal) or not set("".join(normal)) <= known:
        raise ValueError("pieces hold a blank after a letter, or characters that are no pieces")
    return Vocabulary(pieces, tuple(sp.get_score(i) for i in range(size)), tuple(byte_ids), silent, sp.unk_id())


class PieceEncoder:
    def __init__(self, vocab: Vocabulary):
        skip = set(vocab.byte_ids) | vocab.silent | {vocab.unknown}
        self.score = {p: vocab.scores[i] for i, p in enumerate(vocab.pieces) if i not in skip}
        self.byte_ids = vocab.byte_ids
        self.pieces = vocab.pieces
        self.traces: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(vocab.pieces):
            if i not in skip:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        chars = "".join(re.escape(p) for p in self.score if len(p) == 1 and p != BLANK)
        self.cut = re.compile(f"{BLANK}*[{chars}]+|{BLANK}+|[^{BLANK}{chars}]+")
        self.known = {p for p in self.score if len(p) == 1}
        shown = list(vocab.pieces)
        for b, i in enumerate(vocab.byte_ids):
            shown[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        for i in vocab.silent:
            shown[i] = ""
        shown[vocab.unknown] = " ⁇ "
        self.shown = shown

    def trace(self, i: int) -> tuple[list, list] | None:
        """Merges of a piece alone as (score, left edge) and (score, right edge); None if its merges end elsewhere."""
        if i not in self.traces:
            symbols, left, right = list(self.pieces[i]), [], []
            while len(symbols) > 1:
                scores = [self.score.get(a + b) for a, b in zip(symbols, symbols[1:])]
                found = [s for s in scores if s is not None]
                if not found:
                    break
                best = max(found)
                k = scores.index(best)
                symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
                left.append((best, symbols[0]))
                right.append((best, symbols[-1]))
            self.traces[i] = (left, right) if len(symbols) == 1 else None
        return self.traces[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces ``a`` and ``b`` stay two tokens when they stand side by side."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        first, second = self.trace(a), self.trace(b)
        if first is None or second is None:
            return False
        ends, starts = first[1], second[0]
        x, y, i, j = self.pieces[a][-1], self.pieces[b][0], 0, 0
        while True:
            across = self.score.get(x + y)
            in_a = ends[i][0] if i < len(ends) else None
            in_b = starts[j][0] if j < len(starts) else None
            # equal scores mean equal pieces: the leftmost pair goes first
            if across is not None and (in_a is None or across > in_a) and (in_b is None or across >= in_b):
                return False
            if in_a is None and in_b is None:
                return True
            if in_b is None or in_a is not None and in_a >= in_b:
                x, i = ends[i][1], i + 1
            else:
                y, j = starts[j][1], j + 1

    def _part(self, part: str) -> tuple[int, ...]:
        if part[0] not in self.known:
            return tuple(self.byte_ids[b] for b in part.encode())
        last = [-1] * (len(part) + 1)
        compatible = self.compatible
        for end, (piece, length) in self.automaton.iter(part):
            end += 1
            if last[end] < 0:
                before = last[end - length]
                if self.trace(piece) is not None if end == length else before >= 0 and compatible(before, piece):
                    last[end] = piece
        ids, at = [], len(part)
        while at:
            ids.append(last[at])
            at -= len(self.pieces[last[at]])
        return tuple(reversed(ids))

    def encode(self, text: str, out: array) -> None:
        """Append the ids of ``text`` to ``out``."""
        if not text:
            return
        parts = self.parts
        for part in self.cut.findall(BLANK + text.replace(" ", BLANK)):
            ids = parts.get(part)
            if ids is None:
                ids = self._part(part)
                if len(part) <= REMEMBERED_CHARS:
                    if len(parts) >= REMEMBERED:
                        parts.clear()
                    parts[part] = ids
            out.extend(ids)

    def decode(self, ids) -> str:
        shown = self.shown
        text = "".join([shown[i] for i in ids])
        if text.startswith(BLANK):
            text = text[1:]
        text = text.replace(BLANK, " ")
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "one_mark_per_byte")
        return text


codecs.register_error("one_mark_per_byte", lambda e: ("�", e.start + 1))

_ENCODERS: dict[Vocabulary, PieceEncoder] = {}


def encoder(vocab: Vocabulary) -> PieceEncoder:
    """One encoder per worker process, kept between its tasks."""
    if vocab not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocab] = PieceEncoder(vocab)
    return _ENCODERS[vocab]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and the text ``decoded`` from them, for every row of ``docs``.

    The model file is read on the driver only.
    """
    vocab = load_vocabulary(model_path)

    def make():
        enc = encoder(vocab)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, offsets, decoded = array("i"), [0], []
            for text in batch.column("text").to_pylist():
                enc.encode(text, ids)
                decoded.append(enc.decode(ids[offsets[-1]:]))
                offsets.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, dtype=np.int32)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
        return run
    return arrow_map(document_columns(docs, id_col, text_col), make, "doc_id long, ids array<int>, decoded string")


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id`` and ``decoded`` for a column of ids; null is the empty text, an id out of range fails."""
    vocab = load_vocabulary(model_path)

    def make():
        enc = encoder(vocab)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [enc.decode(x or []) for x in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])
        return run
    return arrow_map(df.selectExpr(f"`{id_col}` AS doc_id", f"`{ids_col}` AS ids"), make, "doc_id long, decoded string")
