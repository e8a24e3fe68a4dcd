"""Language-model scores by logistic mixing of hashed-context bit predictors.

Tokens are words (A-Z lower-cased, split at ASCII white space) and one end per text.  Binary decisions code a token in
two steps.  *Across tokens*: the contexts are the word before and the two words before, hashed into slots; a slot names one
successor, and a decision says whether the token is the one named after the two words before (after the one, where those were not
seen), a second one, if refused, whether it is the other.  *Spelling*: a token that was refused, or had nothing named, is coded as
its bytes and a closing blank, each byte as eight decisions.  Five predictors
see such a decision in different contexts, hashed into tables of fixed size: the last one, two and
three bytes, the token so far, and the token so far together with the *register* of the text (the
last character beyond ASCII before this token, which tells languages and scripts apart).  (A token refused is not
excluded from the spelling, so the probabilities of all texts sum to slightly less than one.)

Learning runs over all training texts.  Spelling: (1) tokens are counted by word and register, with counts
combined in each task before the shuffle; (2) tasks over these counts add up tables of zeros and
ones per context; (3) tasks go through the counts once more and learn online the mixing weights, chosen by
a gate (how much evidence the two longest contexts hold), leaving one occurrence of the
token itself out of its counts, and a refinement map from mixed probabilities to what was
seen.  Tokens that begin alike share their decisions, which are looked up once for all of them.  Across tokens, in the order of the
texts: (1) slots vote for their successor; (2) how often it came true is counted; (3) weights and refinement are learned online as
above, each token left out of its own slots.  Weights are averaged over tasks, maps added.  Everything sent to tasks has a fixed size.

The score of a text is the log10 probability of all its tokens; bits per byte follow from it.  The spelling of each
distinct token is priced once; prices and the counts that the base score needs travel with the tasks for the ``TOP`` most
frequent tokens, all others are joined.

Edge rows: null and empty texts are one end token; a row without id is held out; repeated rows are
learned and scored each; without training texts every decision costs one bit or nearly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybefore.llm.common import document_columns, held_out, stored

FOLDS, HELD_OUT = 7, 2
TOP = 1 << 16
#: log2 of the table sizes: last byte, last two, last three, token so far, with register.
TABLES = (16, 18, 21, 22, 22)
#: Longest stretch of a word coded in one go; longer words are cut, without a closing blank between.
STRETCH = 24
#: Words of more bytes are hashed one by one, not by the rolling hash.
LONG = 256
END = b" "
GATES, MAP = 16, 33
#: log2 of the slots after the word before and after the two words before; gates and inputs of the decisions across tokens.
SLOTS = (20, 21)
FOLLOWING, INPUTS = 32, 3
#: Pseudo-count of zeros and ones; weights at the start and the curvature that holds them there.
PRIOR, START, RIDGE = 0.4, 0.2, 50.0
#: Distinct tokens counted before a task hands them on; rows and bytes of text worked on together; distinct tokens learned from together.
COUNTED, TOGETHER, CHUNK, LEARNED = 200_000, 1024, 1 << 18, 50_000
#: Pieces in which tables are added up and sent.
PIECES = 64

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MUL = np.uint32(2654435761)
_NODE = np.uint32(0x9E3779B1)


def hashes(words: list[bytes]) -> np.ndarray:
    return hash_array(np.array(words, dtype=object), categorize=False).view(np.int64) if words else np.zeros(0, np.int64)


class Stretches:
    """Tokens as sorted rows of bytes: ``data`` (one row per stretch), ``length`` with the closing blank, ``owner`` token and register."""

    def __init__(self, registers: list[int], words: list[bytes]):
        parts, owner, before = [], [], []
        for i, w in enumerate(words):
            w = b" " if w == END else w + b" "
            for at in range(0, len(w), STRETCH):
                parts.append(w[at:at + STRETCH])
                owner.append(i)
                before.append(int.from_bytes(w[at - 3:at]) if at else 0)
        texts = np.array(parts, dtype=f"S{STRETCH}")
        owner = np.array(owner, np.int64)
        register = np.array(registers, np.uint32)[owner] if parts else np.zeros(0, np.uint32)
        before = np.array(before, np.uint32)
        order = np.lexsort((texts, before, register))
        self.owner, self.register, self.before = owner[order], register[order], before[order]
        self.length = np.array(list(map(len, parts)), np.int64)[order]
        self.data = texts[order].view(np.uint8).reshape(-1, STRETCH)

    def columns(self) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, list[np.ndarray]]]]]:
        """Per byte: the rows it concerns, the group of each, and the decisions of the groups.

        Rows that agree up to and with this byte meet the same decisions; being sorted, they
        are neighbours and are worked on as one group.
        """
        rows = np.arange(len(self.length))
        last = self.before
        sofar = np.uint32(0x811C9DC5) ^ self.before * np.uint32(0x01000193)
        new = np.r_[True, (self.register[1:] != self.register[:-1]) | (self.before[1:] != self.before[:-1])][:len(rows)]
        for column in range(STRETCH):
            new[1:] |= self.data[1:, column] != self.data[:-1, column]
            keep = self.length[rows] > column
            rows, last, sofar = rows[keep], last[keep], sofar[keep]
            if not len(rows):
                return
            # a row whose neighbour has ended starts a group if any row between them did
            started = np.cumsum(new)[rows]
            first = np.flatnonzero(np.r_[True, started[1:] != started[:-1]])
            group = np.cumsum(np.r_[False, started[1:] != started[:-1]])
            byte = self.data[rows, column].astype(np.uint32)
            yield rows, group, self._decisions(byte[first], last[first], sofar[first], self.register[rows[first]])
            last = (last << np.uint32(8)) | byte
            sofar = (sofar ^ byte) * np.uint32(16777619)
            sofar ^= sofar >> np.uint32(13)

    @staticmethod
    def _decisions(byte: np.ndarray, last: np.ndarray, sofar: np.ndarray, register: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Per binary decision of a byte: the bits and the place in each predictor's table."""
        contexts = [last & 0xFF, last & 0xFFFF, last & 0xFFFFFF, sofar, sofar ^ (register + np.uint32(1)) * np.uint32(0x85EBCA6B)]
        contexts = [(c + np.uint32(k + 1)) * _MUL for k, c in enumerate(contexts)]
        node = np.ones(len(byte), np.uint32)
        for shift in range(7, -1, -1):
            bit = (byte >> np.uint32(shift)) & np.uint32(1)
            spread = node * _NODE
            places = []
            for c, size in zip(contexts, TABLES):
                h = (c ^ spread) * np.uint32(0xC2B2AE35)
                places.append((h ^ (h >> np.uint32(15))) & np.uint32((1 << size) - 1))
            yield bit, places
            node = node * np.uint32(2) + bit


_OFFSETS = np.concatenate([[0], np.cumsum([1 << t for t in TABLES])])


def _level(evidence: np.ndarray) -> np.ndarray:
    """How much evidence a context holds, in four steps; two of them make the gate."""
    return (evidence > 0.5).astype(np.uint8) + (evidence > 3.5) + (evidence > 60.5)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def _steps(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower point of the refinement map and the weight of the next one."""
    x = (np.clip(mixed, -7.999, 7.999) + 8) * 2
    low = x.astype(np.int64)
    return low, (x - low).astype(mixed.dtype)


class Mixing:
    """Weights by gate and refinement counts, learned online.

    Each step is a Newton step with the curvature gathered so far, so early steps are long and
    later ones short.
    """

    def __init__(self, inputs: int, gates: int):
        self.weights, self.seen, self.mass = np.full((gates, inputs), START), np.zeros(gates * MAP * 2), 0.0
        self.curvature = np.tile(np.eye(inputs) * RIDGE, (gates, 1, 1))

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, w: np.ndarray) -> None:
        """From decisions with inputs ``x`` (one row per input) that count ``w`` times."""
        mixed = _mix(x, gate, self.weights)
        chance = _squash(mixed)
        low, part = _steps(mixed)
        at = (gate * MAP + low) * 2 + bit
        self.seen += np.bincount(at, w * (1 - part), len(self.seen)) + np.bincount(at + 2, w * part, len(self.seen))
        bend, pull = w * (chance * (1 - chance) + 1e-6), w * (bit - chance)
        order = np.argsort(gate.astype(np.int8), kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(gate[order])) + 1):
            if len(mine):
                g, xs = gate[mine[0]], x[:, mine].astype(float)
                self.curvature[g] += (xs * bend[mine]) @ xs.T
                step = np.linalg.solve(self.curvature[g], xs @ pull[mine])
                self.weights[g] += step * min(1.0, 0.5 / max(np.abs(step).max(), 1e-12))


def _mix(x: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    by_input = np.ascontiguousarray(weights.T)
    mixed = x[0] * by_input[0][gate]
    for k in range(1, len(x)):
        mixed += x[k] * by_input[k][gate]
    return mixed


def _refinement(seen: np.ndarray) -> np.ndarray:
    centers = np.arange(MAP) / 2 - 8
    filled = seen + 8 * np.stack([1 - _squash(centers), _squash(centers)], axis=-1)
    return np.log(filled[..., 1] / filled[..., 0]).astype(np.float32)


def _price(x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weights: np.ndarray, refinement: np.ndarray) -> np.ndarray:
    """Code length of decisions, in nats."""
    mixed = _mix(x, gate, weights)
    low, part = _steps(mixed)
    at = gate * MAP + low
    flat = refinement.ravel()
    final = 0.5 * (np.clip(mixed, -12, 12) + flat[at] * (1 - part) + flat[at + 1] * part)
    return np.log(1 + np.exp(np.where(bit == 1, -final, final)))


def learn(counts: np.ndarray, batches: Iterator[tuple[list[int], list[bytes], np.ndarray]]) -> Mixing:
    """The mixing of the spelling, learned over batches of (registers, words, occurrences)."""
    n, mixing = len(TABLES), Mixing(len(TABLES), GATES)
    for registers, words, often in batches:
        s = Stretches(registers, words)
        weight = often[s.owner].astype(float)
        mixing.mass += float(weight.sum())
        for rows, group, decisions in s.columns():
            w = np.bincount(group, weight[rows])
            for bit, places in decisions:
                x, evidence, own = np.empty((n, len(bit)), np.float32), [], bit.astype(np.float32)
                for k, place in enumerate(places):
                    at = _OFFSETS[k] + place
                    ones, zeros = np.maximum(counts[1][at] - own, 0), np.maximum(counts[0][at] - (1 - own), 0)
                    x[k] = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
                    if k > 2:
                        evidence.append(ones + zeros)
                mixing.learn(x, (4 * _level(evidence[0]) + _level(evidence[1])).astype(np.int64), bit.astype(np.int64), w)
    return mixing


class Model:
    """Stretched probabilities and evidence levels of contexts, weights by gate and the refinement map."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray, seen: np.ndarray):
        self.level = np.empty(_OFFSETS[5] - _OFFSETS[3], np.uint8)  # of the two longest contexts
        self.stretched = np.empty(_OFFSETS[5], np.float32)
        for at in range(0, len(self.stretched), CHUNK):
            zeros, ones = counts[:, at:at + CHUNK]
            self.stretched[at:at + CHUNK] = np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR)))
        for at in range(0, len(self.level), CHUNK):
            zeros, ones = counts[:, _OFFSETS[3]:][:, at:at + CHUNK]
            self.level[at:at + CHUNK] = _level(zeros + ones)
        self.weights = weights.astype(np.float32)
        self.map = _refinement(seen)

    def bits(self, registers: list[int], words: list[bytes]) -> np.ndarray:
        """Code length of each token in bits."""
        s = Stretches(registers, words)
        cost = np.zeros(len(s.length))
        for rows, group, decisions in s.columns():
            paid = 0
            for bit, places in decisions:
                x = np.empty((len(TABLES), len(bit)), np.float32)
                for k, place in enumerate(places):
                    x[k] = self.stretched[_OFFSETS[k] + place]
                gate = 4 * self.level[places[3]] + self.level[(_OFFSETS[4] - _OFFSETS[3]) + places[4]]
                paid = paid + _price(x, gate.astype(np.int64), bit, self.weights, self.map)
            cost[rows] += paid[group]
        return np.bincount(s.owner, cost, minlength=len(words)) / np.log(2)


_BREAK = b" \0 \0 "
_BYTE = np.arange(1, 257, dtype=np.uint64)
_INSIDE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_BASE = 0xD1342543DE82EF95
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base of the rolling hash and of its inverse, kept for the next texts."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _POWERS[i] = np.cumprod(step)
    return _POWERS


class Sequence:
    """The tokens of texts in order, an end after each text's words.

    ``h`` tells words apart, ``key`` (even) words and registers; ``slots`` are those after the word before and after the two before
    (one row each); ``cuts`` are the bounds of texts.  All texts are hashed in one go; each begins after two ends.
    """

    def __init__(self, texts: list[bytes]):
        self._folded = (_BREAK + b"".join(t + _BREAK for t in texts)).translate(_FOLD)
        raw = np.frombuffer(self._folded, np.uint8)
        edges = np.flatnonzero(np.diff(_INSIDE[raw], prepend=False))
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _powers(len(raw))
        sums = np.cumsum(_BYTE[raw] * power[:len(raw)])
        h = (sums[ends - 1] - sums[starts - 1]) * inverse[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            h[long] = hashes([self._folded[a:b] for a, b in zip(starts[long], ends[long])]).view(np.uint64)
        # the second end of each text and the first token after it
        second = np.searchsorted(starts, len(_BREAK) + np.cumsum([len(t) + len(_BREAK) for t in texts]) - 2)
        first = np.r_[2, second + 1][:len(second)]
        end = np.zeros(len(h), bool)
        end[:2] = end[second] = end[second - 1] = True
        h[end] = np.uint64(0x5851F42D4C957F2D)
        one = np.r_[h[:1], h[:-1]]
        two = (np.r_[h[:2], h[:-2]][:len(h)] ^ (one >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F) + one
        slots = np.stack([(one * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - SLOTS[0]),
                          ((two ^ (two >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - SLOTS[1])]).astype(np.int64)
        slots[1] += 1 << SLOTS[0]
        real = np.ones(len(h), bool)
        real[:2] = real[second] = False
        self.cuts = np.r_[0, np.cumsum(second - first)]
        self.h, self.slots, self._starts, self._ends, self._end = h[real].view(np.int64), slots[:, real], starts[real], ends[real], end[real]

    @cached_property
    def register(self) -> np.ndarray:
        """Of each token the class of the highest character of the nearest word beyond ASCII before it in its text; 0: none."""
        beyond = np.cumsum(np.frombuffer(self._folded, np.uint8) >> 7, dtype=np.int32)
        at = np.flatnonzero(beyond[self._ends - 1] > beyond[self._starts - 1])
        given = np.full(len(self.h), -1, np.int32)
        given[self._end] = 0
        _, where, which = np.unique(self.h[at], return_index=True, return_inverse=True)
        given[at] = np.array([1 + ord(max(w.decode())) % 61 for w in self.words(at[where])], np.int32)[which]
        last = np.maximum.accumulate(np.where(given >= 0, np.arange(len(given)), -1))
        return np.where(np.r_[-1, last[:-1]] >= 0, given[np.r_[0, last[:-1]]], 0).astype(np.int32)

    @cached_property
    def key(self) -> np.ndarray:
        return token_keys(self.h, self.register)

    def words(self, at: np.ndarray) -> list[bytes]:
        return [END if end else self._folded[a:b] for a, b, end in zip(self._starts[at].tolist(), self._ends[at].tolist(), self._end[at].tolist())]

    @property
    def short(self) -> np.ndarray:
        """32 bits of each word's hash, by which slots know it."""
        return (self.h >> 32).astype(np.uint32)


def vote(word: np.ndarray, votes: np.ndarray, slot: np.ndarray, named: np.ndarray, often: np.ndarray) -> None:
    """Slots (each once) back the successor named by them, or replace theirs when it has fewer votes."""
    after = np.where(word[slot] == named, votes[slot] + often, votes[slot] - often)
    word[slot] = np.where(after < 0, named, word[slot])
    votes[slot] = np.abs(after)


def named(h: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per slot the most frequent successor among these tokens: slot, successor, occurrences."""
    key, often = np.unique((slots.ravel().astype(np.uint64) << np.uint64(32)) | np.tile(h, len(slots)), return_counts=True)
    slot = (key >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((often, slot))
    last = order[np.r_[slot[1:] != slot[:-1], True]] if len(order) else order
    return slot[last], key[last].astype(np.uint32), often[last].astype(np.int32)


class Following:
    """The successors named by slots and how often they failed and came true."""

    def __init__(self, word: np.ndarray, counts: np.ndarray):
        self.word, self.counts = word, counts

    def decisions(self, h: np.ndarray, slots: np.ndarray, own: bool) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """Per decision the tokens that meet it, their inputs, gates and bits; and which tokens are left to spell.

        ``own``: the tokens were counted themselves and are left out of their slots.
        """
        word, hit, x, level = [], [], [], []
        for slot in slots:
            word.append(self.word[slot])
            hit.append(word[-1] == h)
            ones, zeros = self.counts[1][slot], self.counts[0][slot]
            if own:
                ones, zeros = np.maximum(ones - hit[-1], 0), np.maximum(zeros - ~hit[-1], 0)
            level.append(_level(ones + zeros).astype(np.int64))
            x.append(np.where(level[-1] > 0, np.log((ones + np.float32(PRIOR)) / (zeros + np.float32(PRIOR))), 0).astype(np.float32))
        (one, two), same, bias = [v > 0 for v in level], word[0] == word[1], np.ones(len(h), np.float32)
        first = np.flatnonzero(one | two)
        bit = np.where(two, hit[1], hit[0])
        gate = 4 * level[1] + np.where(one, np.where(same, 2 + (level[0] > 1), 1), 0)
        second = np.flatnonzero(one & two & ~same & ~bit)
        met = [(first, np.stack([x[0], x[1], bias])[:, first], gate[first], bit[first].astype(np.int64)),
               (second, np.stack([x[0], x[1], bias])[:, second], (16 + 4 * level[0] + level[1])[second], hit[0][second].astype(np.int64))]
        return met, ~((one | two) & bit | one & hit[0])


def token_counts(docs: DataFrame) -> DataFrame:
    """``h``, ``register``, ``word`` of all texts and ``n``, its occurrences in those marked ``learned``."""
    def combined(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        key, h, register, n, word = (np.concatenate(c) for c in zip(*held))
        key, first, which = np.unique(key, return_index=True, return_inverse=True)
        return key, h[first], register[first], np.bincount(which, n, len(key)).astype(np.int64), word[first]

    def rows(_, h: np.ndarray, register: np.ndarray, n: np.ndarray, word: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(register), pa.array(word, pa.binary()), pa.array(n)], ["h", "register", "word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for part, coded in _chunks(batches):
            s = Sequence(coded)
            learned = np.repeat(part.column("learned").to_numpy(zero_copy_only=False), np.diff(s.cuts))
            key, first, which = np.unique(s.key, return_index=True, return_inverse=True)
            word = np.empty(len(key), object)
            word[:] = s.words(first)
            held.append((key, s.h[first], s.register[first], np.bincount(which, learned, len(key)).astype(np.int64), word))
            if sum(len(x[0]) for x in held) >= COUNTED:
                held = [combined(held)]
                if len(held[0][0]) >= COUNTED // 2:
                    yield rows(*held.pop())
        if held:
            yield rows(*combined(held))
    return docs.select("text", "learned").mapInArrow(count, "h long, register int, word binary, n long").groupBy("h", "register", "word").agg(F.sum("n").alias("n"))


def pack(counts: np.ndarray) -> bytes:
    """Counts in 16 bits each, to 1 part in 2900, compressed."""
    return zlib.compress(np.round(np.log2(1 + counts) * 1024).astype(np.uint16).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.exp2(np.frombuffer(zlib.decompress(data), np.uint16).reshape(2, -1).astype(np.float32) / np.float32(1024)) - np.float32(1)


def table_of(pieces: dict[int, bytes]) -> np.ndarray:
    """Zeros and ones of all contexts."""
    return _joined(pieces, int(_OFFSETS[-1]))


def _joined(pieces: dict[int, bytes], size: int) -> np.ndarray:
    table, at = np.zeros((2, size), np.float32), 0
    for i in range(PIECES if pieces else 0):
        part = unpack(pieces[i])
        table[:, at:at + part.shape[1]] = part
        at += part.shape[1]
    return table


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Some ``LEARNED`` rows at a time."""
    parts, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, LEARNED):
            parts.append(batch.slice(at, LEARNED))
            rows += parts[-1].num_rows
            if rows >= LEARNED:
                yield pa.Table.from_batches(parts)
                parts, rows = [], 0
    if parts:
        yield pa.Table.from_batches(parts)


def _learned_batches(batches: Iterator[pa.RecordBatch]):
    for table in _gathered(batches):
        yield table["register"].to_pylist(), table["word"].to_pylist(), table["n"].to_numpy()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows of some ``CHUNK`` bytes of text, at most ``TOGETHER``, with their texts."""
    for batch in batches:
        at, coded, size = 0, [], 0
        for i, text in enumerate(batch.column("text")):
            coded.append(text.as_py().encode())
            size += len(coded[-1])
            if size >= CHUNK or len(coded) == TOGETHER or i == batch.num_rows - 1:
                yield batch.slice(at, len(coded)), coded
                at, coded, size = i + 1, [], 0


def _added(group: pa.Table) -> pa.Table:
    data = sum(unpack(x.as_py()).astype(float) for x in group.column("data"))
    return pa.table({"piece": group.column("piece").slice(0, 1), "data": pa.array([pack(data)], pa.binary())})


def _pieces(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, part in enumerate(np.array_split(table, PIECES, axis=1)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(part)], pa.binary())], ["piece", "data"])


def _learned(df: DataFrame, adapt, inputs: int, gates: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights averaged over tasks, each of which learns a ``Mixing``, and their refinement counts added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = adapt(batches)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (m.weights.tobytes(), m.seen.tobytes())] + [pa.array([m.mass])], ["weights", "seen", "mass"])
    learned = df.mapInArrow(run, "weights binary, seen binary, mass double").collect()  # one small row per task
    mass = np.array([r["mass"] for r in learned]) + 1e-9
    weights = np.tensordot(mass / mass.sum(), np.stack([np.frombuffer(r["weights"]).reshape(gates, -1) for r in learned]), 1) if learned else np.full((gates, inputs), START)
    return weights, sum((np.frombuffer(r["seen"]).reshape(gates, MAP, 2) for r in learned), np.zeros((gates, MAP, 2)))


def fit(counts: DataFrame) -> tuple[Broadcast, np.ndarray, np.ndarray]:
    """Tables (sent to all tasks), weights and refinement map from token counts; all of them have a fixed size."""
    size = int(_OFFSETS[-1])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * size, np.float32)
        for registers, words, often in _learned_batches(batches):
            s = Stretches(registers, words)
            weight = often[s.owner].astype(float)
            for rows, group, decisions in s.columns():
                w = np.bincount(group, weight[rows]).astype(np.float32)
                for bit, places in decisions:
                    ones = bit.astype(np.int64) * size
                    for k, place in enumerate(places):
                        np.add.at(table, ones + (_OFFSETS[k] + place), w)
        yield from _pieces(table.reshape(2, size))
    summed = counts.mapInArrow(add, "piece int, data binary").groupBy("piece").applyInArrow(_added, "piece int, data binary").collect()  # PIECES rows
    sent = counts.sparkSession.sparkContext.broadcast({r["piece"]: r["data"] for r in summed})
    return sent, *_learned(counts, lambda batches: learn(table_of(sent.value), _learned_batches(batches)), len(TABLES), GATES)


def fit_following(docs: DataFrame) -> tuple[Broadcast, Broadcast, np.ndarray, np.ndarray]:
    """Successors and their counts (sent to all tasks), weights and refinement map from texts; all of them have a fixed size."""
    size, sc = sum(1 << n for n in SLOTS), docs.sparkSession.sparkContext
    texts = docs.select("text").coalesce(2 * sc.defaultParallelism)  # each task hands on its slots, so there are as many as can run, not as many as files

    def ballot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, votes, task = np.zeros(size, np.uint32), np.zeros(size, np.int32), TaskContext.get().partitionId()
        for _, coded in _chunks(batches):
            s = Sequence(coded)
            vote(word, votes, *named(s.short, s.slots))
        for i, (w, v) in enumerate(zip(np.array_split(word, PIECES), np.array_split(votes, PIECES))):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32())] + [pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (w, v)],
                                             ["piece", "task", "word", "votes"])

    def elect(group: pa.Table) -> pa.Table:
        word = votes = None
        for row in group.sort_by("task").to_pylist():
            w, v = (np.frombuffer(zlib.decompress(row[c]), t).copy() for c, t in (("word", np.uint32), ("votes", np.int32)))
            if word is None:
                word, votes = w, v
            else:
                cast = np.flatnonzero(v)
                vote(word, votes, cast, w[cast], v[cast])
        return pa.table({"piece": group.column("piece").slice(0, 1), "word": pa.array([zlib.compress(word.tobytes(), 1)], pa.binary())})
    elected = (texts.mapInArrow(ballot, "piece int, task int, word binary, votes binary").groupBy("piece").applyInArrow(elect, "piece int, word binary")
               .collect())  # PIECES rows
    words = sc.broadcast({r["piece"]: r["word"] for r in elected})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, table = successors(words.value), np.zeros(2 * size, np.float32)
        for _, coded in _chunks(batches):
            s = Sequence(coded)
            for slot in s.slots:
                np.add.at(table, slot + size * (word[slot] == s.short), np.float32(1))
        yield from _pieces(table.reshape(2, size))
    summed = texts.mapInArrow(add, "piece int, data binary").groupBy("piece").applyInArrow(_added, "piece int, data binary").collect()  # PIECES rows
    sent = sc.broadcast({r["piece"]: r["data"] for r in summed})

    def adapt(batches: Iterator[pa.RecordBatch]) -> Mixing:
        following, mixing = Following(successors(words.value), following_counts(sent.value)), Mixing(INPUTS, FOLLOWING)
        for _, coded in _chunks(batches):
            s = Sequence(coded)
            mixing.mass += len(s.h)
            for at, x, gate, bit in following.decisions(s.short, s.slots, own=True)[0]:
                mixing.learn(x, gate, bit, np.ones(len(at)))
        return mixing
    return words, sent, *_learned(texts, adapt, INPUTS, FOLLOWING)


def successors(pieces: dict[int, bytes]) -> np.ndarray:
    return np.concatenate([np.frombuffer(zlib.decompress(pieces[i]), np.uint32) for i in range(PIECES)]) if pieces else np.zeros(sum(1 << n for n in SLOTS), np.uint32)


def following_counts(pieces: dict[int, bytes]) -> np.ndarray:
    return _joined(pieces, sum(1 << n for n in SLOTS))


def token_keys(h: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """One even number per word, by its hash, and register."""
    return (h ^ (registers.astype(np.int64) * np.int64(0x1E3779B97F4A7C15))) & np.int64(-2)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and ``bits_per_byte``."""
    docs = document_columns(docs, id_col, text_col)
    marked = docs.select("text", (~held_out(F.col("doc_id"), FOLDS, HELD_OUT)).alias("learned"))
    counts = stored(token_counts(marked).sortWithinPartitions("register", "word"))  # neighbours begin alike
    words = stored(counts.groupBy("h").agg(F.sum("n").alias("c")).filter("c > 0"))
    sums = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    sent, weights, seen_bits = fit(counts.filter("n > 0"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(table_of(sent.value), weights, seen_bits)
        for part in _gathered(batches):
            keys = token_keys(part["h"].to_numpy(), part["register"].to_numpy())
            bits = model.bits(part["register"].to_pylist(), part["word"].to_pylist())
            yield from pa.table({"token": keys, "h": part["h"], "n": part["n"], "bits": bits}).combine_chunks().to_batches()
    prices = stored(counts.mapInArrow(spell, "token long, h long, n long, bits double").join(words, "h", "left").select("token", "n", "bits", F.coalesce("c", F.lit(0)).alias("c")))
    top = prices.orderBy(F.desc("n"), "token").limit(TOP).collect()  # TOP rows at most
    order = np.argsort(np.array([r["token"] for r in top], np.int64))
    top_token, top_c = np.array([r["token"] for r in top], np.int64)[order], np.array([r["c"] for r in top], np.int64)[order]
    top_bits = np.array([r["bits"] for r in top], float)[order]
    successor, came, follow_weights, follow_seen = fit_following(marked.filter("learned"))
    follow_map = _refinement(follow_seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        following = Following(successors(successor.value), following_counts(came.value))
        for part, coded in _chunks(batches):
            s = Sequence(coded)
            cuts, start = s.cuts, s.cuts[:-1]
            keys, token = np.unique(s.key, return_inverse=True)
            met, left = following.decisions(s.short, s.slots, own=False)
            cost = np.zeros(len(token))
            for at, x, gate, bit in met:
                cost[at] += _price(x, gate, bit, follow_weights, follow_map) / np.log(2)
            place = np.minimum(np.searchsorted(top_token, keys), max(len(top_token) - 1, 0))
            common = top_token[place] == keys if len(top_token) else np.zeros(len(keys), bool)
            c, bits = (np.where(common, v[place], 0) if len(top_token) else np.zeros(len(keys)) for v in (top_c, top_bits))
            cost += np.where(left, bits[token], 0)
            # other tokens wait for their prices: per text each once, apart by whether it is spelled
            at = np.flatnonzero(~common[token])
            rare, often = np.unique(((np.searchsorted(cuts, at, "right") - 1) << 40) | (token[at] << 1) | left[at], return_counts=True)
            lists = np.searchsorted(rare, np.arange(len(cuts)) << 40).astype(np.int32)
            rare = keys[(rare & ((1 << 40) - 1)) >> 1] | (rare & 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + len(start))), part.column("doc_id"), pa.array(np.diff(cuts)), pa.array(np.add.reduceat(cost, start)),
                 pa.array(np.add.reduceat((c > 0)[token].astype(np.int64), start)), pa.array(np.add.reduceat(np.log10(c + 1.0)[token], start)),
                 *(pa.ListArray.from_arrays(pa.array(lists), pa.array(v)) for v in (rare, often)), pa.array([len(t) for t in coded], pa.int64())],
                ["uid", "doc_id", "n_tokens", "bits", "known", "log", "rare", "often", "n_bytes"])
            uid += len(start)
    rows = stored(docs.mapInArrow(run, "uid long, doc_id long, n_tokens long, bits double, known long, log double, rare array<long>, often array<long>, n_bytes long"))
    waiting = rows.select(F.col("uid").alias("u"), F.explode(F.arrays_zip("rare", "often")).alias("r")).select(
        "u", F.col("r.rare").bitwiseAND(F.lit(-2).cast("long")).alias("token"), (F.col("r.rare") % 2 != 0).alias("spelled"), F.col("r.often").alias("often"))
    found = waiting.join(prices, "token").groupBy("u").agg(
        F.sum(F.when(F.col("c") > 0, F.col("often")).otherwise(0)).alias("rare_known"), F.sum(F.col("often") * F.log10(F.col("c") + 1.0)).alias("rare_log"),
        F.sum(F.when(F.col("spelled"), F.col("often") * F.col("bits")).otherwise(0.0)).alias("rare_bits"))
    every = float(np.log10(sums["n"] + sums["v"] + 1))
    zero, none = F.lit(0), F.lit(0.0)
    bits = F.col("bits") + F.coalesce("rare_bits", none)
    return rows.join(found, F.col("uid") == F.col("u"), "left").select(
        "doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(int(sums["n"])).cast("long").alias("train_tokens"), (F.col("log") + F.coalesce("rare_log", none) - F.col("n_tokens") * every).alias("base_score"),
        (-bits * float(np.log10(2))).alias("score"), (bits / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
