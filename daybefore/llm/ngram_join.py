"""Exact Jaccard join on word shingles, size-aware, and its connected components.

Two documents link when their shingle sets have a Jaccard similarity of at least 4/5.  Copies fall
together first by a digest of the whole set; everything below works on distinct sets.

*Small sets* (up to a boundary) are joined by fixed-size subsets: a pair of sizes (a, b) needs
an overlap of c = ceil(4 (a + b) / 9), so either set lists all its c-subsets, and sets that meet
in a subset are linked without looking at them again.  A star per subset replaces all pairs.

*Large sets* scan inverted lists.  Under one global order of shingles, linked sets share one
of their first n - ceil(4n/5) + 1, so only these are indexed.  Shingles that many documents carry are put
last in the order (the most frequent ones, at most ``HEAVY``, so the broadcast has a fixed size;
any fixed choice of them keeps the join exact).  Short lists give their pairs of like size at once,
with the number of shingles they share there: what lies behind the prefixes adds at most the longer
rest, so a pair that shares too few of its first shingles is out, and long texts that merely quote
the same passage are never compared.  Frequent lists are scanned in two steps:

1. every member of a list is compared with the smallest member of its size band; links found this
   way gather groups of near copies at a cost linear in the lists;
2. members that still lie in different components are compared.

Before sets are fetched, a pair must pass a parity sketch: each shingle flips one of 1024 bits, so the
bits in which two sketches differ are never more than the shingles in which the sets do.

Pairs inside a component need no comparison, so a group of thousands of near copies never
becomes all its pairs, and no link between different components is missed.

The boundary is the size with the least estimated cost: subsets listed by sets below it, against
list entries (``LIST_COST`` each) of sets above.

Edge rows: null and empty texts have no shingles and link with nothing; with fewer than five words
the whole sequence is the one shingle; rows of one id are one document, which links as any of its
texts does; a row without id has no component.  Shingles and sets are compared by 64-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybefore.llm import graph
from daybefore.llm.common import arrow_map, document_columns, stored

WORDS = 5
#: Shingles put last in the order, at most; and how many entries make a shingle frequent.
HEAVY, FREQUENT = 1 << 18, 24
#: Cost of an entry of an inverted list (kept, compared, verified) in listed subsets; largest boundary tried.
LIST_COST, LARGEST_BOUNDARY = 3, 24
#: A list with more members than this is treated like that of a frequent shingle.
LONG = 48
#: Smallest shingles of a set's frequent lists that its rows carry.
LOWEST = 8
#: Numbers gathered by a task before it hands them on; characters whose words a task holds at once.
FLUSH, CHARACTERS = 1 << 20, 1 << 21
#: 64-bit words of a parity sketch; 64-bit words of the filter that tells which texts to fetch.
SKETCH, FILTER = 16, 1 << 17
_SKETCH = [f"s{i}" for i in range(SKETCH)]

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    out, group, size = [], [], 0
    for text in texts:
        if group and size + len(text) > CHARACTERS:
            out += _shingles(group)
            group, size = [], 0
        group.append(text)
        size += len(text)
    return out + _shingles(group)


def _shingles(texts: list[str]) -> list[np.ndarray]:
    """As ``shingles``; the words of all texts are hashed at once."""
    split = [t.encode().translate(_FOLD).split() for t in texts]
    words = [w for s in split for w in s]
    hashes = hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)
    out, at = [], 0
    for s in split:
        h = hashes[at:at + len(s)]
        at += len(s)
        n = min(WORDS, len(h))
        if n == 0:
            out.append(h)
            continue
        total = np.full(len(h) - n + 1, n if n < WORDS else 0, np.uint64)
        for k in range(n):
            total += h[k:len(h) - n + 1 + k] * _STEPS[k]
        out.append(np.unique(mix(total)))
    return out


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def overlap(a: int, b: int) -> int:
    """Smallest overlap that links sets of these sizes."""
    return (4 * (a + b) + 8) // 9


def band_of(n: int) -> int:
    """Sizes of linked sets lie in the same or in neighbouring bands."""
    return int(log(n) / log(1.25))


def partners(n: int, boundary: int) -> list[tuple[int, int]]:
    """Size pairs (smaller, larger) a set of size ``n`` belongs to, up to the boundary."""
    low, high = (4 * n + 4) // 5, min(5 * n // 4, boundary)
    return [(min(n, m), max(n, m)) for m in range(low, high + 1)]


def choose_boundary(sizes: dict[int, int]) -> int:
    """The boundary of least cost for these counts of sets by size."""
    def cost(b: int) -> int:
        small = sum(c * sum(comb(n, overlap(*p)) for p in partners(n, b)) for n, c in sizes.items() if n <= b)
        return small + LIST_COST * sum(c * prefix_length(n) for n, c in sizes.items() if n >= (4 * (b + 1) + 4) // 5)
    return min(range(LARGEST_BOUNDARY + 1), key=cost)


def subset_keys(s: np.ndarray, boundary: int) -> list[tuple[int, bool]]:
    """(key, whether the set is of the smaller size) of every subset that a partner could share."""
    own, out = mix(s), []
    for a, b in partners(len(s), boundary):
        picks = np.array(list(combinations(range(len(s)), overlap(a, b))))
        keys = mix(own[picks].sum(axis=1) + np.uint64(a * 1024 + b)).view(np.int64)
        out += [(k, len(s) == a) for k in keys.tolist()]
    return out


class _Dealer:
    """Gathers numbers by bucket over a task and hands them on as one row per bucket."""

    def __init__(self, buckets: int, names: list[str]):
        self.buckets, self.names, self.parts, self.size = buckets, names, [], 0

    def add(self, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(arrays)
        self.size += len(arrays[0])
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            key, *values = [np.concatenate(x) for x in zip(*self.parts)]
            order = np.argsort(key, kind="stable")
            key = key[order]
            cuts = np.flatnonzero(np.diff(key)) + 1
            columns = [pa.array([p.tobytes() for p in np.split(v[order], cuts)], pa.binary()) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(key[np.r_[0, cuts]].astype(np.int32)), *columns], ["bucket", *self.names])
        self.parts, self.size = [], 0


def _buckets(df: DataFrame) -> int:
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sets(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``sid`` (digest of the set; null where empty) and the sketch per row."""
    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = shingles(batch.column("text").to_pylist())
            marks = np.array([sketch(s) for s in found]).reshape(-1, SKETCH)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array([set_id(s) if len(s) else None for s in found], pa.int64()),
                 *(pa.array(np.ascontiguousarray(marks[:, i])) for i in range(SKETCH))], ["doc_id", "n", "sid", *_SKETCH])
        return run
    return arrow_map(docs, make, "doc_id long, n long, sid long, " + ", ".join(f"{c} long" for c in _SKETCH))


def may_link(x: str, y: str) -> Column:
    """Whether sizes and sketches of the rows aliased ``x`` and ``y`` leave a link possible."""
    differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in _SKETCH[1:]),
                 F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * differ <= n + m)


def frequent_shingles(docs: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Low halves of the most frequent shingles, sorted, and their counts; at most ``HEAVY``.

    Counted over the part of each set that can become its prefix.
    """
    buckets = _buckets(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = _Dealer(buckets, ["shingles"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                parts = [s[:5 * prefix_length(len(s)) // 4 + 8] for s in shingles(batch.column("text").slice(at, 256).to_pylist()) if len(s) >= least]
                if parts:
                    low = np.concatenate(parts).astype(np.uint32)
                    yield from deal.add(low % buckets, low)
        yield from deal.flush()

    def frequent(table: pa.Table) -> pa.Table:
        values, counts = np.unique(np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("shingles").to_pylist()]), return_counts=True)
        keep = counts >= FREQUENT
        return pa.table({"shingle": pa.array(values[keep].astype(np.int64)), "n": pa.array(counts[keep].astype(np.int64))})
    rows = (docs.select("text").mapInArrow(count, "bucket int, shingles binary").groupBy("bucket").applyInArrow(frequent, "shingle long, n long")
            .orderBy(F.desc("n"), "shingle").limit(HEAVY).collect())
    keys = np.array([r["shingle"] for r in rows], np.uint32)
    order = np.argsort(keys)
    return keys[order], np.array([r["n"] for r in rows], np.int64)[order]


def prefix(s: np.ndarray, heavy: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the global order, and which of them are frequent."""
    size = prefix_length(len(s))
    if len(heavy):
        low = s.astype(np.uint32)
        at = np.minimum(np.searchsorted(heavy, low), len(heavy) - 1)
        last = heavy[at] == low
        if last.any():
            weight = np.where(last, counts[at], 0)
            order = np.lexsort((s, weight))[:size]
            return s[order], last[order]
    return s[:size], np.zeros(size, bool)


def lists(docs: DataFrame, least: int, heavy: np.ndarray, counts: np.ndarray) -> DataFrame:
    """What the inverted lists hold, as rows (``a``, ``b``, ``shingle``).

    A short list gives its pairs of like size, ``a`` and ``b``, with ``shared``, the number of such lists
    of the bucket that hold both; a frequent shingle gives its members ``a``.
    """
    buckets = _buckets(docs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = _Dealer(buckets, ["shingles", "sids", "bands"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for s in shingles(batch.column("text").slice(at, 256).to_pylist()):
                    if len(s) >= least:
                        first, last = prefix(s, heavy, counts)
                        sid = set_id(s)
                        spread = np.where(last, np.uint64(sid & 0xFFFF), np.uint64(0))  # a frequent shingle's list is dealt over all buckets
                        band = (band_of(len(s)) + 128 * last).astype(np.uint8)
                        yield from deal.add((first + spread) % np.uint64(buckets), first, np.full(len(first), sid, np.int64), band)
        yield from deal.flush()

    def pairs(table: pa.Table) -> pa.Table:
        shingle, sid, band = (np.concatenate([np.frombuffer(b, kind) for b in table.column(c).to_pylist()])
                              for c, kind in (("shingles", np.uint64), ("sids", np.int64), ("bands", np.uint8)))
        order = np.lexsort((sid, shingle))
        shingle, sid, band = shingle[order], sid[order], band[order]
        new = np.r_[True, (shingle[1:] != shingle[:-1]) | (sid[1:] != sid[:-1])]  # copies of a set are one member
        shingle, sid, band = shingle[new], sid[new], band[new]
        start = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
        size = np.diff(np.r_[start, len(shingle)])
        member = (band >= 128) | np.repeat(size > LONG, size)
        found = []
        for step in range(1, min(LONG, int(size.max(initial=1)))):  # each member with the one ``step`` further on
            x = np.flatnonzero((shingle[step:] == shingle[:-step]) & ~member[step:])
            x = x[np.abs(band[x].astype(int) - band[x + step]) <= 1]
            found.append(np.stack([sid[x], sid[x + step]], axis=1))
        both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        first = np.flatnonzero(np.r_[True, (both[1:] != both[:-1]).any(axis=1)][:len(both)])
        shared, both = np.diff(np.r_[first, len(both)]), both[first]
        none, others = pa.nulls(len(both), pa.int64()), pa.nulls(int(member.sum()), pa.int64())
        return pa.table({"a": pa.array(np.r_[both[:, 0], sid[member]]), "b": pa.concat_arrays([pa.array(both[:, 1].copy()), others]),
                         "shingle": pa.concat_arrays([none, pa.array(shingle[member].view(np.int64))]), "shared": pa.concat_arrays([pa.array(shared), others])})
    dealt = docs.select("text").mapInArrow(emit, "bucket int, shingles binary, sids binary, bands binary")
    return dealt.groupBy("bucket").applyInArrow(pairs, "a long, b long, shingle long, shared long")


def small_links(docs: DataFrame, classes: DataFrame, boundary: int) -> DataFrame:
    """Links ``a``, ``b`` of sets up to the boundary: a star around a set of the smaller size per shared subset."""
    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for sid, raw in zip(batch.column("sid").to_pylist(), batch.column("shingles").to_pylist()):
                s = np.frombuffer(raw, np.uint64)
                rows += [(k, sid, small) for k, small in subset_keys(s, boundary)] if len(s) <= boundary else []
            key, sid, small = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(sid, pa.int64()), pa.array(small, pa.bool_())], ["key", "sid", "small"])
        return run
    small = stored(fetched(docs, classes.filter(F.col("n") <= boundary).select(F.col("rep").alias("doc_id"))))
    rows = stored(arrow_map(small, make, "key long, sid long, small boolean").distinct())
    hubs = (rows.groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.min(F.when(F.col("small"), F.col("sid"))).alias("hub"))
            .filter((F.col("lo") != F.col("hi")) & F.col("hub").isNotNull()).select("key", "hub"))
    return rows.join(hubs, "key").filter("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sid``, ``shingles`` of at least the documents whose ids ``wanted`` holds.

    A bit filter of fixed size tells the scan which texts can be wanted, so texts aren't shuffled.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(64 * FILTER))
    words = (wanted.select(place.alias("place")).selectExpr("cast(place div 64 as int) AS word", "shiftleft(1L, cast(place % 64 as int)) AS bit")
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())  # FILTER rows at most
    bits = np.zeros(FILTER, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            at = batch.column("place").to_numpy()
            keep = np.flatnonzero(bits[at // 64] >> (at % 64) & 1)
            if not len(keep):
                return None
            found = [s for s in shingles(batch.column("text").take(pa.array(keep)).to_pylist()) if len(s)]
            return pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["sid", "shingles"])
        return run
    return arrow_map(docs.select(place.alias("place"), "text"), make, "sid long, shingles binary")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the ``pairs`` (a, b) of set ids that link, by their whole sets."""
    pairs = stored(pairs)
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    members = stored(fetched(docs, ends.join(classes.select("sid", "rep"), "sid").select(F.col("rep").alias("doc_id"))).join(ends, "sid", "left_semi"))
    left = pairs.join(members.select(F.col("sid").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(members.select(F.col("sid").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            linked = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                linked.append(5 * common >= 4 * (len(x) + len(y) - common))
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])
        return run
    return stored(arrow_map(both, make, "a long, b long, linked boolean").filter("linked").select("a", "b").distinct())


def large_links(docs: DataFrame, classes: DataFrame, boundary: int, known: DataFrame) -> DataFrame:
    """Links between sets of which the larger lies above the boundary, enough to connect all that are linked.

    ``classes`` has one row per distinct set (sid, n, rep, sketch); ``known`` the links found before.
    """
    least = (4 * (boundary + 1) + 4) // 5
    heavy, counts = frequent_shingles(docs, least)
    found = stored(lists(docs, least, heavy, counts))
    marks = classes.select("sid", "n", *_SKETCH)

    # shingles of a prefix whose lists gave no pairs count as shared, as far as both have such
    unseen = found.filter("b IS NULL").groupBy(F.col("a").alias("sid")).agg(F.count("*").alias("unseen"))
    ends = marks.join(unseen, "sid", "left").withColumn("unseen", F.coalesce("unseen", F.lit(0)))

    def possible(pairs: DataFrame) -> DataFrame:
        x, y = ends.alias("x"), ends.alias("y")
        most = (F.col("shared") + F.least("x.unseen", "y.unseen") + F.ceil(F.greatest("x.n", "y.n") * 4 / 5) - 1)
        return (pairs.join(x, F.col("a") == F.col("x.sid")).join(y, F.col("b") == F.col("y.sid"))
                .filter(may_link("x", "y") & (F.col("shared").isNull() | (9 * most >= 4 * (F.col("x.n") + F.col("y.n"))))).select("a", "b"))

    short = found.filter("b IS NOT NULL").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    rows = found.filter("b IS NULL").select("shingle", F.col("a").alias("sid")).join(marks, "sid")
    rows = stored(rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")))
    hubs = rows.groupBy("shingle", "band").agg(F.min("sid").alias("hub"), F.max("sid").alias("hi")).filter("hub <> hi").drop("hi")
    stars = rows.select("shingle", "band", "sid").join(hubs, ["shingle", "band"]).filter("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()
    asked = possible(short.unionByName(stars, allowMissingColumns=True))
    asked = stored(asked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # one pair per set first: what it connects needs no further comparison
    one = stored(asked.groupBy("a").agg(F.min("b").alias("b")))
    links = stored(known.unionByName(verified(one, docs, classes)))
    joined = stored(graph.components(links))
    for end in ("a", "b"):
        asked = (asked.join(joined.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
                 .withColumn(f"c{end}", F.coalesce(f"c{end}", end)))
    asked = asked.filter("ca <> cb").select("a", "b").join(one, ["a", "b"], "left_anti")
    links = stored(links.unionByName(verified(asked, docs, classes)))

    rows = stored(rows.drop("band").join(graph.components(links).withColumnRenamed("node", "sid"), "sid", "left")
                  .withColumn("component", F.coalesce("component", "sid")))
    unlike = rows.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("shingle")
    rows = stored(rows.join(unlike, "shingle", "left_semi"))
    # members carry their sketches, so that lists aren't written out as pairs, and their smallest shingles: two sets that
    # share one of these meet in the list of the smallest alone, not in every list that holds both
    low = rows.groupBy("sid").agg(F.slice(F.array_sort(F.collect_set("shingle")), 1, LOWEST).alias("low"))  # of one prefix
    rows = stored(rows.join(low, "sid"))
    x, y = rows.alias("x"), rows.alias("y")
    first = ~F.exists(F.array_intersect("x.low", "y.low"), lambda z: z < F.col("x.shingle"))
    pairs = (x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.component") != F.col("y.component")) & may_link("x", "y") & first)
             .select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct())
    return links.unionByName(verified(pairs, docs, classes))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (smallest id reachable by links) for every row."""
    docs = document_columns(docs, id_col, text_col)
    rows = stored(sets(docs))  # narrow: ids, sizes and sketches
    classes = stored(rows.filter("doc_id IS NOT NULL AND sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("rep"), *[F.min(c).alias(c) for c in ("n", *_SKETCH)]))
    sizes = {r["n"]: r["count"] for r in classes.filter(F.col("n") <= 2 * LARGEST_BOUNDARY).groupBy("n").count().collect()}
    boundary = choose_boundary(sizes)
    named = docs.filter("doc_id IS NOT NULL")
    links = stored(large_links(named, classes, boundary, stored(small_links(named, classes, boundary))))
    # sets become documents: each class is a star around its smallest id
    reps = classes.select("sid", "rep")
    between = (links.join(reps.withColumnRenamed("rep", "ra"), F.col("a") == F.col("sid")).drop("sid")
               .join(reps.withColumnRenamed("rep", "rb"), F.col("b") == F.col("sid")).select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    inside = rows.join(reps, "sid").filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = graph.components(between.unionByName(inside))
    return rows.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
