"""Phrase collocations from a weighted de Bruijn graph of word grams.

Texts are cut into pieces and pieces into words.  Every word position gives exactly one gram: the
``order`` words from there, or fewer where its piece ends.  One aggregation counts them; a
full gram is an edge from its first ``order - 1`` words to its last, both nodes, and a shorter one is a
correction for a piece that ends there.  Everything else is derived from these sums:

* a node's flow, the count of its words as a phrase, is the weight of its outgoing edges plus the
  pieces that end in it; words are counted the same way one level down, and all positions give n;
* a node whose whole flow comes in by one edge and leaves by one is passed through only. Edges that meet in such
  nodes are joined to one path by pointer doubling. All phrases inside a path have its weight, so
  the nodes within need no look-up, and none of them is a candidate: its edge is as frequent.

The grams are summed per task and shuffled once, by their node, so that edges and flows are sums within a
partition; the words at their front take a small second shuffle.  Nodes that are frequent in a bounded sample of
texts are dealt over ``SALTS`` places by their followers, and their flows added up after; the sample decides on
places only, never on results.  Flows below the threshold never leave the aggregation.

Edge rows: null and empty texts have no words; a null language counts as ``und``; repeated rows
count each time; ids and other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybefore.llm.common import stored

#: Longest phrase, in words.
ORDER = 3
MIN_COUNT = 10
TOP = 2000
#: Bytes of text whose grams a task sums before it hands them on; a longer piece is summed whole.
HELD = 16_000_000
#: Rows sampled for frequent nodes, the share of words from which a node counts as frequent, and the places it is dealt over.
SAMPLED, FREQUENT, SALTS = 2000, 1 / 2000, 64

#: A-Z to a-z, the ends of pieces to line feeds, tabs to blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 10 if chr(b) in ".,;:!?\n\v\f\r" else 32 if b == 9 else b for b in range(256))
_GRAMS = "node string, rest string, n int"


def grams_of(text: bytes) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Different grams of a folded text with their counts, one gram for each word position.

    A gram is its first two words joined by a blank (the node) and the third (the rest); words that its piece
    lacks are empty, so that the node of a piece's last word ends in a blank.  Sorted by node.
    """
    pieces = pc.split_pattern(pa.array([text], pa.binary()).cast(pa.large_string()), "\n").flatten()
    lists = pc.split_pattern(pieces, " ")
    words, piece = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    real = pc.not_equal(words, "")
    words, piece = words.filter(real).dictionary_encode(), piece[real.to_numpy(zero_copy_only=False)]
    first = words.indices.to_numpy().astype(np.int64) + 1
    size = len(words.dictionary) + 1
    second, third = np.zeros_like(first), np.zeros_like(first)
    same = piece[1:] == piece[:-1]
    second[:-1] = np.where(same, first[1:], 0)
    third[:-2] = np.where(piece[2:] == piece[:-2], first[2:], 0) if len(first) > 1 else 0
    if size < 1 << 21:
        keys, counts = np.unique((first * size + second) * size + third, return_counts=True)
        first, second, third = keys // (size * size), keys // size % size, keys % size
    else:
        keys, counts = np.unique(np.stack([first, second, third], 1), axis=0, return_counts=True)
        first, second, third = keys.T
    names = pa.concat_arrays([pa.array([""], pa.large_string()), words.dictionary])
    node = pc.binary_join_element_wise(names.take(pa.array(first)), names.take(pa.array(second)), pa.scalar(" ", pa.large_string()))
    return node, names.take(pa.array(third)), counts


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams of (lang, text) rows with their counts; the node begins with the language and a line feed, which no word holds."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            node, rest, counts = grams_of(b"\n".join(texts))
            node = pc.binary_join_element_wise(pa.scalar(lang, pa.large_string()), node, pa.scalar("\n", pa.large_string()))
            for at in range(0, len(counts), 65536):
                yield pa.RecordBatch.from_arrays([node.slice(at, 65536).cast(pa.string()), rest.slice(at, 65536).cast(pa.string()), pa.array(counts[at:at + 65536], pa.int32())],
                                                 ["node", "rest", "n"])
        held.clear()
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            folded = text.as_buffer().to_pybytes().translate(_FOLD)
            held.setdefault(lang, []).append(folded)
            size += len(folded)
            if size > HELD:
                yield from out()
                size = 0
    yield from out()


def _leading(gram: str, n: int) -> Column:
    return F.substring_index(gram, " ", n)


def frequent_nodes(texts: DataFrame) -> list[str]:
    """Nodes with at least ``FREQUENT`` of the words in a sample of about ``SAMPLED`` rows: fewer than 1 / ``FREQUENT``."""
    rows = texts.count()
    sample = texts.sample(min(1.0, SAMPLED / rows), seed=1) if rows else texts
    nodes = sample.mapInArrow(_summed, _GRAMS).groupBy("node").agg(F.sum("n").alias("n"))
    nodes = stored(nodes)
    total = nodes.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in nodes.filter(F.col("n") >= FREQUENT * total).select("node").collect()]


def graph(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The frequent part of the graph: rows ``lang``, ``words`` (3 edge, 2 node, 1 word, 0 all), ``gram``, ``n``.

    Edges, flows and words read the same shuffle of the summed grams.
    """
    lang = F.url_encode(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")))  # without blanks and line feeds
    texts = docs.select(lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    often = frequent_nodes(texts)
    grams = texts.mapInArrow(_summed, _GRAMS)
    if often:  # a frequent node gets the number of one of its places as a third word
        place = F.pmod(F.xxhash64("rest"), F.lit(SALTS)).cast("string")
        grams = grams.withColumn("node", F.when(F.col("node").isin(often), F.concat_ws(" ", "node", place)).otherwise(F.col("node")))
    grams = grams.repartition("node")
    # ``sums`` counts the summands; as it needs ``rest``, all three read the same columns and thus one shuffle
    sums = [F.sum("n").alias("n"), F.count("rest").alias("sums")]
    node = _leading("node", 2)
    edges = grams.groupBy("node", "rest").agg(*sums).filter(F.col("n") >= min_count)
    nodes = grams.groupBy("node").agg(*sums).filter((F.col("n") >= min_count) | (node != F.col("node")))
    words = grams.groupBy(_leading("node", 1).alias("node")).agg(*sums)
    out = None
    for part, level, name in ((edges, 3, F.concat_ws(" ", node, "rest")), (nodes, 2, node), (words, 1, F.col("node"))):
        part = part.select(F.lit(level).alias("words"), name.alias("gram"), "n", "sums")
        out = part if out is None else out.unionByName(part)
    out = stored(out)
    out = out.withColumns({"lang": F.url_decode(F.substring_index("gram", "\n", 1)), "gram": F.substring_index("gram", "\n", -1)})
    # grams shorter than their kind go only now, and the flows of nodes dealt over several places are added up
    out = out.filter((F.col("words") < 2) | ((F.size(F.split(F.trim("gram"), " ")) == F.col("words")) & ~F.endswith("gram", F.lit(" "))))
    whole = out.filter(F.col("words") == 1).groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(0).alias("words"), F.lit("").alias("gram"), "n")
    flows = out.groupBy("lang", "words", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    return stored(flows.unionByName(whole))


def _edges(kept: DataFrame) -> DataFrame:
    """Edges with their end nodes."""
    return kept.filter(F.col("words") == 3).select("lang", "gram", "n", _leading("gram", 2).alias("tail"), F.substring_index("gram", " ", -2).alias("head"))


def through(kept: DataFrame) -> DataFrame:
    """Nodes passed through only, with the edge that enters and the one that leaves: ``lang``, ``node``, ``before``, ``after``."""
    edges, nodes = _edges(kept), kept.filter(F.col("words") == 2).select("lang", F.col("gram").alias("node"), "n")
    into = edges.select("lang", F.col("head").alias("node"), "n", F.col("gram").alias("before"))
    out = edges.select("lang", F.col("tail").alias("node"), "n", F.col("gram").alias("after"))
    return nodes.join(into, ["lang", "node", "n"]).join(out, ["lang", "node", "n"]).select("lang", "node", "before", "after")


def paths(kept: DataFrame) -> DataFrame:
    """All edges as compact paths: ``lang``, ``first`` (its first edge), ``grams`` (its edges in order), ``n``, ``phrase``.

    Pointer doubling: each edge knows the edge ``jump`` places before it, until it knows the first.  No path
    closes to a ring: a piece would have to enter it.
    """
    edges = _edges(kept).select("lang", "gram", "n")
    links = through(kept).select("lang", F.col("after").alias("gram"), F.col("before").alias("first"))
    state = stored(edges.join(links, ["lang", "gram"], "left").select("lang", "gram", "n", F.coalesce("first", "gram").alias("first"),
                                                                     F.col("first").isNotNull().cast("long").alias("place"), F.col("first").isNull().alias("done")))
    while not state.filter(~F.col("done")).isEmpty():
        back = state.select("lang", F.col("gram").alias("first"), F.col("first").alias("further"), F.col("place").alias("more"), F.col("done").alias("end"))
        open_ = state.filter(~F.col("done")).join(back, ["lang", "first"]).select("lang", "gram", "n", F.col("further").alias("first"),
                                                                                 (F.col("place") + F.col("more")).alias("place"), F.col("end").alias("done"))
        state = stored(state.filter("done").unionByName(open_))
    whole = state.groupBy("lang", "first", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("grams"))
    rest = F.transform(F.slice("grams", 2, F.greatest(F.size("grams") - 1, F.lit(0))), lambda g: F.substring_index(g, " ", -1))
    return whole.withColumn("phrase", F.concat_ws(" ", "first", rest))


def _score(a: str, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole numbers of 38 digits; the quotient is at most a million."""
    def wide(c: Column) -> Column:
        return c.cast("decimal(18,0)")
    return F.call_function("div", wide(F.col(a)) * wide(F.col(a)) * F.lit(1000000).cast("decimal(7,0)"), wide(left) * wide(right))


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, share: int = 50, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A phrase goes where a longer one around it has at least ``share`` percent of its occurrences.
    """
    kept = graph(docs, min_count, lang_col, text_col)
    long = paths(kept)
    flow = kept.filter(F.col("words") == 2).select("lang", "gram", F.col("n").alias("flow"))
    word = kept.filter(F.col("words") == 1).select("lang", "gram", F.col("n").alias("count"))
    total = kept.filter(F.col("words") == 0).select("lang", F.col("n").alias("all"))

    def counted(df: DataFrame, phrase: Column, counts: DataFrame, name: str, known: Column | None = None) -> DataFrame:
        found = df.withColumn("gram", phrase).join(counts.toDF("lang", "gram", "found"), ["lang", "gram"], "left")
        return found.withColumn(name, F.coalesce(known, F.col("found")) if known is not None else F.col("found")).drop("gram", "found")

    # edges, from their paths: nodes within a path have the path's weight
    three = long.select("lang", F.col("n").alias("a"), F.size("grams").alias("size"), F.posexplode("grams").alias("at", "phrase"))
    within = F.when(F.col("at") > 0, F.col("a")), F.when(F.col("at") < F.col("size") - 1, F.col("a"))
    three = counted(three, _leading("phrase", 2), flow, "l2", within[0])
    three = counted(three, F.substring_index("phrase", " ", -2), flow, "r1", within[1])
    three = counted(counted(three, _leading("phrase", 1), word, "l1"), F.substring_index("phrase", " ", -1), word, "r2")
    one, two = _score("a", F.col("l1"), F.col("r1")), _score("a", F.col("l2"), F.col("r2"))
    three = three.withColumns({"s1": one, "s2": two})
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", "phrase", "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                         F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    # nodes, but for those inside paths and those that a frequent edge covers
    ends = long.select("lang", "n", F.explode(F.array(_leading("first", 2), F.substring_index(F.element_at("grams", -1), " ", -2))).alias("gram"))
    covered = ends.groupBy("lang", "gram").agg(F.max("n").alias("edge"))
    nodes = flow.join(through(kept).select("lang", F.col("node").alias("gram")), ["lang", "gram"], "left_anti").join(covered, ["lang", "gram"], "left")
    pairs = nodes.filter(F.col("edge").isNull() | (100 * F.col("edge") < share * F.col("flow"))).select("lang", F.col("gram").alias("phrase"), F.col("flow").alias("a"))
    pairs = counted(counted(pairs, _leading("phrase", 1), word, "l"), F.substring_index("phrase", " ", -1), word, "r")
    pairs = pairs.select("lang", "phrase", "a", "l", "r", _score("a", F.col("l"), F.col("r")).alias("score"))

    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = three.unionByName(pairs).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all").alias("n"), "score")
