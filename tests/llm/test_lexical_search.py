"""Ranked search against a plain score of every pair; edge rows, ties, shards and small score tables."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from daybefore.llm import lexical_search as L

DOCS, ITEMS = "doc_id long, text string, n long, item string, score long", "item_id long, text string, rank long"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=50):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = defaultdict(list)
    for item, text in sorted(set(items), key=str):
        found = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text)))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out[item] += [(r + 1, None if void else i, -s) for r, (s, void, i) in enumerate(sorted(found)[:k])]
    return {k: sorted(v, key=str) for k, v in out.items() if v}


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], DOCS)
    got = defaultdict(list)
    for r in L.search(d, spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS), **more).collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return {k: sorted(v, key=str) for k, v in got.items()}


def rows(seed, n=150):
    r = random.Random(seed)
    pool = [f"{a}{b}" for a in "abcé" for b in ("", "1", "日", "x" * 9)]
    text = lambda most: "".join(r.choice(pool).upper() if r.random() < .2 else r.choice(pool) + r.choice([" ", "-", "\n", ". "]) for _ in range(r.randrange(most)))
    return [(i, text(60)) for i in range(n)], [(i, text(12)) for i in range(12)]


EDGE = [(1, None), (2, ""), (3, "!!"), (4, "a b"), (4, "a b"), (None, "a b"), (5, "a " * 30000), (6, "b"), (7, "a b"), (-8, "a b")]


@pytest.mark.parametrize("docs, items", [rows(1), (EDGE, [(1, "a"), (1, "a"), (1, "b zz"), (None, "A B a"), (2, None), (3, "none"), (4, "")]), ([], [(1, "a")]), (EDGE, []), (EDGE[:3], [(1, "a")])],
                         ids=["plain", "edge", "no docs", "no items", "no terms"])
def test_ranks_by_brute_force(spark, docs, items):
    assert run(spark, docs, items) == brute(docs, items)


def test_shards_and_small_tables_agree(spark, monkeypatch):
    docs, items = rows(2, 90)
    monkeypatch.setattr(L, "CELLS", 7)
    assert run(spark, docs, items, k=4, shard_chars=60) == brute(docs, items, 4)
