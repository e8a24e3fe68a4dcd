"""Collocations against a plain count; paths of the graph; edge rows."""

import random
import re
from collections import Counter

import pytest

from daybefore.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, gram string, n long, phrase string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "z", 7, "z") for i, t, g in rows], SCHEMA)


def brute(rows, least, top, share=50):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        mine = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= least}
        rows = []
        for p, a in mine.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in mine.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def random_rows(seed):
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdefghij") + str(r.randrange(9)) for _ in range(r.randrange(3, 40))) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [r.choice(passages) if r.random() < .4 else " ".join(r.choice(["a", "B", "c", "É", " ", "x y"]) for _ in range(r.randrange(6))) for _ in range(r.randrange(8))]
        rows.append((i, "".join(p + r.choice([" ", ". ", ", ", "\n", "\t ", " ?"]) for p in parts), r.choice(["en", "de", None])))
    return rows


EDGE = [(1, None, "en"), (2, "", None), (None, "a b c " * 50, "und"), (None, "a b c " * 50, None), (3, "x", "en"), (4, "w " * 30000, "en"), (5, ".;  \t!", "fr"), (6, "a b " * 30, "en US\n+%"), (7, "a b " * 30, "")]


@pytest.mark.parametrize("rows, least, top", [(random_rows(1), 10, 2000), (random_rows(2), 3, 40), (EDGE, 10, 2000), ([], 10, 5)], ids=["plain", "top", "edge", "empty"])
def test_phrases_by_brute_force(spark, rows, least, top):
    got = C.mine(docs(spark, rows), least, top).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, top)


def test_flushing_early_changes_nothing(spark, monkeypatch):
    rows = random_rows(3)
    monkeypatch.setattr(C, "HELD", 5)
    assert sorted(map(tuple, C.mine(docs(spark, rows)).collect())) == brute(rows, 10, 2000)


def test_paths_are_the_longest_unbranched_phrases(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, passage, "en") for i in range(12)] + [(i, "q p30 p31 p32 r", "en") for i in range(11)]
    got = {r["phrase"]: r["n"] for r in C.paths(C.graph(docs(spark, rows))).collect()}
    w = passage.split()
    assert got == {" ".join(w[:32]): 12, "p30 p31 p32": 23, " ".join(w[31:]): 12, "q p30 p31": 11, "p31 p32 r": 11}
