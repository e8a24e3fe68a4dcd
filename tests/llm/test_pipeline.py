"""The pipeline against brute force, stage by stage and whole, on null ids, repeated ids and rows, empty texts and empty tables."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from daybefore.llm import decontaminate, line_dedup, quality

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "the quick red fox ran over nine lazy dogs while eleven cats sat still there"


def fixture():
    r, rows, labels = random.Random(5), [], []

    def prose(n=40):
        return ". ".join(" ".join(f"{r.choice('bcdfg')}{r.choice(['ar', 'el', 'on'])}{r.choice('aeiou')}{r.randrange(50)}" for _ in range(8)) for _ in range(n // 8)) + "."

    def junk():
        return "BUY!! NOW$$ 100%% " * r.randrange(4, 12)

    def add(i, text, source="s", lang="en"):
        rows.append((i, text, lang, source, len(text or "")))
    for i in range(60):
        add(i, prose() if i % 2 else junk(), f"s{i}")
        labels.append((i, i % 2, 0))
    fine = prose()
    for i in (None, None, 100, 101):  # rows without id: fine, junk, contaminated, empty, blank
        add(i, prose(), "n1")
        add(i, junk(), "n2")
        add(i, prose(8) + " " + ITEM, "n3")
        add(i, "", "n4")
    add(None, None, "n5")
    add(None, fine, "n6")
    add(200, fine + " more", "n7")  # the row with an id stays
    add(300, prose(), "a")  # one id, several texts
    add(300, prose(), "a")
    add(300, junk(), "a")
    add(300, prose(8) + " " + ITEM, "a")
    for _ in range(3):  # true repeats
        add(400, rows[1][1] + " x y z w v u t s r q p o", "b")
        add(None, "One lone row without id that stands three times over.", "c")
    for i in range(500, 512):  # boilerplate on many sites, alone and below other lines
        add(i, prose() + "\nSubscribe to our calm letter today.", f"site{i}")
        add(None, "Subscribe to our calm letter today.", f"site{i}")
    return rows, labels


def by_quality(rows, labels):
    label = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % quality.FOLDS}
    x, known = np.array([quality.statistics(t or "") for _, t, *_ in rows]).reshape(-1, quality.SIZE), [label.get(r[0]) for r in rows]
    of = [x[[k for k, v in enumerate(known) if v == c]] for c in (0, 1)]
    if not len(rows) or not all(map(len, of)):
        only = 0.5 if not any(map(len, of)) else float(len(of[1]) > 0)
        return [r for r in rows if only >= quality.THRESHOLD]
    cov = [np.cov(m.T, bias=True) for m in of]
    pooled = (cov[0] * len(of[0]) + cov[1] * len(of[1])) / (len(of[0]) + len(of[1]))
    log = []
    for m, c in zip(of, cov):
        c = (1 - quality.TO_POOLED) * c + quality.TO_POOLED * pooled
        c = (1 - quality.TO_DIAGONAL) * c + quality.TO_DIAGONAL * np.diag(np.diag(pooled)) + 1e-6 * np.eye(quality.SIZE)
        d = x - m.mean(0)
        log.append(np.log(len(m)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,ij->i", d, np.linalg.solve(c, d.T).T))
    fine = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))) >= quality.THRESHOLD
    return [r for r, f in zip(rows, fine) if f]


def by_lines(rows, _=None):
    sites, keeper = {}, {}
    for i, t, _, s, _ in rows:
        for line in {k.strip(" \t\r") for k in (t or "").split("\n")} - {""}:
            sites.setdefault(line, set()).add(s)
            keeper[line] = min([x for x in (keeper.get(line), i) if x is not None], default=None)
    out = []
    for i, t, lang, s, _ in rows:
        lines = (t or "").split("\n")
        stay = [k for k in lines if len(sites.get(k.strip(" \t\r"), ())) < line_dedup.MIN_SITES or keeper[k.strip(" \t\r")] == i]
        if len(stay) == len(lines) or any(k.strip(" \t\r") for k in stay):
            text = "\n".join(stay)
            out.append((i, text, lang, s, len(text)))
    return out


def by_ngrams(rows, _=None):
    """Of each component one row with the smallest id, rows without id last; of equal rows one."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets[:a]):
                if x and y and label[a] != label[b] and 5 * len(x & y) >= 4 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    return [r for k, r in enumerate(rows) if label[k] == k]


def by_items(rows, items):
    out = []
    for r in rows:
        words, marks = decontaminate.words_of(r[1] or ""), set()
        for item in items:
            w = decontaminate.words_of(item)
            for a in range(max(1, len(w) - decontaminate.WINDOW + 1)):
                p = w[a:a + decontaminate.WINDOW]
                for at in range(len(words) - len(p) + 1):
                    marks |= set(range(at, at + len(p))) if words[at:at + len(p)] == p else set()
        if not (marks and 20 * len(marks) >= len(words)):
            out.append(r)
    return out


def stored_tables(spark, path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)] if rows else [], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def as_list(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("full", [True, False], ids=["rows", "empty"])
def test_stages_and_run_match_brute_force(spark, tmp_path, full):
    rows, labels = fixture() if full else ([], [])
    path = stored_tables(spark, tmp_path, rows, labels)
    plain = [lambda r: by_quality(r, labels), by_lines, by_ngrams, lambda r: by_items(r, [ITEM] if full else [])]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain):
        want = brute(rows)
        got = stage(spark, spark.createDataFrame(rows, SCHEMA), path).select(*corpus_pipeline.COLUMNS).collect()
        assert as_list(got) == as_list(want), name
        assert not full or len(want) < len(rows)
        rows = want
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = [sp.encode(r[1] or "") for r in rows]
    want = [(r[0], len(i), i, sp.decode(i)) for r, i in zip(rows, ids)]
    assert as_list(corpus_pipeline.run(spark, path).collect()) == as_list(want)
    if full:
        assert sum(r[0] is None for r in rows) > 3 and sum(r[0] == 300 for r in rows) == 2
