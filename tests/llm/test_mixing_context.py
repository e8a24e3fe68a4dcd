"""What stands before a token counts, and the base score against a plain count."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from daybefore.llm import context_mixing

SCHEMA = "doc_id long, text string"


def tokens(text):
    """(register, token) in order; the last is the end."""
    out, register = [], 0
    for w in text.encode().translate(context_mixing._FOLD).split() + [context_mixing.END]:
        out.append((register, w))
        if not w.isascii():
            register = 1 + ord(max(w.decode())) % 61
    return out


def test_order_of_words_changes_the_score(spark):
    text = "The cat sat on the mat and the dog ran far away"
    shuffled = " ".join(sorted(text.split()))
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % context_mixing.FOLDS == context_mixing.HELD_OUT]
    rows = [(i, text) for i in range(60)] + [(held[0], text), (held[1], shuffled), (held[2], text)]
    got = {r["doc_id"]: r for r in context_mixing.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[held[0]]["base_score"] == got[held[1]]["base_score"] and got[held[0]]["held_out"]
    assert got[held[0]]["score"] > got[held[1]]["score"] + 1
    assert got[held[0]]["score"] == got[held[2]]["score"]


def test_base_score_is_a_plain_count(spark):
    r = random.Random(3)
    pool = [f"w{i}" for i in range(300)] + ["\x00", "É", "ünder", "x" * 60]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(40))) for _ in range(200)] + ["", None, "\t A\x0bB\x0c ", "only here"]
    rows = list(enumerate(texts)) + [(None, "only here too"), (3, texts[3])]
    count, held = Counter(), lambda i: i is None or zlib.crc32(str(i).encode()) % context_mixing.FOLDS == context_mixing.HELD_OUT
    for i, text in rows:
        if not held(i):
            count.update(w for _, w in tokens(text or ""))
    total, kinds = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(ts := [w for _, w in tokens(text or "")]), sum(count[w] > 0 for w in ts), total,
                   round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ts), 6)) for i, text in rows)
    for top in (context_mixing.TOP, 5):
        kept, context_mixing.TOP = context_mixing.TOP, top
        try:
            out = context_mixing.score(spark.createDataFrame(rows, SCHEMA)).collect()
        finally:
            context_mixing.TOP = kept
        assert want == sorted((str(o["doc_id"]), o["held_out"], o["n_tokens"], o["n_known"], o["train_tokens"], round(o["base_score"], 6)) for o in out)
        scores = sorted(o["score"] for o in out)
        assert all(s < 0 for s in scores) and (top != 5 or np.allclose(scores, first))
        first = scores


def test_sequence_has_the_tokens_in_order():
    texts = ["The cat\tsat", "", "  ", "\x00 \x00", "the CAT été sat é ж", "cat sat", "a" * 300 + " " + "a" * 299 + "b", "été"]
    s = context_mixing.Sequence([t.encode() for t in texts])
    want = [t for text in texts for t in tokens(text)]
    assert s.words(np.arange(len(s.h))) == [w for _, w in want] and s.register.tolist() == [r for r, _ in want]
    assert s.cuts.tolist() == np.cumsum([0] + [len(tokens(t)) for t in texts]).tolist()
    assert len(set(want)) == len(set(s.key.tolist())) == len(set(zip(want, s.key.tolist())))
    assert len({w for _, w in want}) == len(set(s.h.tolist())) == len(set(s.short.tolist()))
    h, slots = s.h, s.slots
    alone = [context_mixing.Sequence([t.encode()]) for t in texts]
    assert (h == np.concatenate([a.h for a in alone])).all() and (slots == np.concatenate([a.slots for a in alone], axis=1)).all()
    assert (slots[0] < 1 << context_mixing.SLOTS[0]).all() and (slots[1] >= 1 << context_mixing.SLOTS[0]).all()
