"""The training-data operators on small fixtures: brute force, round trips and edge rows."""

import hashlib
import random
import re
from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from daybefore.llm import context_mixing, decontaminate, fixity, licenses, line_dedup, ngram_join, one_bit_search, pii, quality, sentencepiece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, source string, n long, sid long, doc string"
EDGE = [(1, None, None), (2, "", "a"), (3, "one", "b"), (3, "one", "b"), (None, "a b c d e f g", "a"), (5, "word " * 30000, "c"), (6, "x\n\ny\n", None)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "z") for i, t, s in rows], SCHEMA)


OPERATORS = {
    "pii": lambda d: pii.spans(d),
    "decontaminate": lambda d: decontaminate.scan(d, d.selectExpr("doc_id AS item_id", "text").limit(3)),
    "encode": lambda d: sentencepiece_bpe.encode(d, MODEL),
    "ngram": lambda d: ngram_join.components(d),
    "mixing": lambda d: context_mixing.score(d),
    "quality": lambda d: quality.score(d, d.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")),
    "lines": lambda d: line_dedup.dedup_lines(d, min_sites=2),
    "licenses": lambda d: licenses.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("rows", [EDGE, []], ids=["edge", "empty"])
def test_every_row_is_answered(spark, name, rows):
    assert OPERATORS[name](docs(spark, rows)).count() == len(rows)


def test_pii_base_matches_plain_patterns():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fine(kind, text):
        digits = re.sub("[^0-9]", "", text)
        return {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in text.split(".")), "card": 16 <= len(digits) <= 19 and pii._luhn(digits or "0"),
                "phone": 8 <= len(digits) <= 15}[kind]
    r = random.Random(1)
    for alphabet in ("a@.-+ b1", "01. 25", "0123456789 -", "+1 ().-2"):
        for _ in range(3000):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
            assert pii.detect(text) == {k: [m.span() for m in re.finditer(p, text) if fine(k, m.group())] for k, p in patterns.items()}


@pytest.mark.parametrize("text, kind, found", [
    ("to jane [at] example [dot] com now", "email", "jane [at] example [dot] com"), ("jane at example dot com", "email", "jane at example dot com"),
    ("jаne@exаmple.com", "email", "jаne@exаmple.com"), ("192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"),
    ("plus one four one five five five five one two three four", "phone", "plus one four one five five five five one two three four"),
    ("４111 1111 1111 1111", "card", "４111 1111 1111 1111")])
def test_pii_disguises(text, kind, found):
    spans = pii.find(text)[1][kind]
    assert [text[a:b] for a, b in spans] == [found]


def test_pii_leaves_prose_alone():
    assert not any(pii.find("Look at one of the two dots at noon. Point taken (at last)")[1].values())


def test_windows_by_brute_force():
    r = random.Random(1)
    for _ in range(500):
        items = [(str(i), [r.choice([b"a", b"b", b"\xc3\xa9"]) for _ in range(r.randrange(1, 7))]) for i in range(r.randrange(1, 4))]
        words = [r.choice([b"a", b"b", b"\xc3\xa9", b"cc"]) for _ in range(r.randrange(1, 15))]
        marks, found = bytearray(len(words)), set()
        decontaminate._mark(decontaminate._joined(words), words, decontaminate._automaton(items, 4), marks, found)
        want, who = bytearray(len(words)), set()
        for item, w in items:
            for a in range(max(1, len(w) - 3)):
                for p in range(len(words) - len(w[a:a + 4]) + 1):
                    if words[p:p + len(w[a:a + 4])] == w[a:a + 4]:
                        want[p:p + len(w[a:a + 4])] = b"\1" * len(w[a:a + 4])
                        who.add(item)
        assert (marks, found) == (want, who)


def test_shards_agree(spark):
    d = docs(spark, [(1, "The cat, sat! on a mat", "a"), (2, "nothing here", "a"), (3, "a dog and the cat sat", "b")])
    items = spark.createDataFrame([(1, "the cat sat"), (2, "on a"), (3, "dog"), (None, "mat"), (4, None)], "item_id long, text string")
    one, many = (sorted(map(str, decontaminate.scan(d, items, 3, size).collect())) for size in (1000, 1))
    assert one == many


def test_pieces_match_the_library():
    enc, sp = sentencepiece_bpe.PieceEncoder(sentencepiece_bpe.load_vocabulary(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(3)
    texts = ["".join(r.choice("aaab  the ing ▁\n\t\u0000é日\U0001d4b3.!#0123<s>") for _ in range(r.randrange(60))) for _ in range(2000)]
    for text in [*texts, *("a" * n for n in range(40)), *("=" * n for n in range(60)), *(" " * n for n in range(40)), "ab" * 5000]:
        ids = array("i")
        enc.encode(text, ids)
        assert list(ids) == sp.encode(text)
        assert enc.decode(ids) == sp.decode(list(ids))
    for _ in range(500):
        ids = [r.randrange(3, 400) for _ in range(8)]
        assert enc.decode(ids) == sp.decode(ids)


def _components(rows):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("boundary", [None, 24])
def test_ngram_components_by_brute_force(spark, monkeypatch, boundary):
    if boundary is not None:
        monkeypatch.setattr(ngram_join, "choose_boundary", lambda sizes: boundary)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    monkeypatch.setattr(ngram_join, "LONG", 5)
    r, rows = random.Random(7), []
    for g in range(12):
        base = [f"w{g}x{r.randrange(400)}" for _ in range(r.choice([3, 6, 9, 12, 18, 40, 80]))]
        for _ in range(r.choice([1, 2, 12])):
            words = list(base)
            for _ in range(r.randrange(3)):
                words[r.randrange(len(words))] = f"e{r.randrange(1000)}"
            rows.append((len(rows), " ".join(words), "a"))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.components(docs(spark, rows)).collect()}
    assert got == _components(rows)


def test_line_dedup_keeps_the_first(spark):
    rows = [(i, f"own {i}\n Shared line \n\nShared line", f"s{i % 3}") for i in range(6)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, rows), min_sites=3).collect()}
    assert out[0]["n_removed"] == 0 and out[0]["text"] == rows[0][1]
    assert all(out[i]["n_removed"] == 2 and out[i]["text"] == f"own {i}\n" for i in range(1, 6))


def test_license_forms_meet(spark):
    mit = "Copyright (c) 2020 Someone\n" + licenses.KNOWN["MIT"].upper().replace(",", " ;")
    out = {r["doc_id"]: r for r in licenses.scan(docs(spark, [(1, mit, "a"), (2, "Hello.\nLICENCED under  CC BY-NC 4.0", "a"), (3, "no", "a")])).collect()}
    assert out[1]["licenses"] == ["MIT"] and out[2]["notices"] == ["CC-BY-NC-4.0-notice"] and not out[3]["licenses"] and not out[3]["notices"]


def test_fixity_finds_the_damage(spark):
    records = [(f"f{k % 2}", k * 1000, 900, hashlib.sha256(str(k).encode()).hexdigest()) for k in range(300)]
    spoiled = [(f, o, n, "bad" if o == 5000 else d) for f, o, n, d in records if o != 70000] + [("f0", 123456, 10, "new"), ("f9", 0, 1, None)]
    schema = "file string, offset long, length long, digest string"
    a, b = spark.createDataFrame(records, schema), spark.createDataFrame(spoiled, schema)
    assert {(r["file"], r["offset"], r["finding"]) for r in fixity.audit(a, b, 4096, 4).collect()} == {
        ("f1", 5000, "changed"), ("f0", 70000, "missing"), ("f0", 123456, "extra"), ("f9", 0, "extra")}
    assert fixity.audit(a, a).count() == 0 and fixity.audit(a.limit(0), a.limit(0)).count() == 0


def test_search_recall_and_edges(spark):
    x = np.random.default_rng(1).standard_normal((600, 24))
    rows = [(i, [float(y) for y in v], 0) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] * 24, 0), (None, [1.0] * 24, 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = one_bit_search.search(d, d.filter("vec_id % 50 = 0")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 600, 50):
        s = unit @ unit[q]
        s[q] = -2
        hit += len(set(np.argsort(-s)[:5]) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit >= 0.9 * 60 and len(got) == 60
    assert one_bit_search.search(d.limit(0), d.limit(0)).count() == 0


def test_quality_learns(spark):
    rows = [(i, ("Fine words in a calm line %d.\n" % i) * 3 if i % 2 else "BUY!! NOW$$ " * (3 + i % 7), "a") for i in range(200)]
    d = docs(spark, rows)
    out = quality.score(d, d.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in out)


def test_mixing_prefers_what_it_learned(spark):
    rows = [(i, "the cat sat on the mat and the dog ran", "a") for i in range(60)] + [(100 + i, "zq xv jk wq pz", "a") for i in range(20) if context_mixing.FOLDS]
    out = context_mixing.score(docs(spark, rows)).collect()
    assert all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in out)
    assert min(r["bits_per_byte"] for r in out if r["doc_id"] >= 100) > max(r["bits_per_byte"] for r in out if r["doc_id"] < 60)


def test_mixing_shares_decisions_without_changing_them():
    """Tokens coded together cost what each costs alone, ties, empty batches and long words included; packed counts keep their values."""
    import numpy as np
    rng = np.random.default_rng(1)
    counts = rng.poisson(2, (2, int(context_mixing._OFFSETS[-1]))).astype(np.float32)
    model = context_mixing.Model(counts, rng.normal(0.2, 0.1, (context_mixing.GATES, len(context_mixing.TABLES))), np.zeros((context_mixing.GATES, context_mixing.MAP, 2)))
    words = [b"the", b"then", b"the", b"th", b"a", b"an", b"x" * 70, b"x" * 24, b"x" * 23, "é".encode(), context_mixing.END, b"there", b"a", b"theb", b"thea"]
    registers = [0, 0, 1, 0, 0, 0, 2, 2, 2, 5, 0, 1, 0, 0, 0]
    together = model.bits(registers, words)
    alone = [model.bits([r], [w])[0] for r, w in zip(registers, words)]
    assert np.allclose(together, alone, rtol=1e-5) and (together > 0).all()
    assert len(model.bits([], [])) == 0
    part = np.array([[0, 1, 2, 3, 1000, 1e9], [0, 0, 7, 1, 5, 1e15]], np.float32)
    assert np.allclose(context_mixing.unpack(context_mixing.pack(part)), part, rtol=2e-3)
