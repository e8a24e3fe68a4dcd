"""Personal data, also in disguise, with offsets of the original text.

A text goes through a chain of transducers.  Each rewrites some stretches and keeps, for every
character it puts out, the range of the *original* text it came from:

1. look-alike letters, full-width and other decimal digits to ASCII, invisible characters away;
2. ``[at]``, ``(dot)`` and the like to ``@`` and ``.``;
3. spelled digits (four languages, ``double``, ``triple``) to digits, ``plus`` before them to ``+``;
4. bare ``at``/``dot`` words and spaced ``@``, only where the whole has the shape of an address.

The detectors run on the original text (*base* spans) and on the rewritten one; spans found in the
latter are mapped back and added unless they lie within a base span of their kind.

Detectors, leftmost and not overlapping per kind: addresses, IPv4 numbers with parts up to 255,
card numbers of 16 to 19 digits that pass Luhn, international phone numbers of 8 to 15 digits.
All of them take time linear in the text.

Edge rows: null and empty texts have no spans; repeated rows are answered each.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from daybefore.llm.common import arrow_map, document_columns

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like a Latin one.
LOOKALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽε", "g": "ɡ", "h": "һ", "i": "іıι", "j": "ј", "k": "κк", "l": "ӏ", "m": "м", "n": "ո",
    "o": "оοօσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ν", "w": "ԝѡ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ",
    "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "-": "‐‑‒–—−", ".": "․。．｡", "@": "＠﹫", " ": "\u00a0\u2002\u2003\u2005\u2007\u2009\u200a\u202f\u3000", "+": "＋﬩",
}
# Characters without width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# The block of mathematical letters and digits.
MATHEMATICAL = range(0x1D400, 0x1D800)
# Digits in words, English, German, French, Spanish.
DIGIT_WORDS = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs six seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
# Words for the at sign and the full stop.
AT_WORDS = "at arroba arobase"
DOT_WORDS = "dot punkt point punto"

_LOCAL = r"A-Za-z0-9._%+\-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARACTERS = "".join(c for c in map(chr, range(128)) if re.match(f"[{_LOCAL}]", c))
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_IP_HINT = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = str.maketrans("", "", " ().+-")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done and (domain := _DOMAIN.match(text, at + 1)):
            start, step = at, 64
            while True:  # walk back over the local part, which holds no "@"
                low = max(done, at - step)
                start = low + len(text[low:at].rstrip(_LOCAL_CHARACTERS))
                if start > low or low == done:
                    break
                step *= 2
            if start < at:
                out.append((start, domain.end()))
                done = domain.end()
        at = text.find("@", at + 1)
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind, by start."""
    found = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _IP_HINT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().translate(_NOT_DIGIT)
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(m.group().translate(_NOT_DIGIT)) <= 15]
    return found


class Mapped:
    """A rewritten text; pieces of it are either copied stretches or replacements."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends = None, None  # per character, its range of the original; None: itself

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) stretches, in order; each character put out stands for its whole stretch."""
        if not pieces:
            return
        starts = self.starts or range(len(self.text))
        ends = self.ends or range(1, len(self.text) + 1)
        text, new_starts, new_ends, done = [], [], [], 0
        for a, b, put in [*pieces, (len(self.text), len(self.text), "")]:
            text += (self.text[done:a], put)
            new_starts.extend(starts[done:a])
            new_ends.extend(ends[done:a])
            if put:
                new_starts.extend([starts[a]] * len(put))
                new_ends.extend([ends[b - 1]] * len(put))
            done = b
        self.text, self.starts, self.ends = "".join(text), new_starts, new_ends

    def origin(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])


@cache
def _characters() -> tuple[re.Pattern, dict[str, str]]:
    to = {c: latin for latin, alike in LOOKALIKES.items() for c in alike} | dict.fromkeys(INVISIBLE, "")
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x10000), *MATHEMATICAL):
        c = chr(code)
        if c not in to:
            digit = unicodedata.decimal(c, None)
            plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and "!" <= plain <= "~" and not "ª" <= c <= "º":
                to[c] = plain
    far = ""  # digits beyond the basic plane stand in runs of ten; few members there keep the class fast
    for code in range(0x10000, 0x110000):
        digit = unicodedata.decimal(chr(code), None)
        if digit is not None and code not in MATHEMATICAL:
            to[chr(code)] = str(digit)
            far += chr(code) + "-" if digit == 0 else chr(code) if digit == 9 else ""
    low = "".join(re.escape(c) for c in to if c < "\U00010000")
    return re.compile(f"[{low}{far}{chr(MATHEMATICAL[0])}-{chr(MATHEMATICAL[-1])}]"), to


def _any(words: str) -> str:
    return "|".join(sorted(words.split(), key=len, reverse=True))


_DIGIT_OF = {w: d for d, words in DIGIT_WORDS.items() for w in words.split()}
_DIGIT = _any(" ".join(DIGIT_WORDS.values()))
_UNIT = rf"(?:(?:double|triple)[ \t-]+)?(?:{_DIGIT})"
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_UNIT})(?:(?:[ \t]*[,-][ \t]*|[ \t]+)(?:{_UNIT}))*(?![^\W_])", re.I)
_ONE_UNIT = re.compile(rf"(?:(double|triple)[ \t-]+)?({_DIGIT})", re.I)
_PLUS = re.compile(r"(?<![^\W_])plus[ \t]+(?=\(?[0-9])", re.I)
_BRACKETED = re.compile(rf"(?:(?<![ \t])[ \t]++)?[\[({{<][ \t]*(?:({_any(AT_WORDS)}|@)|({_any(DOT_WORDS)}|\.))[ \t]*[\])}}>][ \t]*", re.I)
_DOTTED = re.compile(rf"(?<=[0-9])[ \t]+(?:{_any(DOT_WORDS)})[ \t]+(?=[0-9])", re.I)
_LABEL = r"[A-Za-z0-9-]+"
_WORD_DOT = rf"[ \t]+(?:{_any(DOT_WORDS)})[ \t]+"
_BARE_AT = re.compile(rf"(?<=[{_LOCAL}])[ \t]+(?:{_any(AT_WORDS)})[ \t]+(?={_LABEL}(?:{_WORD_DOT}{_LABEL})+)|"
                      rf"(?<=[{_LOCAL}])(?:[ \t]+@[ \t]*|@[ \t]+)(?={_LABEL}(?:(?:[ \t]*\.|{_WORD_DOT}){_LABEL})+)", re.I)
_DOMAIN_WORDS = re.compile(rf"(?<=@){_LABEL}(?:(?:\.|{_WORD_DOT}){_LABEL})+", re.I)
_IN_DOMAIN = re.compile(_WORD_DOT, re.I)
# The hints are cheap: most texts have none and need no rewriting.
_BRACKET_HINT = re.compile(r"[\[({<][ \t]*(?:a|d|p|@|\.)", re.I)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_CODES = ({w.encode(): b"d" for w in _DIGIT_OF} | {w: b"d" for w in (b"double", b"triple")} | {w.encode(): b"a" for w in AT_WORDS.split()}
          | {w.encode(): b"o" for w in DOT_WORDS.split()} | {b"plus": b"p"})
_NEAR_DIGITS = re.compile(rb"p[dn]|d[dn][dn]|[dn]d[dn]|[dn][dn]d|[dn]o[dn]")


def _hinted(text: str) -> bool:
    """Whether words or brackets of a disguise stand where one could be."""
    if _BRACKET_HINT.search(text) or "@" in text and (" @" in text or "@ " in text or "@\t" in text):
        return True
    words = text.encode().translate(_LETTERS).split()
    if _CODES.keys().isdisjoint(words):
        return False
    codes = b"".join([_CODES.get(w) or (b"n" if w.isdigit() else b".") for w in words])
    return b"o" in codes and (b"a" in codes or "@" in text) or _NEAR_DIGITS.search(codes) is not None


def _spelled(text: str) -> list[tuple[int, int, str]]:
    pieces = []
    for run in _SPELLED.finditer(text):
        at = run.start()
        for m in _ONE_UNIT.finditer(text, run.start(), run.end()):
            if m.start() > at:
                pieces.append((at, m.start(), ""))
            times = {"double": 2, "triple": 3}.get((m[1] or "").lower(), 1)
            pieces.append((m.start(), m.end(), times * _DIGIT_OF[m[2].lower()]))
            at = m.end()
    return pieces


def rewrite(text: str) -> Mapped | None:
    """The text without its disguises; None where there are none."""
    out = Mapped(text)
    if not text.isascii():
        pattern, to = _characters()
        out.rewrite([(m.start(), m.end(), to.get(m.group(), m.group())) for m in pattern.finditer(text)])
    if _hinted(out.text):
        out.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(out.text)])
        out.rewrite(_spelled(out.text))
        out.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(out.text)])
        out.rewrite([(m.start(), m.end(), ".") for m in _DOTTED.finditer(out.text)])
        out.rewrite([(m.start(), m.end(), "@") for m in _BARE_AT.finditer(out.text)])
        out.rewrite([(d.start(), d.end(), ".") for m in _DOMAIN_WORDS.finditer(out.text) for d in _IN_DOMAIN.finditer(out.text, *m.span())])
    return None if out.starts is None else out


def find(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans and all spans per kind, by start."""
    base = detect(text)
    plain = rewrite(text)
    if plain is None:
        return base, base
    found = {}
    for kind, spans in detect(plain.text).items():
        have = base[kind]
        starts = [s for s, _ in have]
        more = []
        for span in spans:
            start, end = plain.origin(*span)
            k = bisect_left(starts, start + 1) - 1
            if k < 0 or have[k][1] < end:
                more.append((start, end))
        found[kind] = sorted({*have, *more})
    return base, found


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``found``: arrays of (kind, start, end) by kind as listed, then start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        def rows(found):
            return [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in found[k]]

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            both = [find(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([rows(x[i]) for x in both], kind) for i in (0, 1))], ["doc_id", "base", "found"])
        return run
    item = "array<struct<kind:string,start:int,end:int>>"
    return arrow_map(document_columns(docs, id_col, text_col), make, f"doc_id long, base {item}, found {item}")
