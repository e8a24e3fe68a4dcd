"""Licence scan: whole texts looked up by the digest of a canonical form.

The canonical form of a text drops copyright clauses, lower-cases, turns punctuation and white space
into single blanks and unifies equivalent spellings; known licences go through the same
columns.  The digest of the whole text, and of each of its lines (short notices stand alone on a
line), is hash-joined to the known digests.  The form is computed once and its digests written; lines as long as
no known text are not hashed.

Edge rows: null, empty and blank texts have the digest of the empty text and match nothing;
equal known texts are all reported; rows with the same id and canonical text share their answer.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybefore.llm.common import document_columns, stored

# Spellings that count as the same word.
SAME_WORDS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense", "acknowledgement": "acknowledgment",
    "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber",
    "cancelled": "canceled", "catalogue": "catalog", "centre": "center", "emphasise": "emphasize", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill",
    "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "modelling": "modeling",
    "noncommercial": "non commercial", "organisation": "organization", "organise": "organize", "practise": "practice", "programme": "program", "realise": "realize",
    "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "https": "http",
}
# Phrases that count as the same.
SAME_PHRASES = {"copyright owner": "copyright holder", "sub license": "sublicense", "per cent": "percent"}
# How a line with a copyright notice begins.
COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright +(\(c\)|©|[0-9]|by )|\(c\) *[0-9]|© *[0-9]|all rights reserved)"
# Words before a dot that ends no sentence; how the text that follows a copyright clause may begin, with or without a dot before it.
ABBREVIATIONS = "inc|ltd|co|corp|llc|llp|gmbh|plc|bros|jr|sr|dr|st|mr|ms|mrs|prof|dept|univ|assoc|al|etc|no|[a-z]"
AFTER_CLAUSE = (r"all rights reserved|permission (?:is|to) |redistribution and use|redistributions? of|licen[sc]ed (?:under|to)|(?:released|distributed|published|available|provided) under|"
                r"dedicated to the public|this (?:work|program|software|file|library|project|code|document|product|source|package|module) |spdx-licen[sc]e|"
                r"use of this |(?:see|subject to) (?:the|license|licence|file|copying) ?|under the ")
#: The clauses a line begins with: holders and years up to the end of the sentence, before such a beginning, or to the end of the line.
COPYRIGHT_CLAUSES = (r"^(?:[^a-z0-9]*(?:all rights reserved[.!]*|(?:copyright +(?:\(c\)|©|[0-9]|by )|\(c\) *[0-9]|© *[0-9])"
                     rf".*?(?:(?=\b(?:{AFTER_CLAUSE}))|(?<!\b(?:{ABBREVIATIONS}|[0-9]{{1,12}}))[.!?](?=[\s\"')\]]|$)|$)))+")
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"

# Published licence texts without title; ``known_texts`` has more.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE.""",
}


#: By licence, the names that notices and title lines use.
NAMES = {
    "MIT": ["MIT License", "MIT License (MIT)", "MIT", "Expat License"], "ISC": ["ISC License", "ISC License (ISC)", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"],
    "Unlicense": ["Unlicense"], "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"], "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    **{f"{short}-{v}": [f"GNU {long}, version {v.removesuffix('.0')}", f"GNU {long} version {v}", f"GNU {long} v{v}", f"GNU {long} v{v.removesuffix('.0')}", f"GNU {short} v{v.removesuffix('.0')}", f"{short}v{v.removesuffix('.0')}", f"{short} {v}"]
       for short, long, versions in (("GPL", "General Public License", ("1.0", "2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("LGPL", "Library General Public License", ("2.0",)),
                                     ("AGPL", "Affero General Public License", ("3.0",)), ("GFDL", "Free Documentation License", ("1.2", "1.3"))) for v in versions},
    **{f"CC-{code}-{v}": [f"CC {code} {v}", f"CC-{code}-{v}", f"Creative Commons {words} {v} International License", f"Creative Commons {words} {v} International", f"Creative Commons {words} {v}"]
       for code, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
                           ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("3.0", "4.0")},
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons CC0 1.0 Universal"],
}
OPENINGS = ["Licensed under", "Released under", "Distributed under", "Available under", "Published under",
            *(f"This {w} is {v} under" for w in ("work", "software", "project", "program", "file") for v in ("licensed", "released", "distributed"))]
#: Whole published texts, one file each.
PUBLISHED = Path(__file__).with_name("published_licenses")
#: Where the terms end and advice on their use begins; what users of the Apache licence fill in.
ADVICE = re.compile(r"(?im)(?<=end of terms and conditions)\s.*\Z|^\s*addendum: how to use this license.*\Z|^exhibit a - source code form license notice.*\Z", re.S)
TO_FILL_IN = re.compile(r"(?im)^\s*copyright \[yyyy\].*\n")


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of whole texts, with and without title and closing advice, and of notices under the licences' names."""
    out = list(KNOWN.items())
    whole = [*KNOWN.items()] + [(p.stem.removesuffix("-UC"), p.read_text(encoding="utf-8")) for p in sorted(PUBLISHED.glob("*.txt"))]
    for name, text in whole:
        if name.startswith("BSD-"):  # clauses are numbered or bulleted
            number = iter(range(1, 9))
            kinds = [text, re.sub(r"(?m)^ *(?:[*-]|[1-9][.)]) ", "* ", text), re.sub(r"(?m)^ *(?:[*-]|[1-9][.)]) ", lambda m: f"{next(number)}. ", text)]
        else:
            kinds = [text]
        forms = {f for t in kinds for f in (t, TO_FILL_IN.sub("", t), ADVICE.sub("", t))}
        out += [(name, form) for form in sorted(forms)]
        if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "Unlicense"):  # published without a title, often found with one
            titles = [name, *NAMES[name]]
            for body in (re.sub(r"\A\s*BSD 3-Clause License\s*\n", "", t) for t in kinds):
                out += [(name, form) for form in [body, *(f"{the}{title}\n{body}" for title in titles for the in ("", "The "))]]
    for name, names in NAMES.items():
        out += [(f"{name}-notice", f"{opening} {the}{n}") for opening in OPENINGS for n in names for the in ("", "the ")]
        out.append((f"{name}-notice", f"SPDX-License-Identifier: {name}"))
    return list(dict.fromkeys(out))


#: Finds texts that hold one of the spellings at all; few do.
_ANY_SPELLING = r"\b(?:" + "|".join(SAME_WORDS) + r")\b"
#: Known texts up to this many are joined by broadcast; a larger table by a shuffle.
BROADCAST_ROWS = 20_000


def canonical_lines(text: Column) -> Column:
    """The text's lines in canonical form, copyright clauses and empty lines left out; what follows a clause on its line stays."""
    lower = F.lower(text)
    own = F.array_join(F.transform(F.split(lower, "\n"), lambda x: F.when(x.rlike(COPYRIGHT_LINE), F.regexp_replace(x, COPYRIGHT_CLAUSES, "")).otherwise(x)), "\n")
    own = F.when(lower.rlike(r"copyright|\(c\)|©|all rights reserved"), own).otherwise(lower)
    plain = F.regexp_replace(own, PUNCTUATION, " ")
    same = F.create_map(*[F.lit(w) for pair in SAME_WORDS.items() for w in pair])
    words = F.array_join(F.transform(F.split(plain, "\n"), lambda x: F.array_join(F.transform(F.split(F.trim(x), " "), lambda w: F.coalesce(same[w], w)), " ")), "\n")
    plain = F.when(plain.rlike(_ANY_SPELLING), words).otherwise(plain)

    def line(x: Column) -> Column:
        out = F.trim(x)
        for phrase, other in SAME_PHRASES.items():
            out = F.replace(out, F.lit(phrase), F.lit(other))
        return out
    return F.filter(F.transform(F.split(plain, "\n"), line), lambda x: x != "")


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(known_texts(), "license string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``text_digest``, ``licenses`` of the whole text and ``notices`` of single lines (sorted arrays)."""
    known = known_licenses(docs.sparkSession) if known is None else known
    texts = known.select("license", F.array_join(canonical_lines(F.coalesce("text", F.lit(""))), " ").alias("text")).filter(F.col("text") != "")
    digests = stored(texts.groupBy(F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("size")).agg(F.array_sort(F.collect_set("license")).alias("found")))
    sizes = [r[0] for r in digests.select("size").distinct().collect()]  # lengths of known texts: fewer than their longest has characters
    digests = digests.select("digest", "found")
    if digests.count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    mine = document_columns(docs, id_col, text_col).select("doc_id", canonical_lines(F.col("text")).alias("lines"))
    hashed = F.transform(F.array_distinct(F.filter("lines", lambda x: F.length(x).isin(sizes))), lambda x: F.unhex(F.sha2(x, 256)))
    mine = stored(mine.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("text_digest"), hashed.alias("line_digests")))
    whole = mine.select("doc_id", "text_digest")
    lines = (mine.select("doc_id", "text_digest", F.explode("line_digests").alias("digest")).join(digests, "digest")
             .groupBy("doc_id", "text_digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("notices"))
             .select(F.col("doc_id").alias("line_doc"), F.col("text_digest").alias("line_text"), "notices"))
    none = F.array().cast("array<string>")
    return (whole.withColumn("digest", F.unhex("text_digest")).join(digests.withColumnRenamed("found", "licenses"), "digest", "left")
            .join(lines, F.col("doc_id").eqNullSafe(F.col("line_doc")) & (F.col("text_digest") == F.col("line_text")), "left")
            .select("doc_id", "text_digest", F.coalesce("licenses", none).alias("licenses"), F.coalesce("notices", none).alias("notices")))
