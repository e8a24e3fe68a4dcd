"""The operators over their whole tables, and SQL twins where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybefore.llm import (collocations, context_mixing, decontaminate, fixity, html_extraction, lexical_search, licenses, line_dedup, ngram_join, one_bit_search, pii, quality,
                           sentencepiece_bpe)

#: The tokenizer file; a parameter of the deployment, never copied here.
MODEL_PATH = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans; all spans, disguised ones included."""
    out = pii.spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("found").alias("spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


SPLIT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"
_WORDS2 = SPLIT.format(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS2} AS w FROM documents),
b AS (SELECT * FROM (SELECT item_id, {_WORDS2} AS w FROM benchmark) WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM pat),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
hits AS (SELECT dw.rid, dw.i, dw.n, pat.item_id FROM dw JOIN pat ON dw.n = pat.n AND dw.p = pat.p),
marked AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
          FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN named USING (rid)
"""

#: Pages in one archive file.
SEGMENT_PAGES = 1000


def warc_records(pages: DataFrame) -> DataFrame:
    """Pages as response records laid out in archive files: ``file``, ``offset``, ``length``, ``digest``, and the spoiled copy's ``bad_digest``."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))

    def record(body: Column) -> Column:
        head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"))
        return F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))
    rows = pages.select(F.col("page_id"), F.coalesce(F.floor(F.col("page_id") / SEGMENT_PAGES).cast("string"),
                                                     F.concat(F.lit("x"), F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20)).cast("string"))).alias("file"),
                        F.octet_length(record(html)).cast("long").alias("length"), F.sha2(record(html), 256).alias("digest"),
                        F.sha2(record(F.concat(F.lit("?"), F.substring(html, 2, 2147483647))), 256).alias("bad_digest"))
    order = "sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING) - length"
    return rows.select("file", F.expr(order).alias("offset"), "length", "digest", "bad_digest")


def op3_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of the pages' archive against a copy in which content chooses the damage.

    Records whose digest starts with 00-07 have one letter changed in the copy, with 08-0b they are
    gone, with 0c-0f a stray record follows one byte after their start.
    """
    rows = warc_records(table(spark, sf_dir, "pages"))
    kind = F.substring("digest", 1, 2)
    copy = rows.filter(~kind.between("08", "0b")).withColumn("digest", F.when(kind.between("00", "07"), F.col("bad_digest")).otherwise(F.col("digest")))
    stray = rows.filter(kind.between("0c", "0f")).withColumn("offset", F.col("offset") + 1)
    return fixity.audit(rows, copy.unionByName(stray))


_RECORD = r"""concat('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ', u, chr(13) || chr(10) || 'Content-Length: ',
 CAST(strlen({0}) AS VARCHAR), chr(13) || chr(10) || chr(13) || chr(10), {0}, chr(13) || chr(10) || chr(13) || chr(10))"""
OP3_SQL = f"""
WITH p AS (SELECT page_id, CAST(CAST(floor(page_id / {SEGMENT_PAGES}) AS BIGINT) AS VARCHAR) AS file, coalesce(url, '') AS u, coalesce(html, '') AS h,
                  '?' || substring(coalesce(html, ''), 2) AS bad FROM pages),
r AS (SELECT page_id, file, strlen({_RECORD.format('h')}) AS length, sha256({_RECORD.format('h')}) AS digest, sha256({_RECORD.format('bad')}) AS bad_digest FROM p),
o AS (SELECT file, CAST(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset", length, digest, bad_digest,
             substring(digest, 1, 2) AS kind FROM r),
a AS (SELECT file, "offset", upper(sha256(concat_ws(':', CAST("offset" AS VARCHAR), CAST(length AS VARCHAR), digest))) AS leaf FROM o),
c AS (SELECT file, "offset", upper(sha256(concat_ws(':', CAST("offset" AS VARCHAR), CAST(length AS VARCHAR), digest))) AS other_leaf FROM (
    SELECT file, "offset", length, CASE WHEN kind BETWEEN '00' AND '07' THEN bad_digest ELSE digest END AS digest FROM o WHERE kind NOT BETWEEN '08' AND '0b'
    UNION ALL SELECT file, "offset" + 1, length, digest FROM o WHERE kind BETWEEN '0c' AND '0f'))
SELECT file, "offset", CASE WHEN leaf IS NULL THEN 'extra' WHEN other_leaf IS NULL THEN 'missing' ELSE 'changed' END AS finding, leaf, other_leaf
FROM a FULL JOIN c USING (file, "offset") WHERE leaf IS DISTINCT FROM other_leaf
"""


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), MODEL_PATH)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


_WORDS5 = SPLIT.format(r"[^\x20\x09-\x0D]+")
OP5_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS reached FROM e UNION SELECT e.a, r.reached FROM r JOIN e ON e.b = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(reached) AS c FROM r GROUP BY node) c ON c.node = d.doc_id
"""


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT rid, doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS key FROM l),
wide AS (SELECT key, min(doc_id) AS keeper FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {line_dedup.MIN_SITES}),
j AS (SELECT k.*, wide.key IS NOT NULL AND (k.doc_id IS NULL OR k.doc_id IS DISTINCT FROM keeper) AS gone FROM k LEFT JOIN wide ON k.key = wide.key),
t AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) FILTER (key <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM j GROUP BY rid)
SELECT doc_id, n_lines, n_removed, length(text) AS n_chars_left, sha256(text) AS text_sha256 FROM t
"""


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text_digest", F.array_join("licenses", ",").alias("licenses"), F.array_join("notices", ",").alias("notices"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    own = f"array_to_string(list_filter(string_split(lower({text}), chr(10)), lambda x: NOT regexp_matches(x, {_literal(licenses.COPYRIGHT_LINE)})), chr(10))"
    plain = f"string_split(regexp_replace({own}, {_literal(licenses.PUNCTUATION)}, ' ', 'g'), chr(10))"
    same = "MAP {" + ", ".join(f"{_literal(a)}: {_literal(b)}" for a, b in licenses.SAME_WORDS.items()) + "}"
    line = f"array_to_string(list_transform(string_split(trim(x), ' '), lambda w: coalesce(({same})[w], w)), ' ')"
    for a, b in licenses.SAME_PHRASES.items():
        line = f"replace({line}, {_literal(a)}, {_literal(b)})"
    return f"list_filter(list_transform({plain}, lambda x: {line}), lambda x: x <> '')"


OP9_SQL = f"""
WITH known AS (SELECT * FROM (VALUES {', '.join(f'({_literal(k)}, {_literal(v)})' for k, v in [*licenses.KNOWN.items(), *(t for t in licenses.known_texts() if t[0].endswith('-notice'))])}) v(license, text)),
kd AS (SELECT sha256(array_to_string({_canonical_sql('text')}, ' ')) AS digest, string_agg(DISTINCT license, ',' ORDER BY license) AS found FROM known GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_canonical_sql("coalesce(text, '')")} AS lines FROM documents),
w AS (SELECT rid, doc_id, lines, sha256(array_to_string(lines, ' ')) AS text_digest FROM d),
n AS (SELECT rid, string_agg(DISTINCT found, ',' ORDER BY found) AS notices FROM (SELECT rid, sha256(unnest(lines)) AS digest FROM w) JOIN kd USING (digest) GROUP BY rid)
SELECT doc_id, text_digest, coalesce(kd.found, '') AS licenses, coalesce(n.notices, '') AS notices
FROM w LEFT JOIN kd ON kd.digest = w.text_digest LEFT JOIN n ON n.rid = w.rid
"""

def op10_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return one_bit_search.search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, (VALUES (1), (2), (3)) ks(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a, unnest(range(1, k)) AS cut FROM f WHERE k > 1 AND f >= {collocations.MIN_COUNT}),
s AS (SELECT c.lang, c.g, c.k, c.a, cut, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS score FROM c
      JOIN f x ON x.lang = c.lang AND x.k = cut AND x.g = array_to_string(string_split(c.g, ' ')[1:cut], ' ')
      JOIN f y ON y.lang = c.lang AND y.k = c.k - cut AND y.g = array_to_string(string_split(c.g, ' ')[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
e AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, a, array_to_string(string_split(g, ' ')[1:2], ' ') AS g FROM b WHERE k = 3
      UNION ALL SELECT lang, a, array_to_string(string_split(g, ' ')[2:3], ' ') FROM b WHERE k = 3) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.g) AS rank FROM b LEFT JOIN e ON e.lang = b.lang AND e.g = b.g AND b.k = 2
      WHERE e.a IS NULL OR 100 * e.a < 50 * b.a)
SELECT lang, CAST(rank AS INT) AS rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM z JOIN t USING (lang) WHERE rank <= {collocations.TOP}
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS2} AS w FROM documents),
t AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(w) AS t FROM d) GROUP BY ALL),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, item, unnest({_WORDS2}) AS t FROM (SELECT DISTINCT item_id, text, text AS item FROM benchmark)),
v AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(c.n) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM t, c WHERE t IN (SELECT t FROM i) GROUP BY t),
m AS (SELECT rid, doc_id, 50 + (50 * len(w) * c.n) // c.l AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT i.item_id, i.item, m.rid, m.doc_id, CAST(sum(v.weight * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m))) AS BIGINT) AS score
      FROM i JOIN v USING (t) JOIN t USING (t) JOIN m ON m.rid = t.rid GROUP BY ALL),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, item ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM z WHERE rank <= {lexical_search.K}
"""


QUERIES = {f.__name__: f for f in (op1_pii, op2_decontamination, op3_fixity, op4_sentencepiece, op5_ngram_join, op6_context_mixing, op7_quality, op8_line_dedup, op9_licenses,
                                   op10_one_bit_search, op11_html_extraction, op12_collocations, op13_lexical_search)}
SQL = {"op2_decontamination": OP2_SQL, "op3_fixity": OP3_SQL, "op5_ngram_join": OP5_SQL, "op8_line_dedup": OP8_SQL, "op9_licenses": OP9_SQL, "op12_collocations": OP12_SQL,
       "op13_lexical_search": OP13_SQL}
