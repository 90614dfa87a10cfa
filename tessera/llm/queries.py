"""The queries of this subpackage, one for each operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table
from .class_lm import class_lm
from .decontaminate import mark
from .html_extract import extract_main_text
from .license_scan import TEMPLATES, license_scan
from .line_dedup import dedup_lines
from .mixing import mix_sizes
from .ngram_join import ngram_join
from .pii import find_pii
from .quality_classifier import classify
from .quality_rules import quality_rules


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=("n_lines", "n_removed"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_line_dedup, op3_license_scan, op4_mixing, op5_ngram_join, op6_quality_classifier, op7_class_lm, op8_html_extract, op9_decontaminate, op10_quality_rules)
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES: dict[str, str] = {
    "op5_ngram_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)]) END AS s FROM w),
sets AS (SELECT min(doc_id) AS cid, s, list(doc_id) AS ids FROM (SELECT doc_id, list_sort(s) AS s FROM sh) GROUP BY s),
tokens AS (SELECT cid, len(s) AS n, unnest(s) AS t FROM sets WHERE len(s) > 0),
pairs AS (
  SELECT a.cid AS x, b.cid AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.cid < b.cid
  GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs UNION SELECT cid, cid FROM sets),
reach(a, b) AS (SELECT x, y FROM links UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x),
comp AS (SELECT a AS cid, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE c.component END AS component_id
FROM sh d JOIN sets z ON list_sort(d.s) = z.s JOIN comp c ON c.cid = z.cid""",
    "op9_decontaminate": rf"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
it AS (SELECT CAST(item_id AS VARCHAR) AS item, least(13, len(w)) AS k, w FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, k, unnest([array_to_string(w[i:i+k-1], ' ') for i in range(1, len(w) - k + 2)]) AS g FROM it),
ks AS (SELECT DISTINCT k FROM wins),
places AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, unnest([array_to_string(w[i:i+k-1], ' ') for i in range(1, len(w) - k + 2)]) AS g
  FROM dw, ks WHERE len(w) >= k),
hits AS (SELECT p.doc_id, p.i, p.k, x.item FROM places p JOIN wins x ON p.k = x.k AND p.g = x.g),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)""",
}


def _license_oracle() -> str:
    """Every template is tried at every word."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    vocabulary = sorted({w for t in TEMPLATES for w in t.words})
    idf = lambda w: f"(SELECT i FROM idf WHERE t = '{w}')"
    tries = []
    for t in TEMPLATES:
        score = "1.0e0"
        if t.hi - t.lo < len(t.words):
            score = "least(1.0e0, (" + " + ".join(f"CASE WHEN i + {j - t.lo} >= 1 AND w[i + {j - t.lo}] = '{w}' THEN {idf(w)} ELSE 0 END" for j, w in enumerate(t.words)) + ") / (" + " + ".join(map(idf, t.words)) + "))"
        tries.append(f"SELECT doc_id, '{t.label}' AS label, i - 1 AS pos, {t.base} AS base, {score} AS score FROM p WHERE w[i] = '{t.words[t.lo]}' AND w[i:i+{t.hi - t.lo - 1}] = {listed(t.words[t.lo : t.hi])}")
    return rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
df AS (SELECT t, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS t FROM d) GROUP BY t),
idf AS (SELECT v AS t, ln(CAST(1 + (SELECT count(*) FROM d) AS DOUBLE) / (1 + coalesce(n, 0))) AS i FROM (SELECT unnest({listed(vocabulary)}) AS v) LEFT JOIN df ON t = v),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
f AS ({" UNION ALL ".join(tries)}),
g AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(pos) FILTER (WHERE base) AS first_word, max(pos) FILTER (WHERE base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score, count(*) AS n_places FROM f WHERE score >= 0.6 GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score, coalesce(n_places, 0) AS n_places
FROM d LEFT JOIN g USING (doc_id)"""


def _quality_oracle() -> str:
    kinds = ("[a-z]", r"[\x20\x09-\x0D]", "[A-Z]", "[0-9]", r"[^\x00-\x7F]", r"[.,;:''\"?()\-]")
    n = len(kinds) + 1
    counts = ", ".join(f"len(text) - len(regexp_replace(text, '{k}+', '', 'g')) AS c{i}" for i, k in enumerate(kinds))
    part = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)"
    by_class = " + ".join(part(f"(c.c{i} / CAST(greatest(c.chars, 1) AS DOUBLE))", f"(r.c{i} / CAST(r.chars AS DOUBLE))") for i in range(n))
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
five AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) AS g FROM d WHERE len(w) >= 5),
again AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM five) WHERE c > 1) GROUP BY doc_id),
b AS (SELECT doc_id, lang, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN again USING (doc_id)),
c0 AS (SELECT doc_id, lang, n_words, len(text) AS chars, {counts} FROM b), c AS (SELECT *, chars - c0 - c1 - c2 - c3 - c4 - c5 AS c{n - 1} FROM c0),
lw AS (SELECT b.lang, x.word, count(*) AS n FROM b, unnest(b.w) x(word) GROUP BY 1, 2),
own AS (SELECT lang FROM c WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n_words) >= 2000),
k AS (SELECT *, CASE WHEN lang IN (SELECT lang FROM own) THEN lang END AS key FROM c),
r AS (SELECT key, sum(n_words) AS words, sum(chars) AS chars, {", ".join(f"sum(c{i}) AS c{i}" for i in range(n))} FROM k WHERE key IS NOT NULL GROUP BY key
  UNION ALL SELECT NULL, sum(n_words), sum(chars), {", ".join(f"sum(c{i})" for i in range(n))} FROM k),
kw AS (SELECT lang AS key, word, n FROM lw WHERE lang IN (SELECT lang FROM own) UNION ALL SELECT NULL, word, sum(n) FROM lw GROUP BY word),
rw AS (SELECT kw.key, word, n / CAST(sum(n) OVER (PARTITION BY kw.key) AS DOUBLE) AS q FROM kw JOIN r ON kw.key IS NOT DISTINCT FROM r.key WHERE n * 500 >= r.words),
dw AS (SELECT b.doc_id, x.word, rw.q, count(*) AS n FROM b JOIN k USING (doc_id), unnest(b.w) x(word) JOIN rw ON rw.key IS NOT DISTINCT FROM k.key AND rw.word = x.word GROUP BY 1, 2, 3),
dp AS (SELECT doc_id, q, n / CAST(sum(n) OVER (PARTITION BY doc_id) AS DOUBLE) AS p FROM dw),
wd AS (SELECT doc_id, 1 + sum({part("p", "q")} - q) AS x FROM dp GROUP BY doc_id),
j AS (SELECT b.*, b.n_words < 10 OR 100 * n_repeat_words > 20 * b.n_words AS base_failed, CASE WHEN b.n_words >= 30 THEN sqrt(greatest(({by_class}) / 2, 0)) END AS class_distance,
  CASE WHEN b.n_words >= 30 THEN sqrt(greatest(coalesce(wd.x, 2) / 2, 0)) END AS word_distance FROM b JOIN k c USING (doc_id) JOIN r ON r.key IS NOT DISTINCT FROM c.key LEFT JOIN wd ON wd.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(class_distance, 0) <= 0.22 AND coalesce(word_distance, 0) <= 0.8 AS kept, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM j"""


ORACLES |= {"op3_license_scan": _license_oracle(), "op10_quality_rules": _quality_oracle()}
