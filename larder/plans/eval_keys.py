"""Evaluation, statistics, filters and joins on ``labels``, ``documents`` and ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import evaluate as E
from larder.operators import matching as M
from larder.operators import recipes as R
from larder.plans import sql_text as S
from larder.plans.registry import register
from larder.plans.sql_text import q
from larder.session import read_table


def _labels(spark, sf_dir):
    """labels as a truth / prediction pair: truth = quality, prediction = 1 - toxic."""
    return read_table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("pred"),
        (F.col("quality") == 1).alias("keto"), (F.col("toxic") == 0).alias("vegan"))


_LABELS_SQL = ("(SELECT doc_id, quality AS truth, 1 - toxic AS pred, quality = 1 AS keto, toxic = 0 AS vegan "
               "FROM labels)")


@register("classification_report", f"""
WITH d AS (SELECT CAST(truth AS VARCHAR) AS t, CAST(pred AS VARCHAR) AS p FROM {_LABELS_SQL}),
conf AS (SELECT t, p, count(*) AS n FROM d GROUP BY t, p),
classes AS (SELECT t AS label FROM conf WHERE t IS NOT NULL UNION SELECT p FROM conf WHERE p IS NOT NULL),
per0 AS (SELECT c.label,
           coalesce((SELECT sum(n) FROM conf WHERE t = c.label AND p = c.label), 0) AS tp,
           coalesce((SELECT sum(n) FROM conf WHERE t = c.label), 0) AS support,
           coalesce((SELECT sum(n) FROM conf WHERE p = c.label), 0) AS predicted FROM classes c),
per1 AS (SELECT label, tp, support,
           CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS precision,
           CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS recall FROM per0),
per AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                  ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM per1),
tot AS (SELECT sum(tp) AS tp, sum(support) AS n, count(*) AS k, sum(precision) AS sp, sum(recall) AS sr,
               sum(f1) AS sf, sum(precision * support) AS wp, sum(recall * support) AS wr,
               sum(f1 * support) AS wf FROM per)
SELECT label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM per
UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / n END,
                 CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', sp / k, sr / k, sf / k, CAST(n AS BIGINT) FROM tot
UNION ALL SELECT 'weighted avg', wp / n, wr / n, wf / n, CAST(n AS BIGINT) FROM tot""")
def classification_report(spark, sf_dir):
    return E.classification_report(_labels(spark, sf_dir), "truth", "pred")


@register("misclassified", f"""
SELECT doc_id, truth, pred FROM {_LABELS_SQL} WHERE truth IS DISTINCT FROM pred""")
def misclassified(spark, sf_dir):
    return E.misclassified(_labels(spark, sf_dir), "truth", "pred").select("doc_id", "truth", "pred")


DIET_QUERY = " Keto, vegan"


@register("diet_filter", f"""
SELECT doc_id, keto, vegan FROM {_LABELS_SQL} WHERE keto AND vegan""")
def diet_filter(spark, sf_dir):
    return R.diet_filter(_labels(spark, sf_dir), DIET_QUERY).select("doc_id", "keto", "vegan")


EVERY = 100


@register("every_nth", f"""
SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS total
                        FROM documents)
WHERE (rn - 1) % {EVERY} = 0 OR rn = total""")
def every_nth(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return E.every_nth(docs, "doc_id", EVERY).select("doc_id", "rn")


def _changed_copy(docs):
    """A changed copy: German texts with 'e' upper-cased, source src3 dropped."""
    return docs.filter(F.col("source") != "src3").withColumn(
        "text", F.when(F.col("lang") == "de", F.translate("text", "e", "E")).otherwise(F.col("text")))


@register("alignment_check", """
WITH r AS (SELECT doc_id, CASE WHEN lang = 'de' THEN replace(text, 'e', 'E') ELSE text END AS text
           FROM documents WHERE source <> 'src3')
SELECT coalesce(l.doc_id, r.doc_id) AS doc_id,
       l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL AND l.text IS NOT DISTINCT FROM r.text AS same,
       substr(l.text, 1, 38) AS left_preview, substr(r.text, 1, 38) AS right_preview
FROM documents l FULL OUTER JOIN r ON l.doc_id = r.doc_id""")
def alignment_check(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return E.alignment_check(docs, _changed_copy(docs), "doc_id", "text")


@register("join_by_position", """
SELECT l.idx, l.doc_id, l.lang, r.label_doc_id, r.quality, r.toxic
FROM (SELECT row_number() OVER (ORDER BY doc_id) AS idx, doc_id, lang FROM documents) l
LEFT JOIN (SELECT row_number() OVER (ORDER BY doc_id) AS idx, doc_id AS label_doc_id, quality, toxic FROM labels) r
  ON r.idx = l.idx""")
def join_by_position(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_doc_id"), "quality", "toxic")
    return E.join_by_position(docs, labels, ["doc_id"], ["label_doc_id"]) \
        .select("idx", "doc_id", "lang", "label_doc_id", "quality", "toxic")


@register("longest_text", f"""
SELECT source, CAST(n_words AS INTEGER) AS max_words, doc_id FROM (
  SELECT source, doc_id, {S.word_count('text')} AS n_words,
         row_number() OVER (PARTITION BY source ORDER BY {S.word_count('text')} DESC, doc_id) AS r
  FROM documents) WHERE r = 1""")
def longest_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return E.longest_per_group(docs, "source", "doc_id", "text")


BINS = 50


@register("histogram_bins", f"""
WITH s AS (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents),
b AS (SELECT CAST(least(floor((CAST(n_chars AS DOUBLE) - s.lo) / (s.hi - s.lo) * {BINS}) + 1, {BINS}) AS INTEGER)
             AS bin FROM documents, s WHERE n_chars IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(g.bin AS INTEGER) AS bin, s.lo + (g.bin - 1) * ((s.hi - s.lo) / {BINS}) AS lo,
       s.lo + g.bin * ((s.hi - s.lo) / {BINS}) AS hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM range(1, {BINS} + 1) g(bin) CROSS JOIN s LEFT JOIN c ON c.bin = g.bin""")
def histogram_bins(spark, sf_dir):
    return E.histogram(read_table(spark, sf_dir, "documents"), "n_chars", BINS)


@register("column_counts", """
SELECT count(d.doc_id) AS n_doc_id, count(d.text) AS n_text, count(d.lang) AS n_lang, count(d.source) AS n_source,
       count(d.n_chars) AS n_n_chars, count(l.quality) AS n_quality, count(l.toxic) AS n_toxic
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def column_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    joined = docs.join(read_table(spark, sf_dir, "labels"), "doc_id", "left")
    return E.column_counts(joined.select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"))


@register("top_by_words", f"""
SELECT doc_id, CAST({S.word_count('text')} AS INTEGER) AS n_words FROM documents
ORDER BY n_words DESC, doc_id LIMIT 50""")
def top_by_words(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return E.top_by(docs, T.word_count("text"), "doc_id", 50, "n_words")


LIKE = "%tion%"


@register("like_filter", f"""
SELECT doc_id, lang, source FROM documents WHERE text LIKE {q(LIKE)} ORDER BY doc_id LIMIT 10""")
def like_filter(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.filter(F.col("text").like(LIKE)).select("doc_id", "lang", "source").orderBy("doc_id").limit(10)


ANY_TERMS = ["gear", "ROD", "a+b"]
CARB_LIMIT = 950


@register("contains_any", f"""
SELECT p_partkey, p_name, p_retailprice FROM part
WHERE p_retailprice > {CARB_LIMIT} AND coalesce(regexp_matches(lower(p_name), {q(T.alternation([t.lower() for t in ANY_TERMS]))}), false)""")
def contains_any(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    return part.filter((F.col("p_retailprice") > CARB_LIMIT) & M.contains_any("p_name", ANY_TERMS)) \
        .select("p_partkey", "p_name", "p_retailprice")


@register("include_exclude", """
SELECT p_partkey, p_name,
  CASE WHEN coalesce(regexp_matches(lower(p_name), 'gear'), false)
        AND NOT coalesce(regexp_matches(lower(p_name), 'old'), false) THEN 0.0 ELSE p_retailprice END AS p_retailprice
FROM part""")
def include_exclude(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return M.update_where(part, M.include_exclude("p_name", ["gear"], ["old"]), "p_retailprice", 0.0)


EXACT = ["Red Widget", "old bolt", "hot gear", "old bolt"]


@register("exact_terms", f"""
SELECT p_partkey, p_name FROM part WHERE lower(p_name) IN ({', '.join(q(t.lower()) for t in EXACT)})""")
def exact_terms(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return M.exact_terms(part, "p_name", EXACT)


TERMS = ["gear", "Red", "ld b"]


@register("term_matches", f"""
SELECT t.term, p.p_partkey FROM (VALUES {', '.join(f"({q(t)})" for t in TERMS)}) t(term)
JOIN part p ON contains(lower(p.p_name), lower(t.term))""")
def term_matches(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return M.term_matches(spark, part, "p_name", TERMS).select("term", "p_partkey")


NEAR_TERMS = ["gear", "red gear", "bolt", "blue"]


@register("near_exact_terms", f"""
SELECT t.term, p.p_partkey, p.p_name FROM (VALUES {', '.join(f"({q(t)})" for t in NEAR_TERMS)}) t(term)
JOIN part p ON contains(lower(p.p_name), lower(t.term))
 AND {S.word_count('p.p_name')} <= {S.word_count('t.term')} + 1""")
def near_exact_terms(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return M.term_matches(spark, part, "p_name", NEAR_TERMS, max_extra_words=1).select("term", "p_partkey", "p_name")
