"""Text-search queries over whole ``documents`` texts (+ ``labels`` for the page)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.fixed_values import BM25_B, BM25_K1, SEARCH_PAGE_SIZE
from larder.functions import text as T
from larder.operators import search as X
from larder.operators.search_index import PREFIX, SearchIndex
from larder.operators.substring_index import SubstringIndex
from larder.plans import sql_text as S
from larder.plans.registry import register
from larder.plans.sql_text import q
from larder.session import ensure_checkpoint_dir, read_table, table_path

TERMS = S.analyse_terms("text")
MATCH_QUERY = "Worthless enau, ouonen"
RANK_QUERY = "worthless enau ouonen the"
FUZZY_QUERY = "wortless enua ouonnen atou zq"


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def _qlist(terms) -> str:
    return "[" + ", ".join(q(t) for t in terms) + "]"


@register("term_stats", f"""
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents)
GROUP BY doc_id, term""")
def term_stats(spark, sf_dir):
    return X.term_stats(_docs(spark, sf_dir), "doc_id", "text")


@register("search_match", f"""
SELECT doc_id, CAST(len(list_distinct(list_filter({TERMS}, lambda t: list_contains({_qlist(X.analyse_query(MATCH_QUERY))}, t)))) AS INTEGER) AS n_matched
FROM documents WHERE n_matched >= 1""")
def search_match(spark, sf_dir):
    return X.match_search(_docs(spark, sf_dir), "doc_id", "text", MATCH_QUERY)


def _bm25_sql(weights_sql: str, k: int = SEARCH_PAGE_SIZE) -> str:
    """BM25 page over documents for a ``w(term, weight)`` table."""
    return f"""
WITH d AS (SELECT doc_id, {TERMS} AS t FROM documents),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS avgdl FROM d),
w AS ({weights_sql}),
h AS (SELECT doc_id, dl, term FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d)
      WHERE term IN (SELECT term FROM w)),
hc AS (SELECT doc_id, dl, term, count(*) AS tf FROM h GROUP BY doc_id, dl, term),
dfs AS (SELECT term, count(*) AS df FROM hc GROUP BY term),
sc AS (SELECT hc.doc_id, sum(w.weight * ln(1.0::DOUBLE + (st.n - CAST(dfs.df AS DOUBLE) + 0.5::DOUBLE)
                                                / (CAST(dfs.df AS DOUBLE) + 0.5::DOUBLE))
              * (CAST(hc.tf AS DOUBLE) / (CAST(hc.tf AS DOUBLE) + {BM25_K1}::DOUBLE
                 * ({1.0 - BM25_B}::DOUBLE + {BM25_B}::DOUBLE * CAST(hc.dl AS DOUBLE) / st.avgdl)))) AS score
       FROM hc JOIN dfs ON dfs.term = hc.term JOIN w ON w.term = hc.term CROSS JOIN st GROUP BY hc.doc_id)
SELECT doc_id, round(score, 6) AS score,
       CAST(row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank,
       (SELECT count(*) FROM sc) AS total
FROM sc ORDER BY score DESC, doc_id LIMIT {k}"""


_RANK_W = " UNION ALL ".join(f"SELECT {q(t)} AS term, 1.0::DOUBLE AS weight" for t in X.analyse_query(RANK_QUERY))


@register("search_ranked", _bm25_sql(_RANK_W))
def search_ranked(spark, sf_dir):
    return X.rank_bm25(_docs(spark, sf_dir), "doc_id", "text", RANK_QUERY)


@register("search_total", f"""
SELECT count(*) AS total FROM documents
WHERE len(list_filter({TERMS}, lambda t: list_contains({_qlist(X.analyse_query(RANK_QUERY))}, t))) > 0""")
def search_total(spark, sf_dir):
    return X.search_total(_docs(spark, sf_dir), "doc_id", "text", RANK_QUERY)


NO_HIT_QUERY = "qqzzx wwvvk"


@register("search_none", f"""
SELECT count(*) FILTER (WHERE hits > 0) AS total, CAST(0 AS BIGINT) AS page_rows, count(*) AS documents
FROM (SELECT len(list_filter({TERMS}, lambda t: list_contains({_qlist(X.analyse_query(NO_HIT_QUERY))}, t))) AS hits
      FROM documents)""")
def search_none(spark, sf_dir):
    """A query without a hit: total 0 and an empty page."""
    docs = _docs(spark, sf_dir)
    page = X.rank_bm25(docs, "doc_id", "text", NO_HIT_QUERY).agg(F.count(F.lit(1)).alias("page_rows"))
    return X.search_total(docs, "doc_id", "text", NO_HIT_QUERY).crossJoin(page) \
        .crossJoin(docs.agg(F.count(F.lit(1)).alias("documents")))


@register("search_postings", _bm25_sql(_RANK_W))
def search_postings(spark, sf_dir):
    """The ranked page from stored postings instead of the texts."""
    postings, stats = X.build_postings(_docs(spark, sf_dir), "doc_id", "text")
    return X.rank_postings(postings, stats, RANK_QUERY)


# --- fuzzy: the oracle maps the (few) non-ASCII letters to free one-byte codes so that
# DuckDB's byte-wise damerau_levenshtein counts characters, like ours.
_FREE_CODES = [c for c in range(1, 128) if not chr(c).isalnum() and c != 32]


def _fuzzy_sql(qrows: str | None = None) -> str:
    qrows = qrows or " UNION ALL ".join(
        f"SELECT {q(t)} AS query_term, {X.auto_fuzziness(len(t))} AS max_d, {len(t)} AS qlen"
        for t in X.analyse_query(FUZZY_QUERY))
    codes = "[" + ", ".join(str(c) for c in _FREE_CODES) + "]"
    return f"""
vocab AS MATERIALIZED (SELECT DISTINCT unnest({TERMS}) AS term FROM documents),
chars AS (SELECT DISTINCT ch FROM (SELECT unnest(string_split(term, '')) AS ch FROM vocab) WHERE ord(ch) > 127),
cmap AS MATERIALIZED (SELECT string_agg(ch, '' ORDER BY ch) AS f,
                string_agg(chr({codes}[CAST(i AS INTEGER)]), '' ORDER BY ch) AS t
         FROM (SELECT ch, row_number() OVER (ORDER BY ch) AS i FROM chars)),
qt AS ({qrows}),
near AS MATERIALIZED (SELECT qt.query_term, v.term, qt.max_d, qt.qlen, length(v.term) AS tlen
          FROM vocab v JOIN qt ON length(v.term) BETWEEN qt.qlen - qt.max_d AND qt.qlen + qt.max_d),
pairs AS (SELECT query_term, term, max_d, qlen, tlen,
                 damerau_levenshtein(translate(term, (SELECT f FROM cmap), (SELECT t FROM cmap)),
                                     translate(query_term, (SELECT f FROM cmap), (SELECT t FROM cmap))) AS distance
          FROM near),
fz AS (SELECT query_term, term, CAST(distance AS INTEGER) AS distance,
              1.0::DOUBLE - distance / least(qlen, tlen) AS weight FROM pairs WHERE distance <= max_d)"""


def _index(spark, sf_dir, rebuild=False) -> SearchIndex:
    """The stored index of ``documents``; built by whichever query needs it first."""
    return SearchIndex.stored(_docs(spark, sf_dir), "doc_id", "text", table_path(sf_dir, "documents"),
                              f"{ensure_checkpoint_dir(spark)}/larder/indexes", rebuild)


_DROP = "list_transform(range(1, length({w}) + 1), lambda i: left({w}, i - 1) || substr({w}, i + 1))"
_HEAD = f"left(term, {PREFIX})"


@register("search_index_build", f"""
WITH t AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
v AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM t GROUP BY term),
o AS (SELECT *, {_DROP.replace("{w}", _HEAD)} AS once FROM v)
SELECT CAST(row_number() OVER (ORDER BY term) AS BIGINT) AS id, term, df, occurrences,
       len(list_distinct([{_HEAD}] || once ||
           flatten(list_transform(once, lambda w: {_DROP.replace("{w}", "w")})))) AS n_variants
FROM o""")
def search_index_build(spark, sf_dir):
    """A fresh index of ``documents``: its vocabulary, with the variants stored for each term."""
    index = _index(spark, sf_dir, rebuild=True)
    stored = index.variants.groupBy("term").agg(F.count(F.lit(1)).alias("n_variants"))
    return index.vocabulary.join(stored, "term").select("id", "term", "df", "occurrences", "n_variants")


@register("fuzzy_terms", f"WITH {_fuzzy_sql()} SELECT * FROM fz")
def fuzzy_terms(spark, sf_dir):
    return _index(spark, sf_dir).fuzzy_terms(X.analyse_query(FUZZY_QUERY, spark))


@register("fuzzy_terms_scan", f"WITH {_fuzzy_sql()} SELECT * FROM fz")
def fuzzy_terms_scan(spark, sf_dir):
    """The same terms from a vocabulary without an index."""
    vocab = _docs(spark, sf_dir).select(F.explode(T.analyse_terms("text")).alias("term"))
    return X.fuzzy_terms(spark, vocab, X.analyse_query(FUZZY_QUERY, spark))


def _labels_page_sql(inner: str) -> str:
    return f"""SELECT p.*, l.quality = 1 AS keto, l.toxic = 0 AS vegan FROM ({inner}) p
LEFT JOIN labels l ON l.doc_id = p.doc_id"""


_FZ_BM25 = _bm25_sql("SELECT term, sum(weight) AS weight FROM fz GROUP BY term")
# splice the fuzzy CTEs in front of the BM25 ones
_FZ_BM25 = _FZ_BM25.replace("WITH d AS", f"WITH {_fuzzy_sql()},\nd AS", 1)


@register("search_fuzzy", _labels_page_sql(_FZ_BM25))
def search_fuzzy(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("keto"), (F.col("toxic") == 0).alias("vegan"))
    return _index(spark, sf_dir).search(FUZZY_QUERY, labels=labels)


SEARCH_IDS = "5000, 12000,20000"
_IDS = [int(x) for x in SEARCH_IDS.split(",")]
_QT_FROM_IDS = f"""
SELECT term AS query_term,
       CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS max_d,
       length(term) AS qlen
FROM (SELECT term, row_number() OVER (ORDER BY term) AS id
      FROM (SELECT DISTINCT unnest({TERMS}) AS term FROM documents))
WHERE id IN ({', '.join(str(i) for i in _IDS)})"""
_IDS_BM25 = _bm25_sql("SELECT term, sum(weight) AS weight FROM fz GROUP BY term") \
    .replace("WITH d AS", f"WITH {_fuzzy_sql(_QT_FROM_IDS)},\nd AS", 1)


@register("search_by_ids", _labels_page_sql(_IDS_BM25))
def search_by_ids(spark, sf_dir):
    labels = read_table(spark, sf_dir, "labels").select(
        "doc_id", (F.col("quality") == 1).alias("keto"), (F.col("toxic") == 0).alias("vegan"))
    return _index(spark, sf_dir).search_by_ids(SEARCH_IDS, labels=labels)


LOOKUP_IDS, LOOKUP_TERMS = [1, 77, 5000, 12000, 20000, 10 ** 9], ["enau", "the", "ouonen", "worthless", "no such term"]


@register("point_lookup", f"""
WITH v AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TERMS}) AS term FROM documents) GROUP BY term),
n AS (SELECT CAST(row_number() OVER (ORDER BY term) AS BIGINT) AS id, term, df FROM v)
SELECT id, term, df FROM n WHERE id IN ({', '.join(map(str, LOOKUP_IDS))}) OR term IN ({', '.join(map(q, LOOKUP_TERMS))})""")
def point_lookup(spark, sf_dir):
    """A few ids and terms of the stored vocabulary."""
    return _index(spark, sf_dir).entries(LOOKUP_IDS, LOOKUP_TERMS).select("id", "term", "df")


# --- substring search over the vocabulary of the documents

SUGGEST_QUERY = "nch"
_VOCAB_SQL = f"""(SELECT CAST(row_number() OVER (ORDER BY term) AS BIGINT) AS id, term
 FROM (SELECT DISTINCT unnest({TERMS}) AS term FROM documents))"""


def _substrings(spark, sf_dir, rebuild=False) -> SubstringIndex:
    """The stored substring index of the vocabulary."""
    return SubstringIndex.stored(_index(spark, sf_dir).vocabulary.select("id", "term"), "id", "term",
                                 table_path(sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/larder/indexes",
                                 rebuild=rebuild)


@register("substring_index_build", f"""
SELECT gram, count(*) AS n FROM (
  SELECT DISTINCT id, unnest(list_transform(range(1, length(term) + 1),
                                            lambda i: substr(term || chr(1) || chr(1), i, 3))) AS gram FROM {_VOCAB_SQL})
GROUP BY gram""")
def substring_index_build(spark, sf_dir):
    """A fresh index of the vocabulary: its pieces and in how many terms each is."""
    return _substrings(spark, sf_dir, rebuild=True).grams.select(F.translate("gram", "\x00", "\x01").alias("gram"), "n")


@register("suggest_terms", f"""
SELECT id, term, CAST(length(term) AS INTEGER) AS length FROM {_VOCAB_SQL} WHERE contains(term, {q(SUGGEST_QUERY)})""")
def suggest_terms(spark, sf_dir):
    """Terms that hold what was typed, shortest first, from the stored index."""
    found = _substrings(spark, sf_dir).search(SUGGEST_QUERY)
    return found.select("id", F.col("text").alias("term"), F.length("text").alias("length")).orderBy("length", "id")


@register("term_pairs", f"""
SELECT t.term, v.id FROM (SELECT DISTINCT {S.singular_word('term')} AS term FROM {_VOCAB_SQL} WHERE id % 100 = 0) t
JOIN {_VOCAB_SQL} v ON contains(v.term, t.term)""")
def term_pairs(spark, sf_dir):
    """The singular form of every term whose id is divisible by 100, against all terms that hold it."""
    index = _substrings(spark, sf_dir)
    asked = index.texts.where("id % 100 = 0").select(T.singularize("text").alias("term"))
    return index.matches(asked)
