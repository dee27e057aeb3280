"""Text search: term statistics, match, BM25 ranking, fuzzy expansion, id search.

A scan for a few query terms filters each document's analysed term array
before anything is exploded.  Fuzzy search builds the postings once per call
(or takes stored ones from ``build_postings``): vocabulary, hits and corpus
statistics all come from that table, so the texts are read once.  A search
that finds nothing gives an empty page of the usual columns and a total of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.fixed_values import BM25_B, BM25_K1, SEARCH_PAGE_SIZE
from larder.functions import text as T
from larder.operators.util import param_table, written

MAX_FUZZINESS = 2


def analyse_query(query: str, spark: SparkSession | None = None) -> list[str]:
    """Query text to its distinct terms, in order.

    With a session the query goes through the very expression that analyses
    the documents (same lowercasing, same split), as a one-row job; without
    one, an equivalent Python analysis is used.
    """
    if spark is not None and query:
        row = spark.createDataFrame([(query,)], "q string").select(T.analyse_terms("q").alias("t")).first()
        terms = list(row["t"] or [])
    else:
        import regex
        terms = [t for t in regex.split(r"[^\p{L}\p{N}]+", (query or "").lower()) if t]
    return list(dict.fromkeys(terms))


def term_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Postings ``(doc_id, term, tf)`` of every document (whole texts)."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(T.analyse_terms(text_col)).alias("term")) \
        .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def build_postings(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Index tables: postings ``(doc_id, dl, term, tf)`` and one row ``(n, avgdl)`` of statistics.

    ``dl`` (terms of the document) lies in the posting, so scoring joins no
    table of lengths.  Postings are written once; the average length is their
    sum of ``tf`` over the document count, and documents without terms count.
    """
    postings = written(
        docs.select(F.col(id_col).alias("doc_id"), T.analyse_terms(text_col).alias("_t"))
        .select("doc_id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
        .groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    n, terms = docs.count(), postings.agg(F.sum("tf")).first()[0] or 0
    return postings, docs.sparkSession.createDataFrame([(n, terms / n if n else 0.0)], "n long, avgdl double")


def _scan_hits(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: hits ``(doc_id, dl, term, tf)`` of the terms, and the statistics row."""
    terms_ = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    per_doc = written(docs.select(F.col(id_col).alias("doc_id"), T.analyse_terms(text_col).alias("_t"))
                      .select("doc_id", F.size("_t").alias("dl"),
                              F.filter("_t", lambda t: F.array_contains(terms_, t)).alias("_h")), "hits")
    hits = per_doc.select("doc_id", "dl", F.explode("_h").alias("term")) \
        .groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    dl = F.when(F.col("dl") > 0, F.col("dl"))
    stats = per_doc.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(dl) / F.count(F.lit(1)), F.lit(0.0)).alias("avgdl"))
    return hits, stats


def equal_weights(spark: SparkSession, terms: list[str]) -> DataFrame:
    return param_table(spark, [(t, 1.0) for t in terms], "term string, weight double")


def rank_postings(postings: DataFrame, stats: DataFrame, query: str, k: int = SEARCH_PAGE_SIZE,
                  k1: float = BM25_K1, b: float = BM25_B, digits: int | None = 6) -> DataFrame:
    """BM25 page from prebuilt index tables (``build_postings``): no text is read.

    Only the postings of the query terms are touched (a filter on ``term``
    that reaches the scan when the postings are stored as Parquet).
    """
    spark = postings.sparkSession
    terms = analyse_query(query, spark)
    hits = postings.where(F.col("term").isin(terms) if terms else F.lit(False))
    return page(bm25(hits, equal_weights(spark, terms), stats, k1, b), k, digits)


def match_search(docs: DataFrame, id_col: str, text_col: str, query: str, operator: str = "or") -> DataFrame:
    """Documents matching any (``or``) / all (``and``) query terms: ``(doc_id, n_matched)``."""
    terms = analyse_query(query, docs.sparkSession)
    terms_ = F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    matched = F.size(F.array_distinct(F.filter(T.analyse_terms(text_col), lambda t: F.array_contains(terms_, t))))
    out = docs.select(F.col(id_col).alias("doc_id"), matched.alias("n_matched"))
    return out.filter(F.col("n_matched") >= (1 if operator == "or" else max(1, len(terms))))


def search_total(docs: DataFrame, id_col: str, text_col: str, query: str, operator: str = "or") -> DataFrame:
    """One row ``total``: the documents that match, 0 if none does."""
    return match_search(docs, id_col, text_col, query, operator).agg(F.count(F.lit(1)).alias("total"))


def bm25(hits: DataFrame, weights: DataFrame, stats: DataFrame, k1: float, b: float) -> DataFrame:
    """Per-document score from ``hits(doc_id, dl, term, tf)``, ``weights(term, weight[, df])`` and the statistics row.

    Without ``df`` the documents of each term are counted in the hits.
    """
    n, avgdl = stats.first()                                                 # two scalars
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") / (F.col("tf") + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl or 1.0)))
    if "df" not in weights.columns:
        weights = weights.join(hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    contrib = hits.join(weights, "term")
    return contrib.groupBy("doc_id").agg(F.sum(F.col("weight") * idf * norm).alias("score"))


def page(scores: DataFrame, k: int, digits: int | None) -> DataFrame:
    """The best ``k`` of the scores with rank and the total of all of them; ties by doc_id."""
    scores = written(scores, "scores")
    s = F.round("score", digits) if digits is not None else F.col("score")
    top = scores.select("doc_id", s.alias("score")).orderBy(F.desc("score"), F.asc("doc_id")).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("doc_id")))) \
        .withColumn("total", F.lit(scores.count()).cast("long"))


def rank_bm25(docs: DataFrame, id_col: str, text_col: str, query: str, k: int = SEARCH_PAGE_SIZE,
              k1: float = BM25_K1, b: float = BM25_B, digits: int | None = 6,
              with_total: bool = True) -> DataFrame:
    """BM25 top-k ``(doc_id, score, rank[, total])``; ties by doc_id."""
    spark = docs.sparkSession
    terms = analyse_query(query, spark)
    hits, stats = _scan_hits(docs, id_col, text_col, terms)
    best = page(bm25(hits, equal_weights(spark, terms), stats, k1, b), k, digits)
    return best if with_total else best.drop("total")


# ------------------------------------------------------------------ fuzzy

def auto_fuzziness(n: int) -> int:
    """Edit budget by term length: up to 2 chars 0, 3 to 5 chars 1, longer 2."""
    return 0 if n <= 2 else (1 if n <= 5 else 2)


def _swapped(word: Column) -> Column:
    """All strings from ``word`` by swapping two neighbouring characters."""
    n = F.length(word)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(
        word.substr(F.lit(1), i - 1), word.substr(i + 1, F.lit(1)), word.substr(i, F.lit(1)), word.substr(i + 2, n)))) \
        .otherwise(F.array().cast("array<string>"))


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance with swaps of neighbours costing 1, by code point: 0, 1, 2, or null above 2.

    A swap pairs characters that are neighbours in ``a`` or in ``b`` (others may be deleted or inserted
    between them in the other word), so each of up to two swaps is undone on one of the sides and
    plain edits make up the rest.
    """
    sa, sb = _swapped(a), _swapped(b)
    one = F.exists(sa, lambda s: s == b)
    two = (F.exists(sa, lambda s: F.levenshtein(s, b, 1) >= 0) | F.exists(sb, lambda s: F.levenshtein(a, s, 1) >= 0)
           | F.arrays_overlap(sa, sb))
    plain = F.levenshtein(a, b, 2)
    return F.when(a == b, 0).when((plain == 1) | one, 1).when((plain == 2) | two, 2)


def deletion_variants(col, max_deletions: int):
    """The word and every string made from it by deleting up to ``max_deletions`` characters."""
    def drop_one(w):
        n = F.length(w)
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                          lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, n)))) \
            .otherwise(F.array().cast("array<string>"))
    c = F.col(col) if isinstance(col, str) else col
    out = F.array(c)
    level = F.array(c)
    for _ in range(max_deletions):
        level = F.array_distinct(F.flatten(F.transform(level, drop_one)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def fuzzy_terms(spark: SparkSession, vocab: DataFrame, terms: list[str], term_col: str = "term",
                fuzziness: str | int = "AUTO") -> DataFrame:
    """Vocabulary terms within the edit budget of each query term.

    Output ``(query_term, term, distance, weight)`` with
    ``weight = 1 - distance / min(len(query_term), len(term))``.  No expansion cap.
    The budget is ``auto_fuzziness`` of the term's length, or a number up to
    ``MAX_FUZZINESS``; a larger one is refused.

    Both sides emit their deletion variants (up to the edit budget) and an equi
    join on variant and length finds the candidate pairs: two strings within
    ``d`` edits (swaps included) share a variant with at most ``d`` deletions
    on each side.  Only vocabulary terms of a length that some query term can
    reach emit variants.  Candidates are verified by ``edit_distance``.
    """
    rows = []
    for t in dict.fromkeys(terms):
        d = auto_fuzziness(len(t)) if str(fuzziness).upper() == "AUTO" else int(fuzziness)
        if not 0 <= d <= MAX_FUZZINESS:
            raise ValueError(f"fuzziness must be AUTO or 0 to {MAX_FUZZINESS}")
        rows.append((t, d, len(t)))
    top = max([d for _, d, _ in rows], default=0)
    reach = sorted({n + i for _, d, n in rows for i in range(-d, d + 1)})
    v = vocab.select(F.col(term_col).alias("term"), F.length(term_col).alias("tlen")) \
        .where(F.col("tlen").isin(reach) if reach else F.lit(False)).distinct()
    qt = spark.createDataFrame(rows, "query_term string, max_d int, qlen int")
    own = F.coalesce(*[F.when(F.col("max_d") == d, deletion_variants("query_term", d)) for d in range(top + 1)])
    qv = qt.select("*", F.explode(own).alias("key")) \
        .withColumn("tlen", F.explode(F.sequence(F.col("qlen") - F.col("max_d"), F.col("qlen") + F.col("max_d"))))
    pairs = v.select("*", F.explode(deletion_variants("term", top)).alias("key")).join(qv, ["key", "tlen"]) \
        .select("query_term", "term", "max_d", "qlen", "tlen").distinct()
    scored = pairs.withColumn("distance", edit_distance(F.col("query_term"), F.col("term"))) \
        .filter(F.col("distance") <= F.col("max_d"))
    return scored.select("query_term", "term", F.col("distance").cast("int"),
                         (F.lit(1.0) - F.col("distance") / F.least("qlen", "tlen")).alias("weight"))


def search_fuzzy(docs: DataFrame, id_col: str, text_col: str, query: str, labels: DataFrame | None = None,
                 k: int = SEARCH_PAGE_SIZE, k1: float = BM25_K1, b: float = BM25_B,
                 digits: int | None = 6, vocab: DataFrame | None = None,
                 index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Fuzzy BM25 search: every query term expands to its near vocabulary terms,
    each scored by BM25 and weighted; page of ``k`` with labels and ``total``.

    ``index`` is what ``build_postings`` gave for the same documents; without
    it the postings are built here.
    """
    spark = docs.sparkSession
    postings, stats = index or build_postings(docs, id_col, text_col)
    terms = analyse_query(query, spark)
    expanded = fuzzy_terms(spark, postings.select("term") if vocab is None else vocab, terms)
    weights = expanded.groupBy("term").agg(F.sum("weight").alias("weight"))
    hits = postings.join(weights, "term", "left_semi").select("doc_id", "dl", "term", "tf")
    best = page(bm25(hits, weights, stats, k1, b), k, digits)
    return best if labels is None else best.join(labels, "doc_id", "left")


def search_by_ids(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, vocab_with_ids: DataFrame,
                  ids_text: str, labels: DataFrame | None = None, k: int = SEARCH_PAGE_SIZE,
                  term_col: str = "ingredient", index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Ids to vocabulary terms (unknown ids raise), joined by blanks, then fuzzy search."""
    from larder.operators.recipes import ids_to_terms
    found = ids_to_terms(spark, vocab_with_ids, ids_text, term_col, strict=True).orderBy("pos")
    query = " ".join(r[term_col] for r in found.collect())  # the ids of one request line
    return search_fuzzy(docs, id_col, text_col, query, labels, k, index=index)
