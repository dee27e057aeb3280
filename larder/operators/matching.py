"""Name matching filters: contains-any, include/exclude, exact lists, per-term matches.

Term lists are caller parameters; per-term matching is an equi join on the
first characters of the terms, at every size of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators.util import param_table, with_column_once

FEW_TERMS = 64               # terms that are looked for row by row


def contains_any(col, terms, case_insensitive: bool = True) -> Column:
    """Any of the literal ``terms`` occurs in the text; NULL gives false."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.lower(c) if case_insensitive else c
    pat = T.alternation([t.lower() for t in terms] if case_insensitive else terms)
    return F.coalesce(c.rlike(pat), F.lit(False))


def include_exclude(col, include, exclude) -> Column:
    """Contains one of ``include`` and none of ``exclude`` (case-insensitive)."""
    return contains_any(col, include) & ~contains_any(col, exclude)


def update_where(df: DataFrame, mask: Column, col: str, value) -> DataFrame:
    """Conditional in-place update of one column."""
    return df.withColumn(col, F.when(mask, F.lit(value).cast(df.schema[col].dataType)).otherwise(F.col(col)))


def exact_terms(df: DataFrame, col: str, terms) -> DataFrame:
    """Case-insensitive exact membership; a list becomes a broadcast semi join."""
    spark = df.sparkSession
    t = param_table(spark, [(x.lower(),) for x in terms], "_term string").distinct()
    return df.join(t, F.lower(F.col(col)) == F.col("_term"), "left_semi")


def _grams(col, n: int):
    """Distinct ``n``-character substrings of a string (empty array when shorter)."""
    c = F.col(col) if isinstance(col, str) else col
    ln = F.length(c)
    return F.when(ln >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), ln - (n - 1)),
                                                        lambda i: c.substr(i, F.lit(n))))) \
        .otherwise(F.array().cast("array<string>"))


def term_matches(spark: SparkSession, df: DataFrame, col: str, terms, max_extra_words: int | None = None,
                 case_insensitive: bool = True, gram: int = 3) -> DataFrame:
    """One row per (term, matching row): ``contains(text, term)``.

    With ``max_extra_words`` the text may have at most that many more words
    than the term (near-exact match).  An empty term matches every text that
    is not null.

    A list of up to ``FEW_TERMS`` terms is tested inside each row, in one stage.  For more terms, or a
    table of them (never collected), terms and distinct texts are joined on the term's first
    ``gram`` characters (all of them if it is shorter), which a text that holds the term holds too; candidates
    are verified, and the matches go back to the rows by the text's hash and the text.
    """
    norm = F.lower if case_insensitive else (lambda c: c)

    def holds(text: Column, low: Column, term: Column, low_term: Column) -> Column:
        cond = F.contains(low, low_term)
        if max_extra_words is not None:
            cond = cond & (T.word_count(text) <= T.word_count(term) + max_extra_words)
        return cond

    if not isinstance(terms, DataFrame):
        terms = list(dict.fromkeys(terms))
        if len(terms) <= FEW_TERMS:
            asked = F.array(*[F.struct(F.lit(x).alias("term"), norm(F.lit(x)).alias("low")) for x in terms]) \
                .cast("array<struct<term:string,low:string>>")
            rows = with_column_once(df.where(F.col(col).isNotNull()), "_low", norm(F.col(col)))
            met = F.filter(asked, lambda p: holds(F.col(col), F.col("_low"), p["term"], p["low"]))
            return rows.select(F.explode(met).alias("_p"), *df.columns).select("_p.term", *df.columns)
        terms = spark.createDataFrame([(x,) for x in terms], "term string")
    t = terms.select("term").distinct().withColumn("_nt", norm(F.col("term"))).withColumn("_key", F.substring("_nt", 1, gram))
    texts = df.select(F.col(col).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    lengths = [r[0] for r in t.select(F.length("_key").alias("n")).where("n IS NOT NULL").distinct().collect()]  # gram + 1 at most
    keys = [F.array(F.lit("")) if n == 0 else _grams(norm(F.col("_text")), n) for n in lengths]
    keys = F.flatten(F.array(*keys)) if keys else F.array().cast("array<string>")
    found = texts.select("_text", F.explode(keys).alias("_key")).join(t, "_key") \
        .where(holds(F.col("_text"), norm(F.col("_text")), F.col("term"), F.col("_nt"))) \
        .select("term", "_text", F.xxhash64("_text").alias("_hash"))
    hashed = df.withColumn("_hash", F.xxhash64(col))
    return found.join(hashed, "_hash").where(F.col("_text") == F.col(col)).select("term", *df.columns)
