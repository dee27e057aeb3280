"""Stored search index: postings, vocabulary and deletion variants, built once, read by key ranges.

Every table is range-partitioned and sorted by its look-up key and written as
Parquet, so a filter on a few keys reads the row groups that hold them and
nothing else (``keys_in`` keeps each list short enough for the reader to use it).
A frequent term or variant is spread over as many files as its rows need.

``variants`` holds, for each vocabulary term, its first ``PREFIX`` characters and
every string left when one or two of them are deleted.  Two terms within ``d`` edits (swaps of
neighbours included) share such a string with at most ``d`` deletions on
either side: what an optimal alignment leaves of the two prefixes are two
prefixes of one common subsequence, and cutting the longer to the shorter
deletes no more characters than the alignment does.  A fuzzy search so looks up the
variants of its own terms, and the vocabulary is never scanned or shuffled.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.fixed_values import BM25_B, BM25_K1, SEARCH_PAGE_SIZE
from larder.functions import text as T
from larder.operators import search as X
from larder.operators.util import bounded_broadcast, with_dense_ids, written
from larder.session import path_exists

PREFIX = 7                   # characters of a term that give deletion variants: 29 strings at most
LOOKUP_KEYS = 2_000          # keys that are put into a filter; more are joined
PUSHED = 10                  # values of one IN list that the Parquet reader tests one by one
VOCABULARY = "id long, term string, df long, occurrences long"
STATS = "n long, avgdl double, id_type string"
POSTINGS = "term string, doc_id {id}, dl int, tf long"


def keys_in(col: str, keys: list) -> Column:
    """``col`` equals one of ``keys``: IN lists of neighbouring values, short enough to prune row groups."""
    keys = sorted(set(keys))
    if not keys:
        return F.lit(False)
    return reduce(or_, [F.col(col).isin(keys[i:i + PUSHED]) for i in range(0, len(keys), PUSHED)])


def sorted_write(df: DataFrame, path: str, keys: list[str], bloom: list[str] = ()) -> None:
    """Write ``df`` range-partitioned and sorted by ``keys``, with Bloom filters on ``bloom`` columns."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite") \
        .option("parquet.block.size", 16 << 20)
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.parquet(path)


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of a source's path, bytes, files and last change, from the file system's own books: no data is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(conf)
    size = fs.getContentSummary(where)
    seen = (path, size.getLength(), size.getFileCount(), fs.getFileStatus(where).getModificationTime())
    return hashlib.md5(repr(seen).encode()).hexdigest()


def marker_row(spark: SparkSession, path: str, schema: str):
    """The one row that marks a table set complete; None if it was never written."""
    return spark.read.schema(schema).parquet(path).first() if path_exists(spark, path) else None


def prefix_variants(term: str, deletions: int, prefix: int = PREFIX) -> set[str]:
    """The first characters of a search term and what is left after up to ``deletions`` of them are deleted."""
    out = level = {term[:prefix]}
    for _ in range(deletions):
        level = {w[:i] + w[i + 1:] for w in level for i in range(len(w))}
        out = out | level
    return out


def stored_variants(col, prefix: int = PREFIX) -> Column:
    """The first characters of a term and what is left after up to two of them are deleted, as plain expressions.

    Every pair of places is written out, so the vocabulary's variants are compiled code and no nested lambdas;
    a place behind the end deletes nothing, and what that repeats is dropped.
    """
    head = F.substring(col, 1, prefix)
    out = [head] + [F.concat(F.substring(head, 1, i - 1), F.substring(head, i + 1, prefix)) for i in range(1, prefix + 1)]
    out += [F.concat(F.substring(head, 1, i - 1), F.substring(head, i + 1, j - i - 1), F.substring(head, j + 1, prefix))
            for i in range(1, prefix + 1) for j in range(i + 1, prefix + 1)]
    return F.array_distinct(F.array(*out))


def edit_budget(term: str, fuzziness: str | int) -> int:
    d = X.auto_fuzziness(len(term)) if str(fuzziness).upper() == "AUTO" else int(fuzziness)
    if not 0 <= d <= X.MAX_FUZZINESS:
        raise ValueError(f"fuzziness must be AUTO or 0 to {X.MAX_FUZZINESS}")
    return d


class SearchIndex:
    """The tables of one indexed collection below ``path``; see ``build`` and ``open``."""

    def __init__(self, spark: SparkSession, path: str, id_type: str):
        self.spark, self.path = spark, path
        self.vocabulary = spark.read.schema(VOCABULARY).parquet(f"{path}/vocabulary")
        self.variants = spark.read.schema("variant string, term string").parquet(f"{path}/variants")
        self.postings = spark.read.schema(POSTINGS.format(id=id_type)).parquet(f"{path}/postings")
        self.stats = spark.read.schema(STATS).parquet(f"{path}/stats")

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, path: str) -> "SearchIndex":
        """Analyse whole texts once and write the four tables; ``stats`` is written last and marks them complete."""
        spark = docs.sparkSession
        terms = docs.select(F.col(id_col).alias("doc_id"), T.analyse_terms(text_col).alias("_t")) \
            .select("doc_id", F.size("_t").alias("dl"), F.explode("_t").alias("term"))
        id_type = terms.schema["doc_id"].dataType.simpleString()
        sorted_write(terms.groupBy("term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf")),
                     f"{path}/postings", ["term", "doc_id"])
        postings = spark.read.schema(POSTINGS.format(id=id_type)).parquet(f"{path}/postings")
        counted = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))
        with_dense_ids(counted, ["term"], "id").select("id", "term", "df", "occurrences") \
            .write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true") \
            .option("parquet.block.size", 1 << 20).parquet(f"{path}/vocabulary")
        vocabulary = spark.read.schema(VOCABULARY).parquet(f"{path}/vocabulary")
        sorted_write(vocabulary.select(F.explode(stored_variants("term")).alias("variant"), "term"), f"{path}/variants", ["variant", "term"])
        n, total = docs.count(), vocabulary.agg(F.sum("occurrences")).first()[0] or 0
        spark.createDataFrame([(n, total / n if n else 0.0, id_type)], STATS) \
            .write.mode("overwrite").parquet(f"{path}/stats")
        return cls(spark, path, id_type)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "SearchIndex | None":
        """The index that ``build`` completed below ``path``, also from another session; None if there is none."""
        stats = marker_row(spark, f"{path}/stats", STATS)
        return cls(spark, path, stats["id_type"]) if stats else None

    @classmethod
    def stored(cls, docs: DataFrame, id_col: str, text_col: str, source: str, root: str,
               rebuild: bool = False) -> "SearchIndex":
        """The index of a source below ``root``, built if it is not there, the source's files changed or ``rebuild``."""
        path = f"{root.rstrip('/')}/search-{source_fingerprint(docs.sparkSession, source)}"
        return (None if rebuild else cls.open(docs.sparkSession, path)) or cls.build(docs, id_col, text_col, path)

    def fuzzy_terms(self, terms: list[str], fuzziness: str | int = "AUTO") -> DataFrame:
        """``query_term, term, distance, weight``: vocabulary terms within the edit budget of each query term.

        The same rows as ``search.fuzzy_terms``, from the stored variants of the query's own keys.
        """
        rows = [(v, t, edit_budget(t, fuzziness), len(t)) for t in dict.fromkeys(terms)
                for v in sorted(prefix_variants(t, edit_budget(t, fuzziness)))]
        asked = self.spark.createDataFrame(rows, "variant string, query_term string, max_d int, qlen int")
        found = self.variants
        if len(rows) <= LOOKUP_KEYS:
            found, asked = found.where(keys_in("variant", [r[0] for r in rows])), F.broadcast(asked)
        tlen = F.length("term")
        pairs = found.join(asked, "variant").where(F.abs(tlen - F.col("qlen")) <= F.col("max_d")) \
            .select("query_term", "term", "max_d", "qlen").distinct()
        scored = pairs.withColumn("distance", X.edit_distance(F.col("query_term"), F.col("term"))) \
            .where(F.col("distance") <= F.col("max_d"))
        return scored.select("query_term", "term", F.col("distance").cast("int"),
                             (F.lit(1.0) - F.col("distance") / F.least("qlen", tlen)).alias("weight"))

    def hits(self, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(postings, weights with ``df``) of the weighted terms: look-ups for a few terms, joins beyond ``LOOKUP_KEYS``."""
        few = {r["term"]: r["weight"] for r in weights.select("term", "weight").limit(LOOKUP_KEYS + 1).collect()}
        if len(few) > LOOKUP_KEYS:
            # weighted terms are few beside the postings: these are read once and not shuffled
            return self.postings, bounded_broadcast(weights.join(self.vocabulary.select("term", "df"), "term"), materialize=True)
        counts = self.entries(terms=list(few)).select("term", "df").collect()
        rows = [(r["term"], few[r["term"]], r["df"]) for r in counts]
        return self.postings.where(keys_in("term", list(few))), F.broadcast(
            self.spark.createDataFrame(rows, "term string, weight double, df long"))

    def search(self, query: str, k: int = SEARCH_PAGE_SIZE, fuzzy: bool = True, labels: DataFrame | None = None,
               k1: float = BM25_K1, b: float = BM25_B, digits: int | None = 6) -> DataFrame:
        """The BM25 page of a query, every term widened to its near vocabulary terms unless ``fuzzy`` is false."""
        terms = X.analyse_query(query, self.spark)
        if fuzzy:
            weights = self.fuzzy_terms(terms).groupBy("term").agg(F.sum("weight").alias("weight"))
        else:
            weights = X.equal_weights(self.spark, terms)
        hits, weights = self.hits(weights)
        best = X.page(X.bm25(hits, weights, self.stats.select("n", "avgdl"), k1, b), k, digits)
        return best if labels is None else best.join(labels, "doc_id", "left")

    def entries(self, ids: list[int] = (), terms: list[str] = ()) -> DataFrame:
        """Vocabulary rows of some ids and terms: sorted by both, so row groups without them are not read."""
        return self.vocabulary.where(keys_in("id", list(ids)) | keys_in("term", list(terms)))

    def terms_of(self, ids_text: str) -> list[str]:
        """The vocabulary terms of a list of ids, in its order; an unknown id raises ``ValueError``."""
        from larder.operators.recipes import parse_ids
        asked = parse_ids(self.spark, ids_text).orderBy("pos").collect()              # one request line
        ids = [r["term_id"] for r in asked if r["term_id"] is not None]
        found = {r["id"]: r["term"] for r in self.entries(ids).select("id", "term").collect()}
        missing = [r["raw"] for r in asked if r["term_id"] not in found][:5]
        if missing:
            raise ValueError(f"unknown ingredient ids: {missing}")
        return [found[r["term_id"]] for r in asked]

    def search_by_ids(self, ids_text: str, **options) -> DataFrame:
        """Ids to terms, joined by blanks, then ``search``."""
        return self.search(" ".join(self.terms_of(ids_text)), **options)
