"""Stored three-character index for substring search.

Every text is known by the distinct three-character pieces that start at each of
its characters (the last ones padded with NUL), lower-cased if the search is to
ignore case.  A query of three or more characters reads the postings of its
rarest pieces and intersects them; a shorter one reads the pieces that start with it.  What
is left is verified against the texts, so the answer is that of a full scan.

Tables are sorted by their look-up key (see ``search_index.sorted_write``): a
query reads a few row groups, and a frequent piece is spread over many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.search_index import keys_in, marker_row, sorted_write, source_fingerprint
from larder.operators.util import written

GRAM = 3
RAREST = 3                   # pieces of a query that are intersected
PAD = "\x00" * (GRAM - 1)
META = "n long, ignore_case boolean, id_type string"


def pieces(col) -> Column:
    """The distinct pieces that start at each character."""
    c = F.col(col) if isinstance(col, str) else col
    padded, n = F.concat(c, F.lit(PAD)), F.length(c)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                                      lambda i: padded.substr(i, F.lit(GRAM))))) \
        .otherwise(F.array().cast("array<string>"))


class SubstringIndex:
    """``texts(id, text)``, ``postings(gram, id)`` and ``grams(gram, n)`` below ``path``."""

    def __init__(self, spark: SparkSession, path: str, meta):
        self.spark, self.path, self.ignore_case, self.n = spark, path, meta["ignore_case"], meta["n"]
        id_type = meta["id_type"]
        self.texts = spark.read.schema(f"id {id_type}, text string").parquet(f"{path}/texts")
        self.postings = spark.read.schema(f"gram string, id {id_type}").parquet(f"{path}/postings")
        self.grams = spark.read.schema("gram string, n long").parquet(f"{path}/grams")

    def _norm(self, col) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return F.lower(c) if self.ignore_case else c

    @classmethod
    def build(cls, df: DataFrame, id_col: str, text_col: str, path: str, ignore_case: bool = False) -> "SubstringIndex":
        """Index whole texts; a null text matches nothing and is left out.  Ids are distinct."""
        spark = df.sparkSession
        texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        id_type = texts.schema["id"].dataType.simpleString()
        sorted_write(texts, f"{path}/texts", ["id"], bloom=["id"])
        texts = spark.read.schema(f"id {id_type}, text string").parquet(f"{path}/texts")
        norm = F.lower(F.col("text")) if ignore_case else F.col("text")
        # written before they are sorted: finding the ranges would cut every text a second time
        found = written(texts.select(F.explode(pieces(norm)).alias("gram"), "id"), "substring-pieces")
        sorted_write(found, f"{path}/postings", ["gram", "id"])
        postings = spark.read.schema(f"gram string, id {id_type}").parquet(f"{path}/postings")
        sorted_write(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), f"{path}/grams", ["gram"])
        meta = spark.createDataFrame([(texts.count(), ignore_case, id_type)], META)
        meta.write.mode("overwrite").parquet(f"{path}/meta")
        return cls(spark, path, meta.first())

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "SubstringIndex | None":
        """The index that ``build`` completed below ``path``; None if there is none."""
        meta = marker_row(spark, f"{path}/meta", META)
        return cls(spark, path, meta) if meta else None

    @classmethod
    def stored(cls, df: DataFrame, id_col: str, text_col: str, source: str, root: str, ignore_case: bool = False,
               rebuild: bool = False) -> "SubstringIndex":
        """The index of a source's column below ``root``, built if it is not there, the source changed or ``rebuild``."""
        path = f"{root.rstrip('/')}/substrings-{text_col}-{ignore_case}-{source_fingerprint(df.sparkSession, source)}"
        return (None if rebuild else cls.open(df.sparkSession, path)) or cls.build(df, id_col, text_col, path, ignore_case)

    def normalised(self, query: str) -> str:
        """The query as the index knows texts, by the expression that lower-cased them."""
        return self.spark.sql("SELECT lower(:q)", args={"q": query}).first()[0] if self.ignore_case else query

    def search(self, query: str) -> DataFrame:
        """``id, text`` of the texts that hold ``query``; the empty query finds all."""
        q = self.normalised(query)
        if not q:
            return self.texts
        if len(q) < GRAM:
            ids = self.postings.where(F.col("gram").startswith(q)).select("id").distinct()
        else:
            asked = sorted({q[i:i + GRAM] for i in range(len(q) - GRAM + 1)})
            sizes = {r["gram"]: r["n"] for r in self.grams.where(keys_in("gram", asked)).collect()}
            if len(sizes) < len(asked):
                return self.texts.where(F.lit(False))
            rare = sorted(asked, key=lambda g: (sizes[g], g))[:RAREST]
            ids = self.postings.where(keys_in("gram", rare)).groupBy("id").agg(F.count(F.lit(1)).alias("n")) \
                .where(F.col("n") == len(rare)).select("id")
        return self.texts.join(ids, "id", "left_semi").where(F.contains(self._norm("text"), F.lit(q)))

    def matches(self, terms: DataFrame) -> DataFrame:
        """``term, id`` for every distinct term of ``terms(term)`` and every text that holds it; terms are never collected."""
        t = terms.select("term").where(F.col("term").isNotNull()).distinct().withColumn("_nt", self._norm("term"))
        t = t.withColumn("_len", F.length("_nt"))
        asked = t.where(F.col("_len") >= GRAM).select("term", "_nt", F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.col("_len") - (GRAM - 1), F.lit(1))),
            lambda i: F.col("_nt").substr(i, F.lit(GRAM)))).alias("gram"))
        rated = asked.join(self.grams, "gram", "left").groupBy("term", "_nt").agg(
            F.min(F.coalesce("n", F.lit(0))).alias("_least"),
            F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("gram"))
        pairs = rated.where("_least > 0").join(self.postings, "gram").select("term", "_nt", "id")
        for n in range(1, GRAM):
            heads = self.postings.select(F.substring("gram", 1, n).alias("_nt"), "id").distinct()
            pairs = pairs.unionByName(t.where(F.col("_len") == n).join(heads, "_nt").select("term", "_nt", "id"))
        found = pairs.join(self.texts, "id").where(F.contains(self._norm("text"), F.col("_nt"))).select("term", "id")
        empty = t.where(F.col("_len") == 0).limit(1).collect()
        return found.unionByName(self.texts.select(F.lit("").alias("term"), "id")) if empty else found
