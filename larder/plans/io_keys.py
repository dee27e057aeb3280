"""Source / sink queries: pruned scans, part files, CSV and Parquet round trips, guards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from larder.functions import text as T
from larder.plans import sql_text as S
from larder.plans.registry import register
from larder.session import shared_path, table_path
from larder.sources import io as IO


@register("scan_pruned", """
SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size >= 25""")
def scan_pruned(spark, sf_dir):
    return IO.scan(spark, table_path(sf_dir, "part"), ["p_partkey", "p_name", "p_retailprice", "p_size"],
                   F.col("p_size") >= 25).drop("p_size")


@register("scan_parts", """
SELECT p_partkey, p_name, p_brand, p_retailprice FROM part""")
def scan_parts(spark, sf_dir):
    part = IO.scan(spark, table_path(sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_retailprice"])
    path = IO.write_parts(part, shared_path(spark, "parts"), 4)
    return IO.read_parts(spark, path)


DOC_CSV_SCHEMA = "doc_id BIGINT, text STRING, lang STRING"


@register("csv_roundtrip", """
SELECT doc_id, text, lang FROM documents""")
def csv_roundtrip(spark, sf_dir):
    docs = IO.scan(spark, table_path(sf_dir, "documents"), ["doc_id", "text", "lang"])
    path = IO.write_csv(docs, shared_path(spark, "csv"))
    return IO.read_csv(spark, path, DOC_CSV_SCHEMA)


@register("parquet_roundtrip", """
SELECT doc_id, text, lang, source, n_chars FROM documents""")
def parquet_roundtrip(spark, sf_dir):
    docs = IO.scan(spark, table_path(sf_dir, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])
    path = shared_path(spark, "parquet")
    IO.write_parquet(docs, path)
    return spark.read.parquet(path)


def _doc_stats(df):
    return df.select("doc_id", T.word_count("text").alias("n_words"), T.token_count("text").alias("n_tokens"))


@register("resume_missing", f"""
SELECT doc_id, CAST({S.word_count('text')} AS INTEGER) AS n_words, CAST({S.token_count('text')} AS INTEGER) AS n_tokens
FROM documents""")
def resume_missing(spark, sf_dir):
    docs = IO.scan(spark, table_path(sf_dir, "documents"), ["doc_id", "text", "lang"])
    target = shared_path(spark, "resume")
    # an interrupted first run that got through the English documents only
    IO.resume_missing(docs.filter(F.col("lang") == "en"), "doc_id", _doc_stats, target)
    # the rerun computes only what is missing
    IO.resume_missing(docs, "doc_id", _doc_stats, target)
    return IO.read_resumed(spark, target)


RECIPE_DOC_SCHEMA = StructType([
    StructField("doc_id", LongType()), StructField("title", StringType()), StructField("description", StringType()),
    StructField("photo_url", StringType()), StructField("keto", BooleanType()), StructField("vegan", BooleanType()),
])


@register("typed_recipes", """
SELECT d.doc_id, d.source AS title, d.text AS description, '' AS photo_url,
       coalesce(l.quality = 1, false) AS keto, coalesce(l.toxic = 0, false) AS vegan
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def typed_recipes(spark, sf_dir):
    docs = IO.scan(spark, table_path(sf_dir, "documents"), ["doc_id", "source", "text"])
    labels = IO.scan(spark, table_path(sf_dir, "labels"), ["doc_id", "quality", "toxic"])
    j = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("description"),
        (F.col("quality") == 1).alias("keto"), (F.col("toxic") == 0).alias("vegan"))
    return IO.conform(j, RECIPE_DOC_SCHEMA, {"photo_url": "", "keto": False, "vegan": False})


@register("load_guard", """
SELECT doc_id, quality, toxic, (SELECT count(*) FROM labels) AS first_load, CAST(0 AS BIGINT) AS second_load,
       (SELECT count(*) FROM labels) AS rebuild FROM labels""")
def load_guard(spark, sf_dir):
    labels = IO.scan(spark, table_path(sf_dir, "labels"), ["doc_id", "quality", "toxic"])
    target = shared_path(spark, "guard")
    first = IO.guarded_load(labels, target)
    second = IO.guarded_load(labels, target)
    rebuilt = IO.guarded_load(labels, target, rebuild=True)
    return spark.read.parquet(target).select(
        "doc_id", "quality", "toxic", F.lit(first).cast("long").alias("first_load"),
        F.lit(second).cast("long").alias("second_load"), F.lit(rebuilt).cast("long").alias("rebuild"))


@register("labelled_load", """
SELECT doc_id, title, description, photo_url, keto, vegan FROM (
  SELECT d.doc_id, d.source AS title, d.text AS description, '' AS photo_url,
         coalesce(l.quality = 1, false) AS keto, coalesce(l.toxic = 0, false) AS vegan
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
WHERE keto AND vegan""")
def labelled_load(spark, sf_dir):
    from larder.operators.recipes import diet_filter
    labelled = typed_recipes(spark, sf_dir)
    path = IO.load_labelled(labelled, shared_path(spark, "labelled"), ["keto", "vegan"])
    loaded = spark.read.schema(RECIPE_DOC_SCHEMA).parquet(path)   # typed label folders
    return diet_filter(loaded, "keto, vegan").select("doc_id", "title", "description", "photo_url", "keto", "vegan")
