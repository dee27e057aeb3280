"""Queries written in SQL: text rules and labels as SQL functions, and tables of the session catalog."""

from __future__ import annotations

import uuid

from larder.functions import sql_functions as Q
from larder.plans import inputs as I
from larder.plans import sql_text as S
from larder.plans.registry import register
from larder.plans.sql_text import q
from larder.session import read_table, shared_path, table_path
from larder.sources import catalog as C

LINE = I.ingredient_line_sql()
WORDS = ["bolt", "widg"]
_NONE = "NOT (" + " OR ".join(f"contains({S.singularize(S.extract_name(LINE))}, {q(w)})" for w in WORDS) + ")"


@register("sql_recipe_labels", f"""
SELECT p_brand, p_size, count(*) AS n_items, count(DISTINCT {S.normalize_ingredient(LINE)}) AS n_terms,
       bool_and({_NONE}) AS vegan, bool_and({I.CARBS_SQL} <= 10.0) AS keto
FROM part GROUP BY p_brand, p_size""")
def sql_recipe_labels(spark, sf_dir):
    """Recipe labels by SQL alone, over a temporary view and the library's SQL functions."""
    Q.register(spark)
    I.part_lines(spark, sf_dir).createOrReplaceTempView("ingredient_lines")
    return spark.sql("""
        SELECT p_brand, p_size, count(*) AS n_items, count(DISTINCT ingredient_term(line)) AS n_terms,
               bool_and(holds_none(singular_phrase(ingredient_name(line)), array('bolt', 'widg'))) AS vegan,
               bool_and(low_carb(abs(p_retailprice - 950.0D) / 2.0D, 10.0D)) AS keto
        FROM ingredient_lines GROUP BY p_brand, p_size""")


@register("sql_text_rules", f"""
SELECT p_partkey, {S.clean_text('p_name')} AS clean, {S.singularize('p_name')} AS singular,
       {S.normalize_ingredient(LINE)} AS term, {S.extract_name(LINE)} AS name,
       CAST({S.word_count(LINE)} AS INTEGER) AS n_words FROM part""")
def sql_text_rules(spark, sf_dir):
    """Each text rule as an SQL function."""
    Q.register(spark)
    I.part_lines(spark, sf_dir).createOrReplaceTempView("ingredient_lines")
    return spark.sql("""
        SELECT p_partkey, clean_name(p_name) AS clean, singular_phrase(p_name) AS singular, ingredient_term(line) AS term,
               ingredient_name(line) AS name, count_words(line) AS n_words FROM ingredient_lines""")


DOCUMENTS = [
    C.Column("doc_id", "BIGINT", comment="the document"),
    C.Column("title", "STRING", "''", "where it comes from"),
    C.Column("photo_url", "STRING", "'none'", "no table gives one"),
    C.Column("keto", "BOOLEAN", "false", "good by its label"),
    C.Column("vegan", "BOOLEAN", "false", "not toxic by its label"),
]


@register("catalog_load", """
WITH n AS (SELECT count(*) AS n FROM documents),
t AS (SELECT d.doc_id, d.source AS title, 'none' AS photo_url, coalesce(l.quality = 1, false) AS keto, false AS vegan
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT t.*, n.n AS first_load, 0::BIGINT AS second_load, n.n AS rebuilt FROM t, n""")
def catalog_load(spark, sf_dir):
    """A catalog table created, loaded behind its guard, rebuilt and dropped; columns not given get their defaults."""
    name, where = f"recipes_{uuid.uuid4().hex[:12]}", shared_path(spark, "catalog-recipes")
    docs, labels = read_table(spark, sf_dir, "documents"), spark.read.parquet(table_path(sf_dir, "labels"))
    docs.createOrReplaceTempView("catalog_documents")
    labels.createOrReplaceTempView("catalog_labels")
    rows = spark.sql("""SELECT d.doc_id, d.source AS title, coalesce(l.quality = 1, false) AS keto
                        FROM catalog_documents d LEFT JOIN catalog_labels l ON l.doc_id = d.doc_id""")
    C.create(spark, name, DOCUMENTS, where, "labelled documents", partitioned_by=["keto", "vegan"])
    counts = [C.load(rows, name), C.load(rows, name), C.load(rows, name, rebuild=True)]
    schema = spark.table(name).schema
    C.drop(spark, name)
    spark.read.schema(schema).parquet(where).createOrReplaceTempView("catalog_left")
    return spark.sql("""SELECT doc_id, title, photo_url, keto, vegan, :a AS first_load, :b AS second_load, :c AS rebuilt
                        FROM catalog_left""", args=dict(zip("abc", counts))) \
        .selectExpr("doc_id", "title", "photo_url", "keto", "vegan", *[f"cast({c} AS BIGINT) AS {c}" for c in
                                                                      ("first_load", "second_load", "rebuilt")])
