"""Scalar text-rule queries on whole ``documents`` texts and ``part`` lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.plans import inputs as I
from larder.plans import sql_text as S
from larder.plans.registry import register
from larder.session import read_table

LINE = I.ingredient_line_sql()


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


@register("normalize_ingredient", f"""
SELECT p_partkey, {LINE} AS line, {S.normalize_ingredient(LINE)} AS ingredient FROM part""")
def normalize_ingredient(spark, sf_dir):
    return I.part_lines(spark, sf_dir).select("p_partkey", "line",
                                             T.normalize_ingredient("line").alias("ingredient"))


@register("extract_name", f"""
SELECT p_partkey, {S.extract_name(LINE)} AS name FROM part""")
def extract_name(spark, sf_dir):
    return I.part_lines(spark, sf_dir).select("p_partkey", T.extract_name("line").alias("name"))


@register("clean_text", f"""
SELECT doc_id, {S.clean_text('text')} AS clean FROM documents""")
def clean_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clean_text("text").alias("clean"))


@register("fold_accents", """
SELECT doc_id, strip_accents(text) AS folded FROM documents""")
def fold_accents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.fold_accents("text").alias("folded"))


@register("singularize", f"""
SELECT doc_id, {S.singularize('text')} AS singular FROM documents""")
def singularize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.singularize("text").alias("singular"))


@register("token_counts", f"""
SELECT doc_id, CAST({S.token_count('text')} AS INTEGER) AS n_tokens,
       CAST({S.word_count('text')} AS INTEGER) AS n_words FROM documents""")
def token_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.token_count("text").cast("int").alias("n_tokens"),
                                       T.word_count("text").cast("int").alias("n_words"))


# A list written as text, built per part row from its own columns.
_LIST_SQL = "'[''' || p_name || ''' ''' || lower(p_type) || ''', ''' || p_brand || ''']'"


@register("parse_list_text", f"""
SELECT p_partkey, array_to_string(items, '|') AS items_joined, CAST(len(items) AS INTEGER) AS n_items
FROM (SELECT p_partkey, {S.parse_list_text(_LIST_SQL)} AS items FROM part)""")
def parse_list_text(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    text = F.concat(F.lit("['"), F.col("p_name"), F.lit("' '"), F.lower("p_type"), F.lit("', '"),
                    F.col("p_brand"), F.lit("']"))
    items = T.parse_list_text(text)
    return part.select("p_partkey", items.alias("items")).select(
        "p_partkey", F.array_join("items", "|").alias("items_joined"), F.size("items").alias("n_items"))
