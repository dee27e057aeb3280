"""Product-cleaning queries: nested pickers, cleaning chain, medians, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators import products as P
from larder.operators.selection import exact_quantile
from larder.operators.util import param_table
from larder.plans import sql_text as S
from larder.plans.registry import register
from larder.plans.sql_text import q
from larder.session import read_table


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


# --- nested inputs built in both engines from flat columns -----------------
# Names: each document with its successor (doc_id + 1): [(lang*, text), (lang', text')],
# where lang* is upper-cased on even ids to exercise the lowercase match.

def _names_nested(spark, sf_dir):
    d = _docs(spark, sf_dir)
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("lang2"), F.col("text").alias("text2"))
    lang1 = F.when(F.col("doc_id") % 2 == 0, F.upper("lang")).otherwise(F.col("lang"))
    return d.join(nxt, "doc_id", "left").select(
        "doc_id", "n_chars",
        F.filter(F.array(F.struct(lang1.alias("lang"), F.col("text").alias("text")),
                         F.when(F.col("lang2").isNotNull(),
                                F.struct(F.col("lang2").alias("lang"), F.col("text2").alias("text")))),
                 lambda x: x.isNotNull()).alias("product_name"))


_NAMES_SQL = """
SELECT d.doc_id, d.n_chars,
  list_filter([{'lang': CASE WHEN d.doc_id % 2 = 0 THEN upper(d.lang) ELSE d.lang END, 'text': d.text},
               CASE WHEN n.lang IS NOT NULL THEN {'lang': n.lang, 'text': n.text} END],
              lambda x: x IS NOT NULL) AS product_name
FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1"""


@register("pick_language_text", f"""
SELECT doc_id, list_filter(product_name, lambda x: lower(x.lang) = 'en')[1].text AS name
FROM ({_NAMES_SQL})""")
def pick_language_text(spark, sf_dir):
    return _names_nested(spark, sf_dir).select("doc_id", T.pick_language_text("product_name").alias("name"))


# Nutriments per part: [(fat, size, size), (Carbohydrates|carbohydrates, price, price/10 or NULL), (carbs, 0, 0)]
def _nutriments(part):
    carb_name = F.when(F.col("p_partkey") % 2 == 0, F.lit("Carbohydrates")).otherwise(F.lit("carbohydrates"))
    per100 = F.when(F.col("p_size") <= 45, F.col("p_retailprice") / 10)
    return F.array(
        F.struct(F.lit("fat").alias("name"), F.col("p_size").cast("double").alias("value"),
                 F.col("p_size").cast("double").alias("100g")),
        F.struct(F.lit(None).cast("string").alias("name"), F.lit(1.0).alias("value"), F.lit(1.0).alias("100g")),
        F.struct(carb_name.alias("name"), F.col("p_retailprice").alias("value"), per100.alias("100g")),
        F.struct(F.lit("carbohydrates").alias("name"), F.lit(0.0).alias("value"), F.lit(0.0).alias("100g")))


@register("pick_nutriment", """
SELECT p_partkey, list_filter(nutriments, lambda x: lower(x.name) = 'carbohydrates')[1]."100g" AS carbohydrates_100g
FROM (SELECT p_partkey, [
   {'name': 'fat', 'value': CAST(p_size AS DOUBLE), '100g': CAST(p_size AS DOUBLE)},
   {'name': CAST(NULL AS VARCHAR), 'value': 1.0::DOUBLE, '100g': 1.0::DOUBLE},
   {'name': CASE WHEN p_partkey % 2 = 0 THEN 'Carbohydrates' ELSE 'carbohydrates' END,
    'value': p_retailprice, '100g': CASE WHEN p_size <= 45 THEN p_retailprice / 10 END},
   {'name': 'carbohydrates', 'value': 0.0::DOUBLE, '100g': 0.0::DOUBLE}] AS nutriments FROM part)""")
def pick_nutriment(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    raw = part.select("p_partkey", _nutriments(part).alias("nutriments"))
    return raw.select("p_partkey", T.pick_nutriment("nutriments").alias("carbohydrates_100g"))


# Product cleaning over documents: name = text, carbs = n_chars / 100.
_CLEAN_SQL = f"""
WITH c AS (SELECT doc_id, {S.clean_text('strip_accents(text)')} AS product_name
           FROM documents WHERE text IS NOT NULL AND trim(text) <> '' AND n_chars IS NOT NULL)
SELECT doc_id, {S.singularize('product_name', False)} AS product_name FROM c
WHERE regexp_matches(product_name, '[a-zA-Z].*[a-zA-Z]') AND trim(product_name) <> ''
  AND trim({S.singularize('product_name', False)}) <> ''"""


@register("clean_products", _CLEAN_SQL)
def clean_products(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("product_name"), "n_chars")
    return P.clean_names(d, "product_name", "n_chars").select("doc_id", "product_name")


def _raw_products(spark, sf_dir):
    """Nested product rows: names as above, nutriments [(fat, ..), (carbohydrates, n_chars / 100)]."""
    names = _names_nested(spark, sf_dir)
    carbs = F.col("n_chars") / 100.0
    nutr = F.array(F.struct(F.lit("fat").alias("name"), F.lit(1.0).alias("value"), F.lit(1.0).alias("100g")),
                   F.struct(F.lit("carbohydrates").alias("name"), carbs.alias("value"), carbs.alias("100g")))
    return names.select("product_name", nutr.alias("nutriments"))


@register("clean_products_job", f"""
WITH raw AS ({_NAMES_SQL}),
picked AS (SELECT list_filter(product_name, lambda x: lower(x.lang) = 'en')[1].text AS product_name,
                  n_chars / 100.0 AS carbs FROM raw),
c1 AS (SELECT {S.clean_text('strip_accents(product_name)')} AS name, carbs FROM picked
       WHERE product_name IS NOT NULL AND trim(product_name) <> '' AND carbs IS NOT NULL),
c2 AS (SELECT {S.singularize('name', False)} AS name, carbs FROM c1
       WHERE regexp_matches(name, '[a-zA-Z].*[a-zA-Z]') AND trim(name) <> '')
SELECT name AS product_name, CAST(quantile_disc(carbs, 0.5) AS FLOAT) AS carbohydrates_100g
FROM c2 WHERE trim(name) <> '' GROUP BY name""")
def clean_products_job(spark, sf_dir):
    return P.clean_products(_raw_products(spark, sf_dir))


@register("clean_products_counts", f"""
WITH raw AS ({_NAMES_SQL}),
picked AS (SELECT list_filter(product_name, lambda x: lower(x.lang) = 'en')[1].text AS product_name,
                  n_chars / 100.0 AS carbs FROM raw),
c0 AS (SELECT * FROM picked WHERE product_name IS NOT NULL AND trim(product_name) <> '' AND carbs IS NOT NULL),
c1 AS (SELECT {S.clean_text('strip_accents(product_name)')} AS name FROM c0),
c2 AS (SELECT {S.singularize('name', False)} AS name FROM c1
       WHERE regexp_matches(name, '[a-zA-Z].*[a-zA-Z]') AND trim(name) <> ''),
c3 AS (SELECT name FROM c2 WHERE trim(name) <> '')
SELECT * FROM (VALUES
  (0, 'input', (SELECT count(*) FROM documents)),
  (1, 'named_with_carbs', (SELECT count(*) FROM c0)),
  (2, 'cleaned', (SELECT count(*) FROM c3)),
  (3, 'distinct_names', (SELECT count(DISTINCT name) FROM c3)),
  (4, 'written', (SELECT count(DISTINCT name) FROM c3))) v(stage_no, stage, rows)""")
def clean_products_counts(spark, sf_dir):
    from larder.session import shared_path
    return P.write_clean_products(_raw_products(spark, sf_dir), shared_path(spark, "clean-products"))


@register("stage_counts", f"""
WITH c AS (SELECT text, lang, {S.clean_text('strip_accents(text)')} AS clean FROM documents)
SELECT * FROM (VALUES
  (0, 'input', (SELECT count(*) FROM c)),
  (1, 'english', (SELECT count(*) FROM c WHERE lower(lang) = 'en')),
  (2, 'not_blank', (SELECT count(*) FROM c WHERE lower(lang) = 'en' AND text IS NOT NULL AND trim(text) <> '')),
  (3, 'two_letters', (SELECT count(*) FROM c WHERE lower(lang) = 'en' AND text IS NOT NULL AND trim(text) <> ''
                       AND regexp_matches(clean, '[a-zA-Z].*[a-zA-Z]'))),
  (4, 'distinct', (SELECT count(DISTINCT clean) FROM c WHERE lower(lang) = 'en' AND text IS NOT NULL
                    AND trim(text) <> '' AND regexp_matches(clean, '[a-zA-Z].*[a-zA-Z]')))
) v(stage_no, stage, rows)""")
def stage_counts(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("clean", T.clean_text(T.fold_accents("text")))
    return P.stage_counts(d, [("english", F.lower("lang") == "en"),
                              ("not_blank", T.not_blank("text")),
                              ("two_letters", T.has_two_letters("clean"))],
                          distinct_col=F.col("clean"))


@register("median_per_key", """
SELECT p_name, CAST(quantile_disc(p_retailprice, 0.5) AS DOUBLE) AS median_price FROM part GROUP BY p_name""")
def median_per_key(spark, sf_dir):
    return P.median_per_key(read_table(spark, sf_dir, "part"), "p_name", "p_retailprice", "median_price")


@register("median_join", """
WITH m AS (SELECT p_name, CAST(quantile_disc(p_retailprice, 0.5) AS DOUBLE) AS median_price
           FROM part GROUP BY p_name),
j AS (SELECT p.p_partkey, p.p_name, p.p_retailprice, m.median_price FROM part p LEFT JOIN m USING (p_name))
SELECT p_name, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_retailprice, p_partkey) AS p_retailprice,
       arg_min(median_price, p_partkey) AS median_price
FROM j GROUP BY p_name""")
def median_join(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    joined = P.median_join(part, "p_name", "p_retailprice", "median_price")
    return P.dedupe_by_key(joined, "p_name", "p_partkey")


OVERRIDES = [("Red Widget", 1.5), ("old bolt", 2.25), ("blue anvil", 0.0), ("no such part", 9.0)]


@register("apply_overrides", f"""
WITH o(k, v) AS (VALUES {', '.join(f"({q(k.lower())}, {v})" for k, v in OVERRIDES)})
SELECT p.p_partkey, p.p_name, coalesce(CAST(o.v AS DOUBLE), p.p_retailprice) AS p_retailprice
FROM part p LEFT JOIN o ON lower(p.p_name) = o.k""")
def apply_overrides(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    ov = param_table(spark, OVERRIDES, "product_name string, carbohydrates_100g double")
    return P.apply_overrides(part, ov, "p_name", "p_retailprice", "product_name", "carbohydrates_100g")


NEW_ROWS = [("made broth", 2.5), ("test grain", 71.25), ("sample leaf", 0.0), ("trial syrup", 64.0)]


@register("append_rows", f"""
SELECT p_partkey, p_name, p_retailprice FROM part
UNION ALL
SELECT (SELECT coalesce(max(p_partkey), -1) FROM part) + row_number() OVER (ORDER BY n, v) AS p_partkey,
       n AS p_name, v AS p_retailprice
FROM (VALUES {', '.join(f"({q(n)}, CAST({v} AS DOUBLE))" for n, v in NEW_ROWS)}) t(n, v)""")
def append_rows(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    rows = spark.createDataFrame(NEW_ROWS, "p_name string, p_retailprice double")
    return P.append_rows(part, rows, "p_partkey")


# --- medians at volume (lineitem): a few huge groups, and many small ones -----
@register("median_hot_groups", """
SELECT l_returnflag, l_linestatus, CAST(quantile_disc(l_extendedprice, 0.5) AS DOUBLE) AS median_price,
       count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def median_hot_groups(spark, sf_dir):
    """Exact medians of groups that grow with the table: rank search by counts."""
    li = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    keys = ["l_returnflag", "l_linestatus"]
    return exact_quantile(li, keys, "l_extendedprice", out="median_price") \
        .join(li.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)


@register("median_many_groups", """
SELECT l_partkey, CAST(quantile_disc(l_quantity, 0.5) AS DOUBLE) AS median_qty FROM lineitem GROUP BY l_partkey""")
def median_many_groups(spark, sf_dir):
    return P.median_per_key(read_table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", "median_qty")
