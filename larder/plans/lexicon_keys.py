"""Lexicon, closure and recipe-label queries on ``part`` (+ nation/region edges)."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import lexicon as L
from larder.operators import recipes as R
from larder.operators.util import bounded_broadcast, written
from larder.plans import inputs as I
from larder.plans import sql_text as S
from larder.plans.registry import register
from larder.plans.sql_text import q
from larder.plans.vector_keys import vectors_cte
from larder.session import read_table

LINE = I.ingredient_line_sql()
PHRASE = S.singularize(S.extract_name(LINE))
LEX_TERM = S.collapse_ws("replace(lower(term), '-', ' ')")


def _closure_cte(roots) -> str:
    roots_sql = " UNION ".join(f"SELECT {q(r)} AS root, {q(r)} AS node" for r in roots)
    return (f"edges AS ({I.edges_sql()}), "
            f"reach(root, node) AS ({roots_sql} UNION "
            f"SELECT reach.root, edges.child FROM reach JOIN edges ON edges.parent = reach.node)")


def _vegan_cte(items_sql: str | None = None) -> str:
    """CTEs ending in ``labv(phrase, whole_hit, first_pos, first_word, excused, vegan)``.

    ``items_sql`` is a query with a ``phrase`` column (default: part lines).
    """
    items_sql = items_sql or f"SELECT p_partkey, p_brand, p_size, p_retailprice, {PHRASE} AS phrase FROM part"
    return f"""
{_closure_cte(I.PLANT_ROOTS)},
closure AS (SELECT DISTINCT lower(node) AS term FROM reach),
lexr AS (SELECT * FROM {I.lexicon_sql()}),
flagged AS (SELECT DISTINCT {LEX_TERM} AS term FROM lexr WHERE kind = 'flagged'),
ctx AS (SELECT {LEX_TERM} AS term, 'before' AS role FROM lexr WHERE kind = 'excusing_before'
        UNION SELECT {LEX_TERM}, 'after' FROM lexr WHERE kind = 'excusing_after'
        UNION SELECT term, 'before' FROM closure),
items AS ({items_sql}),
w AS (SELECT DISTINCT phrase, list_filter(string_split(phrase, ' '), lambda x: x <> '') AS words FROM items),
pw AS (SELECT phrase, unnest(generate_series(0, len(words) - 1)) AS pos, unnest(words) AS word FROM w),
firsts AS (SELECT phrase, min(pos) AS first_pos FROM pw WHERE word IN (SELECT term FROM flagged) GROUP BY phrase),
hits AS (SELECT w.phrase, w.words, w.phrase IN (SELECT term FROM flagged) AS whole_hit,
                CAST(f.first_pos AS INTEGER) AS first_pos
         FROM w LEFT JOIN firsts f ON f.phrase = w.phrase),
lab AS (SELECT phrase, whole_hit, first_pos, words[first_pos + 1] AS first_word,
          coalesce(NOT whole_hit AND first_pos IS NOT NULL AND (
             (first_pos >= 1 AND words[first_pos] IN (SELECT term FROM ctx WHERE role = 'before'))
             OR (first_pos >= 2 AND (words[first_pos - 1] || ' ' || words[first_pos])
                 IN (SELECT term FROM ctx WHERE role = 'before'))
             OR (words[first_pos + 2] IN (SELECT term FROM ctx WHERE role = 'after'))), false) AS excused
        FROM hits),
labv AS (SELECT *, CASE WHEN whole_hit THEN false WHEN first_pos IS NULL THEN true ELSE excused END AS vegan
         FROM lab)"""


# ----------------------------------------------------------- label_recipes

def _vegan_phrase_labels(spark, sf_dir):
    """Item rows and the plant-based label of every DISTINCT ingredient line.

    The expensive text rules run once per distinct raw line (lines repeat a
    lot), and the labels are joined back on the raw line.
    """
    lines = I.part_lines(spark, sf_dir)
    distinct_lines = lines.select("line").distinct().withColumn("phrase", L.prepare_phrase("line"))
    closure = L.category_closure(I.edges_df(spark, sf_dir),
                                 spark.createDataFrame([(r,) for r in I.PLANT_ROOTS], "root string"))
    labels = L.classify_vegan(distinct_lines, "line", "phrase", I.lexicon_df(spark), closure.select("term"))
    return lines, labels


@register("label_recipes", f"""
WITH RECURSIVE {_vegan_cte()}
SELECT p_brand, p_size, bool_and(coalesce(l.vegan, false)) AS vegan,
       bool_and({I.CARBS_SQL} <= 10) AS keto, count(*) AS n_items
FROM items i LEFT JOIN labv l ON l.phrase = i.phrase
GROUP BY p_brand, p_size""")
def label_recipes(spark, sf_dir):
    lines, labels = _vegan_phrase_labels(spark, sf_dir)
    items = lines.withColumn("keto_item", I.carbs() <= 10)
    # one label row per distinct line: broadcast only within the checked bound
    joined = items.join(bounded_broadcast(labels.select("line", "vegan"), materialize=True), "line", "left")
    return joined.groupBy("p_brand", "p_size").agg(
        F.bool_and(F.coalesce("vegan", F.lit(False))).alias("vegan"),
        F.bool_and("keto_item").alias("keto"),
        F.count(F.lit(1)).alias("n_items"))


@register("vegan_items", f"""
WITH RECURSIVE {_vegan_cte()}
SELECT i.p_partkey, i.phrase, l.vegan FROM items i LEFT JOIN labv l ON l.phrase = i.phrase""")
def vegan_items(spark, sf_dir):
    lines, labels = _vegan_phrase_labels(spark, sf_dir)
    return lines.join(labels.select("line", "phrase", "vegan"), "line", "left").select("p_partkey", "phrase", "vegan")


@register("lexicon_context", f"""
WITH RECURSIVE {_vegan_cte()}
SELECT i.p_partkey, l.phrase, l.first_pos, l.first_word, l.excused
FROM items i JOIN labv l ON l.phrase = i.phrase
WHERE l.first_pos IS NOT NULL AND NOT l.whole_hit""")
def lexicon_context(spark, sf_dir):
    lines, labels = _vegan_phrase_labels(spark, sf_dir)
    hit = labels.filter(F.col("first_pos").isNotNull() & ~F.col("whole_hit"))
    return lines.join(hit, "line").select("p_partkey", "phrase", "first_pos", "first_word", "excused")


@register("lexicon_hits", f"""
WITH RECURSIVE {_vegan_cte()}
SELECT i.p_partkey, i.phrase, l.whole_hit, l.first_pos, l.first_word
FROM items i JOIN labv l ON l.phrase = i.phrase""")
def lexicon_hits(spark, sf_dir):
    lines = I.part_lines(spark, sf_dir)
    distinct_lines = lines.select("line").distinct().withColumn("phrase", L.prepare_phrase("line"))
    hits = L.lexicon_hits(distinct_lines, "line", "phrase", I.lexicon_df(spark))
    return lines.join(hits.withColumnRenamed("id", "line"), "line") \
        .select("p_partkey", "phrase", "whole_hit", "first_pos", "first_word")


@register("category_closure", f"""
WITH RECURSIVE {_closure_cte(I.CLOSURE_ROOTS)}
SELECT DISTINCT node AS term, root FROM reach""")
def category_closure(spark, sf_dir):
    roots = spark.createDataFrame([(r,) for r in I.CLOSURE_ROOTS], "root string")
    return L.category_closure(I.edges_df(spark, sf_dir), roots)


KEYWORDS = ["bolt", "widg"]


@register("keyword_heuristic", f"""
SELECT p_brand, p_size,
       bool_and(NOT ({' OR '.join(f"contains(p_name, {q(w)})" for w in KEYWORDS)})) AS vegan
FROM part GROUP BY p_brand, p_size""")
def keyword_heuristic(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    return part.groupBy("p_brand", "p_size").agg(F.bool_and(L.keyword_flag("p_name", KEYWORDS)).alias("vegan"))


# ------------------------------------------------------------ vocabulary

NORM = S.normalize_ingredient(LINE)


@register("ingredient_vocab", f"""
SELECT DISTINCT {NORM} AS ingredient FROM part WHERE {NORM} <> ''""")
def ingredient_vocab(spark, sf_dir):
    return R.ingredient_vocab(I.part_lines(spark, sf_dir), "line")


_VOCAB_SQL = f"""(SELECT CAST(row_number() OVER (ORDER BY ingredient) AS BIGINT) AS id, ingredient
 FROM (SELECT DISTINCT {NORM} AS ingredient FROM part WHERE {NORM} <> ''))"""


def _vocab(spark, sf_dir):
    return R.vocab_ids(R.ingredient_vocab(I.part_lines(spark, sf_dir), "line"))


@register("vocab_ids", f"SELECT id, ingredient FROM {_VOCAB_SQL}")
def vocab_ids(spark, sf_dir):
    return _vocab(spark, sf_dir)


SUGGEST_Q = " ge"


@register("vocab_suggest", f"""
SELECT id, ingredient, CAST(length(ingredient) AS INTEGER) AS length FROM {_VOCAB_SQL}
WHERE contains(ingredient, {q(SUGGEST_Q.strip())})""")
def vocab_suggest(spark, sf_dir):
    return R.vocab_suggest(_vocab(spark, sf_dir), SUGGEST_Q)


IDS_TEXT = "3, 1,x, 12,7 ,2"


@register("ids_to_terms", f"""
WITH ids AS (SELECT * FROM (VALUES (0, 3), (1, 1), (3, 12), (4, 7), (5, 2)) v(pos, term_id))
SELECT CAST(ids.pos AS INTEGER) AS pos, CAST(ids.term_id AS BIGINT) AS term_id, v.ingredient
FROM ids JOIN {_VOCAB_SQL} v ON v.id = ids.term_id""")
def ids_to_terms(spark, sf_dir):
    return R.ids_to_terms(spark, _vocab(spark, sf_dir), IDS_TEXT)


# ------------------------------------------- both labels, low-carb by kNN

KNN_THRESHOLD = 0.1
KNN_CARB_LIMIT = 10.0


CAT_NAME = S.singularize(S.clean_text("p_name"), False)
CAT_SQL = f"""SELECT name, quantile_disc({I.CARBS_SQL}, 0.5) AS carbs FROM (
          SELECT {CAT_NAME} AS name, p_retailprice FROM part
          WHERE regexp_matches({S.clean_text('p_name')}, '[a-zA-Z].*[a-zA-Z]')
            AND trim({S.clean_text('p_name')}) <> '' AND p_retailprice IS NOT NULL)
        WHERE trim(name) <> '' GROUP BY name"""


def _name_id(col):
    """60 bits of the name's MD5: ids that any engine can compute."""
    return F.conv(F.substring(F.md5(F.col(col).cast("binary")), 1, 15), 16, 10).cast("long")


@register("label_recipes_knn", f"""
WITH RECURSIVE {_vegan_cte()},
cat AS (SELECT ('0x' || substr(md5(name), 1, 15))::BIGINT AS id, name AS text, carbs FROM ({CAT_SQL})),
asked AS (SELECT ('0x' || substr(md5(phrase), 1, 15))::BIGINT AS id, phrase AS text FROM (SELECT DISTINCT phrase FROM items)),
{vectors_cte('cat', 'cat', 256, 'cv')},
{vectors_cte('asked', 'cat', 256, 'qv')},
pairs AS (SELECT q.id AS query_id, c.id AS item_id,
    list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
      * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) + 1e-8) AS sim FROM qv q CROSS JOIN cv c),
best AS (SELECT query_id, arg_min(item_id, (-round(sim, 9), item_id)) AS item_id, max(sim) AS sim FROM pairs GROUP BY query_id),
keto AS (SELECT a.text AS phrase, coalesce(b.sim >= {KNN_THRESHOLD} AND c.carbs <= {KNN_CARB_LIMIT} AND NOT isnan(c.carbs), false) AS keto
  FROM asked a LEFT JOIN best b ON b.query_id = a.id LEFT JOIN cat c ON c.id = b.item_id)
SELECT p_brand, p_size, bool_and(coalesce(l.vegan, false)) AS vegan, bool_and(coalesce(k.keto, false)) AS keto
FROM items i LEFT JOIN labv l ON l.phrase = i.phrase LEFT JOIN keto k ON k.phrase = i.phrase GROUP BY p_brand, p_size""")
def label_recipes_knn(spark, sf_dir):
    """The whole labelling job: plant-based by lexicon, low-carb by nearest product.

    Catalogue: part names cleaned like products, carbs = median of
    ``inputs.carbs`` per name.  Every distinct ingredient phrase is
    encoded with the same fitted encoder and matched to the catalogue
    (``ann.best_matches``); its carbs decide.  Recipes are ``(p_brand, p_size)``.
    """
    from larder.operators import products as P
    from larder.operators import vectors as V
    from larder.operators.ann import best_matches
    part = read_table(spark, sf_dir, "part")
    raw = part.select(F.col("p_name").alias("product_name"), I.carbs().alias("carbohydrates_100g"))
    cleaned = P.clean_names(raw, fold=False)
    catalogue = P.median_per_key(cleaned, "product_name", "carbohydrates_100g", "carbs")
    catalogue = written(catalogue.withColumn("item_id", _name_id("product_name")), "catalogue")
    encoder = V.fit_text_encoder(catalogue, "product_name", dim=256)
    cat_vec = encoder.transform(catalogue)
    lines, vegan = _vegan_phrase_labels(spark, sf_dir)
    # one row per distinct line, used twice (matching, label join): written once
    vegan = vegan.select("line", "phrase", "vegan").checkpoint(eager=True)
    # many lines share a phrase: each is encoded and searched once
    phrases = vegan.select("phrase").distinct().withColumn("query_id", _name_id("phrase"))
    q_vec = encoder.transform(phrases.withColumnRenamed("phrase", "product_name"))
    best = best_matches(q_vec, cat_vec)
    keto = V.classify_keto(best, catalogue, "item_id", "carbs", KNN_THRESHOLD, KNN_CARB_LIMIT) \
        .select("query_id", "keto")
    item_labels = vegan.withColumn("query_id", _name_id("phrase")) \
        .join(keto, "query_id", "left").select("line", "vegan", F.coalesce("keto", F.lit(False)).alias("keto"))
    return R.label_items(lines, ["p_brand", "p_size"], "line", item_labels, ["vegan", "keto"])


# ------------------------------------------------ end-to-end sample scoring

def _sample_list_sql() -> str:
    return ("'[''' || " + LINE + " || ''' ''2 tablespoons ' || upper(p_name) || 's'']'")


def _sample_list():
    line2 = F.concat(F.lit("2 tablespoons "), F.upper("p_name"), F.lit("s"))
    return F.concat(F.lit("['"), I.ingredient_line(), F.lit("' '"), line2, F.lit("']"))


_SAMPLE_SQL = f"""(SELECT p_partkey AS id, {_sample_list_sql()} AS ingredients,
   {I.CARBS_SQL} <= 10 AS keto, NOT contains(lower(p_name), 'bolt') AS vegan FROM part)"""
_ITEMS_SQL = f"""SELECT DISTINCT item, {S.singularize(S.extract_name('item'))} AS phrase
   FROM (SELECT unnest({S.parse_list_text('ingredients')}) AS item FROM {_SAMPLE_SQL})"""


def _report_sql(t: str, p: str) -> str:
    return f"""
(WITH d AS (SELECT CAST({t} AS VARCHAR) AS t, CAST({p} AS VARCHAR) AS p FROM joined),
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
UNION ALL SELECT 'weighted avg', wp / n, wr / n, wf / n, CAST(n AS BIGINT) FROM tot)"""


_EVAL_SQL = f"""
WITH RECURSIVE {_vegan_cte(_ITEMS_SQL)},
cat AS ({CAT_SQL}),
item_lab AS (SELECT i.item, coalesce(l.vegan, false) AS vegan,
                    coalesce(c.carbs <= 10 AND NOT isnan(c.carbs), false) AS keto
             FROM items i LEFT JOIN labv l ON l.phrase = i.phrase LEFT JOIN cat c ON c.name = i.phrase),
sample AS (SELECT id, unnest({S.parse_list_text('ingredients')}) AS item FROM {_SAMPLE_SQL}),
pred AS (SELECT s.id, bool_and(l.keto) AS keto_pred, bool_and(l.vegan) AS vegan_pred
         FROM sample s JOIN item_lab l ON l.item = s.item GROUP BY s.id),
joined AS (SELECT s.id, s.keto, s.vegan, p.keto_pred, p.vegan_pred FROM {_SAMPLE_SQL} s JOIN pred p ON p.id = s.id)
SELECT 'keto' AS diet, * FROM {_report_sql('keto', 'keto_pred')}
UNION ALL SELECT 'vegan' AS diet, * FROM {_report_sql('vegan', 'vegan_pred')}"""


@register("evaluate_sample", _EVAL_SQL)
def evaluate_sample(spark, sf_dir):
    """The scoring run: a labelled sample as CSV (lists written as text), read back,
    parsed, labelled for both diets and scored with a classification report per diet."""
    from larder.functions import text as T
    from larder.operators import evaluate as EV
    from larder.operators import products as P
    from larder.session import shared_path
    from larder.sources import io as IO
    part = read_table(spark, sf_dir, "part")
    sample = part.select(F.col("p_partkey").alias("id"), _sample_list().alias("ingredients"),
                         (I.carbs() <= 10).alias("keto"),
                         ~F.contains(F.lower("p_name"), F.lit("bolt")).alias("vegan"))
    path = IO.write_csv(sample, shared_path(spark, "sample-csv"))
    back = IO.read_csv(spark, path, "id BIGINT, ingredients STRING, keto BOOLEAN, vegan BOOLEAN")
    parsed = back.withColumn("items", T.parse_list_text("ingredients"))
    names = part.select(F.col("p_name").alias("product_name"), I.carbs().alias("carbs"))
    catalogue = P.median_per_key(P.clean_names(names, "product_name", "carbs", fold=False),
                                 "product_name", "carbs", "carbs")
    closure = L.category_closure(I.edges_df(spark, sf_dir),
                                 spark.createDataFrame([(r,) for r in I.PLANT_ROOTS], "root string"))
    pred = L.label_sample(parsed, "id", "items", I.lexicon_df(spark), closure.select("term"),
                          catalogue, "product_name", "carbs")
    joined = back.join(pred.select("id", F.col("keto").alias("keto_pred"), F.col("vegan").alias("vegan_pred")), "id")
    return EV.classification_reports(joined, {"keto": ("keto", "keto_pred"), "vegan": ("vegan", "vegan_pred")}, "diet")
