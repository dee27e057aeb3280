"""SQL functions against the column functions they stand for; tables of the session catalog."""

import pytest
from pyspark.sql import functions as F

from larder.functions import sql_functions as Q
from larder.functions import text as T
from larder.operators import lexicon as L
from larder.session import shared_path
from larder.sources import catalog as C

LINES = ["2 1/2 cups Chopped Red Widgets (small), to taste", "  leaves of Cherries - x", " 3 tablespoons boxes", "", "glasses",
         "Coca-Colas!!", "['a b' 'c']", None, "1 kiss's", "dresses and pies", "\n eggs \t yes", "\\w \\' \"x\"", "Größen (a(b)c) 1/2",
         "is", "es", "s", "ies", "women, men", "12,5 lb. fresh peaches", "pork & beans"]
PAIRS = {"squeeze_blanks": T.collapse_ws, "count_words": T.word_count, "term_list": T.analyse_terms, "clean_name": T.clean_text,
         "singular_phrase": T.singularize, "ingredient_term": T.normalize_ingredient, "ingredient_name": T.extract_name,
         "list_items": T.parse_list_text, "stem_last_word": T.suffix_stem, "looks_vegan": L.keyword_flag,
         "singular_word": lambda c: T.singular_word(F.col(c))}


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_function_equals_the_column_rule(spark, name):
    assert name in Q.register(spark)
    spark.createDataFrame([(x,) for x in LINES], "x string").createOrReplaceTempView("odd_lines")
    got = spark.sql(f"SELECT x, {name}(x) AS y FROM odd_lines").collect()
    want = spark.table("odd_lines").select("x", PAIRS[name]("x").alias("y")).collect()
    assert got == want


def test_label_functions(spark):
    Q.register(spark)
    row = spark.sql("""SELECT low_carb(3.0D, 10.0D) a, low_carb(11.0D, 10.0D) b, low_carb(NULL, 10.0D) c, low_carb(double('nan'), 10.0D) d,
                       holds_none('red gear', array('ear')) e, holds_none('red gear', array('x')) f""").first()
    assert tuple(row) == (True, False, False, False, False, True)


def test_rules_in_sql_are_built_in_expressions(spark):
    Q.register(spark)
    spark.createDataFrame([(x,) for x in LINES], "x string").createOrReplaceTempView("odd_lines")
    plan = spark.sql("SELECT ingredient_term(x), singular_phrase(x) FROM odd_lines")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("MEASUREMENT") == 0 and plan.count("tablespoons") == 1


def test_catalog_table_life(spark):
    columns = [C.Column("id", "BIGINT", comment="it's the id"), C.Column("odd name", "STRING", "'none'"), C.Column("ok", "BOOLEAN", "false")]
    where = shared_path(spark, "t-catalog")
    assert C.create(spark, "t_catalog", columns, where, "a 'table'", partitioned_by=["ok"])
    assert not C.create(spark, "t_catalog", columns, where)
    assert not C.is_loaded(spark, "t_catalog")
    rows = spark.createDataFrame([(1, True, "x"), (2, False, "y")], "id long, ok boolean, extra string")
    assert C.load(rows, "t_catalog") == 2 and C.load(rows, "t_catalog") == 0
    assert sorted(map(tuple, spark.table("t_catalog").select("id", "odd name", "ok").collect())) == [(1, "none", True), (2, "none", False)]
    assert C.load(rows.limit(1).drop("ok"), "t_catalog", rebuild=True) == 1
    assert tuple(spark.table("t_catalog").select("id", "ok").first()) == (1, False)
    about = {r["column"]: (r["type"], r["comment"], r["default"]) for r in C.describe(spark, "t_catalog").collect()}
    assert about == {"id": ("bigint", "it's the id", None), "odd name": ("string", "", "'none'"), "ok": ("boolean", "", "false")}
    assert C.drop(spark, "t_catalog") and not C.drop(spark, "t_catalog")
    assert spark.read.parquet(where).count() == 1


def test_repeated_catalogue_names_have_one_carb_value(spark):
    """A name that occurs several times counts with the lower middle of its carbs."""
    sample = spark.createDataFrame([(1, ["rice"]), (2, ["tofu"])], "id int, items array<string>")
    catalogue = spark.createDataFrame([("rice", 2.0), ("rice", 80.0), ("rice", 3.0), ("tofu", 50.0), ("tofu", 60.0)], "name string, carbs double")
    lexicon = spark.createDataFrame([("meat", "flagged")], "term string, kind string")
    got = L.label_sample(sample, "id", "items", lexicon, None, catalogue, "name", "carbs").collect()
    assert sorted((r.id, r.keto) for r in got) == [(1, True), (2, False)]
