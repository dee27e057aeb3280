"""Plant-based / low-carb labels on the rows of FIXTURES.md section 3.3."""

import math

import pytest

from larder.fixed_values import EXCUSING_AFTER, EXCUSING_BEFORE
from larder.operators import lexicon as L
from larder.operators import recipes as R
from larder.operators import vectors as V


@pytest.fixture(scope="module")
def lex(spark):
    return L.make_lexicon(spark, ["milk", "butter", "egg", "chicken breast", "salmon", "hen"],
                          EXCUSING_BEFORE, EXCUSING_AFTER)


@pytest.fixture(scope="module")
def closure(spark):
    edges = spark.createDataFrame([("almond", "nut"), ("nut", "plant"), ("oat", "grain"), ("grain", "plant"),
                                   ("plant", "organism"), ("organism", "plant")], "child string, parent string")
    roots = spark.createDataFrame([("plant",)], "root string")
    return L.category_closure(edges, roots).select("term")


def _vegan(spark, lex, closure, phrases):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "id int, phrase string")
    out = L.classify_vegan(df, "id", "phrase", lex, closure).collect()
    return {r.phrase: r.vegan for r in out}


def test_vegan_rules(spark, lex, closure):
    got = _vegan(spark, lex, closure, [
        "chicken breast",          # whole phrase flagged
        "almond milk",             # milk excused by a plant-category word before it
        "oat milk butter",         # first flagged word decides (milk, excused)
        "butter substitute",       # excused by the word after it
        "plant based butter",      # two words before, joined by a blank
        "hen",                     # by the user's lexicon
        "whole milk",
        "tomato",
        "no egg",
    ])
    assert got == {"chicken breast": False, "almond milk": True, "oat milk butter": True,
                   "butter substitute": True, "plant based butter": True, "hen": False,
                   "whole milk": False, "tomato": True, "no egg": True}


def test_closure_with_cycle_and_senses(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("x", "y")], "child string, parent string")
    senses = spark.createDataFrame([("cee", "c"), ("ex", "x")], "term string, sense string")
    roots = spark.createDataFrame([("a",)], "root string")
    got = {(r.term, r.root) for r in L.category_closure(edges, roots, senses).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("cee", "a")}


def test_recipe_labels_empty_and_null(spark):
    recipes = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["a", "z"])],
                                    "id int, ingredients array<string>")
    items = spark.createDataFrame([("a", True, True), ("b", False, True)], "ingredient string, keto boolean, vegan boolean")
    got = {r.id: (r.keto, r.vegan) for r in
           R.label_recipes(recipes, "id", "ingredients", items, "ingredient", ["keto", "vegan"]).collect()}
    assert got == {1: (False, True), 2: (True, True), 3: (None, None), 4: (False, False)}


def test_keto_threshold_and_carbs(spark):
    matches = spark.createDataFrame([(1, 10, 0.5), (2, 11, 0.5), (3, 12, 0.5), (4, 13, 0.05), (5, 14, 0.9)],
                                    "query_id long, item_id long, sim double")
    cat = spark.createDataFrame([(10, 10.0), (11, None), (12, math.nan), (13, 1.0), (14, 10.5)],
                                "item long, carbs double")
    got = {r.query_id: r.keto for r in V.classify_keto(matches, cat, "item", "carbs", 0.1, 10.0).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_diet_filter_validation(spark):
    df = spark.createDataFrame([(1, True, True), (2, True, False)], "id int, keto boolean, vegan boolean")
    assert [r.id for r in R.diet_filter(df, " Keto , VEGAN").collect()] == [1]
    with pytest.raises(ValueError):
        R.diet_filter(df, "paleo")
    with pytest.raises(ValueError):
        R.diet_filter(df, " , ")


def test_vocab_ids_and_lookup(spark):
    items = spark.createDataFrame([("2 cups tomatoes",), ("1 egg",), ("3 eggs",), ("salt",)], "line string")
    vocab = R.vocab_ids(R.ingredient_vocab(items, "line"))
    got = [(r.id, r.ingredient) for r in vocab.orderBy("id").collect()]
    assert got == [(1, "egg"), (2, "salt"), (3, "tomatoe")]
    terms = R.ids_to_terms(spark, vocab, "3, x,1").orderBy("pos").collect()
    assert [t.ingredient for t in terms] == ["tomatoe", "egg"]
    with pytest.raises(ValueError):
        R.ids_to_terms(spark, vocab, "1, 99")
    sugg = [r.ingredient for r in R.vocab_suggest(vocab, " gg ").collect()]
    assert sugg == ["egg"]


def test_plant_closure_default_roots(spark):
    edges = spark.createDataFrame([("almond", "nut"), ("marcona", "almond"), ("butter", "dairy")],
                                  "child string, parent string")
    got = {r.term for r in L.plant_closure(edges).collect()}
    assert {"almond", "marcona", "nut", "seed", "fungus"} <= got and "butter" not in got


def test_classification_report_by_hand(spark):
    from larder.operators import evaluate as EV
    rows = [(1, 1)] * 3 + [(1, 0)] * 1 + [(0, 0)] * 4 + [(0, 1)] * 2 + [(2, 2)] * 1
    df = spark.createDataFrame(rows, "t int, p int")
    got = {r.label: (r.precision, r.recall, r.f1, r.support) for r in EV.classification_report(df, "t", "p").collect()}
    assert got["1"][:2] == (0.6, 0.75) and got["1"][3] == 4
    assert got["0"][:2] == (0.8, 4 / 6) and got["2"][:3] == (1.0, 1.0, 1.0)
    assert got["accuracy"][2] == 8 / 11 and got["accuracy"][0] is None
    assert abs(got["macro avg"][0] - (0.6 + 0.8 + 1.0) / 3) < 1e-12


def test_histogram_edges(spark):
    from larder.operators import evaluate as EV
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    got = {r.bin: r.n for r in EV.histogram(df, "x", 5).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1}          # the maximum lands in the last bin
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    got = {r.bin: r.n for r in EV.histogram(same, "x", 4).collect()}
    assert got == {1: 2, 2: 0, 3: 0, 4: 0}                # all-equal input: one full bin
    empty = spark.createDataFrame([], "x double")
    assert sum(r.n for r in EV.histogram(empty, "x", 3).collect()) == 0


def test_hot_recipe_and_hot_ingredient(spark):
    # one recipe holds a third of the rows and one ingredient appears in most recipes
    rows = [(0, "salt")] * 3000 + [(i, "salt") for i in range(1, 3001)] + [(i, f"x{i % 7}") for i in range(1, 3001)]
    items = spark.createDataFrame(rows, "recipe int, item string").repartition(8)
    labels = spark.createDataFrame([("salt", True)] + [(f"x{j}", j != 3) for j in range(7)], "item string, vegan boolean")
    got = {r.recipe: r.vegan for r in R.label_items(items, ["recipe"], "item", labels, ["vegan"]).collect()}
    assert len(got) == 3001 and got[0] is True
    assert all(got[i] == (i % 7 != 3) for i in range(1, 3001))
    # without the broadcast, on a shuffle join
    got2 = {r.recipe: r.vegan for r in
            R.label_items(items, ["recipe"], "item", labels, ["vegan"], max_broadcast_rows=1).collect()}
    assert got2 == got


def test_keyword_heuristic_default_words(spark):
    df = spark.createDataFrame([("Peanut butter",), ("eggless cake",), ("Beef stew",), ("tofu",)], "x string")
    got = [r[0] for r in df.select(L.keyword_flag("x")).collect()]
    # substring and case-sensitive, with the heuristic's known false labels
    assert got == [False, False, True, True]
