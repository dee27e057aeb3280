"""Lexicon rules for the plant-based label: hits, category closure, context.

Everything works on DISTINCT phrases (the ingredient vocabulary) and joins
small, size-checked lexicon tables by broadcast; the per-recipe label is a
later ``bool_and`` (see ``recipes.label_recipes``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.fixed_values import EXCUSING_AFTER, EXCUSING_BEFORE, HEURISTIC_ANIMAL_WORDS, PLANT_CATEGORIES
from larder.functions import text as T
from larder.operators.util import DEFAULT_BROADCAST_ROWS, bounded_broadcast, written


def lexicon_term(col) -> Column:
    """Lexicon side normalisation: lowercase, hyphen to blank (no singular, by design)."""
    c = F.col(col) if isinstance(col, str) else col
    return T.collapse_ws(F.translate(F.lower(c), "-", " "))


def prepare_phrase(col) -> Column:
    """Ingredient line to the phrase the lexicon is matched against."""
    return T.singularize(T.extract_name(col))


def make_lexicon(spark: SparkSession, flagged, excusing_before=EXCUSING_BEFORE,
                 excusing_after=EXCUSING_AFTER) -> DataFrame:
    """Lexicon table from a user's flagged terms; context words default to the fixed lists."""
    rows = [(t, "flagged") for t in flagged] + [(t, "excusing_before") for t in excusing_before] + \
           [(t, "excusing_after") for t in excusing_after]
    return spark.createDataFrame(rows, "term string, kind string")


def prepare_lexicon(lexicon: DataFrame) -> DataFrame:
    """Normalised, de-duplicated ``(term, kind)`` rows, written once.

    The lexicon is small and read by several lookups; writing it once keeps
    its de-duplication out of every query plan that uses it.
    """
    if getattr(lexicon, "_larder_prepared", False):
        return lexicon
    out = lexicon.select(lexicon_term("term").alias("term"), F.col("kind")).distinct().checkpoint(eager=True)
    out._larder_prepared = True
    return out


def _terms(lexicon: DataFrame, kind: str, max_rows: int) -> DataFrame:
    t = prepare_lexicon(lexicon).filter(F.col("kind") == kind).select("term")
    return bounded_broadcast(t, max_rows)


def lexicon_hits(df: DataFrame, id_col: str, phrase_col: str, lexicon: DataFrame,
                 max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Whole-phrase hit and the first flagged word of each phrase.

    Output: ``id, phrase, words, whole_hit, first_pos (0-based, NULL if none), first_word``.
    Multi-word lexicon entries can only hit as the whole phrase.  Both
    lookups are broadcast joins against the (size-checked) lexicon; the only
    shuffle is the per-phrase ``min(position)`` aggregate.
    """
    flagged = _terms(lexicon, "flagged", max_broadcast_rows)
    whole_t = flagged.select(F.col("term").alias("_whole"))
    word_t = flagged.select(F.col("term").alias("_word_hit"))
    base = df.select(F.col(id_col).alias("id"), F.col(phrase_col).alias("phrase")) \
        .withColumn("words", F.filter(F.split("phrase", " "), lambda w: w != ""))
    base = base.join(whole_t, base.phrase == whole_t._whole, "left")
    words = base.select("id", "phrase", "words", F.col("_whole").isNotNull().alias("whole_hit"),
                        F.posexplode_outer("words").alias("pos", "word"))
    words = words.join(word_t, words.word == word_t._word_hit, "left")
    # phrase and whole_hit depend on id only: grouping keys, so the aggregate
    # buffer is one int (hash aggregate) and the word array is rebuilt after
    out = words.groupBy("id", "phrase", "whole_hit").agg(
        F.min(F.when(F.col("_word_hit").isNotNull(), F.col("pos"))).cast("int").alias("first_pos"))
    out = out.withColumn("words", F.filter(F.split("phrase", " "), lambda w: w != ""))
    return out.select("id", "phrase", "words", "whole_hit", "first_pos",
                      F.try_element_at("words", F.col("first_pos") + 1).alias("first_word"))


def category_closure(edges: DataFrame, roots: DataFrame, senses: DataFrame | None = None) -> DataFrame:
    """All ``(term, root)`` where a sense of ``term`` is ``root`` or lies below it.

    ``edges`` is ``(child, parent)``; ``roots`` has one column ``root``.  Path
    doubling: every round joins the pairs of a node and something above it
    with themselves, so after k rounds they reach 2^k levels, and a chain of
    depth d takes about log2(d) rounds, each one written table.  It ends when a
    round adds nothing; cycles are fine, a pair exists once.  The tables hold every (node, category
    above it), roots or not: a hierarchy's nodes times their ancestors.
    """
    pairs = written(edges.select(F.col("child").alias("node"), F.col("parent").alias("above")).distinct(), "closure")
    known, found = 0, pairs.count()
    while found > known:
        further = pairs.withColumnRenamed("above", "via").join(pairs.withColumnRenamed("node", "via"), "via").select("node", "above")
        pairs = written(pairs.unionByName(further).distinct(), "closure")
        known, found = found, pairs.count()
    tops = roots.select("root").distinct()
    seen = pairs.join(tops, pairs["above"] == tops["root"]).select("root", "node") \
        .unionByName(tops.select("root", F.col("root").alias("node"))).distinct()
    reached = seen.select(F.col("node").alias("term"), "root")
    if senses is not None:
        via = senses.join(seen, senses.sense == seen.node).select("term", "root")
        reached = reached.unionByName(via)
    return reached.distinct()


def plant_closure(edges: DataFrame, senses: DataFrame | None = None, roots=PLANT_CATEGORIES) -> DataFrame:
    """Terms under the plant categories (default roots: the fixed category list)."""
    spark = edges.sparkSession
    root_df = spark.createDataFrame([(r,) for r in roots], "root string")
    return category_closure(edges, root_df, senses).select("term").distinct()


def classify_vegan(phrases: DataFrame, id_col: str, phrase_col: str, lexicon: DataFrame,
                   closure_terms: DataFrame | None = None,
                   max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Plant-based label of each phrase.

    false when the whole phrase is flagged; true when no word is flagged;
    otherwise the FIRST flagged word decides: excused (true) when the word
    before it is a plant-category term or an excusing word, or the two words
    before it joined by a blank are an excusing word, or the word after it is
    an excusing-after word.
    """
    lexicon = prepare_lexicon(lexicon)
    hits = lexicon_hits(phrases, id_col, phrase_col, lexicon, max_broadcast_rows)
    p = F.col("first_pos")
    before = lexicon.filter(F.col("kind") == "excusing_before").select(F.col("term").alias("t"))
    if closure_terms is not None:
        before = before.unionByName(closure_terms.select(F.lower("term").alias("t")))
    # small (context words + category terms): de-duplicated and written once, then size-checked
    before = bounded_broadcast(before.distinct(), max_broadcast_rows, materialize=True)
    after = _terms(lexicon, "excusing_after", max_broadcast_rows).select(F.col("term").alias("t"))
    cand = hits.select(
        "*",
        F.when(p >= 1, F.try_element_at("words", p)).alias("_prev"),
        F.when(p >= 2, F.concat_ws(" ", F.try_element_at("words", p - 1), F.try_element_at("words", p))).alias("_prev2"),
        F.when(p.isNotNull(), F.try_element_at("words", p + 2)).alias("_next"))
    # three lookups, each a broadcast join of a distinct term list: no shuffle, no row growth
    b1, b2, a1 = before.alias("b1"), before.alias("b2"), after.alias("a1")
    j = cand.join(b1, cand._prev == F.col("b1.t"), "left") \
        .join(b2, cand._prev2 == F.col("b2.t"), "left") \
        .join(a1, cand._next == F.col("a1.t"), "left")
    excused = F.col("b1.t").isNotNull() | F.col("b2.t").isNotNull() | F.col("a1.t").isNotNull()
    vegan = F.when(F.col("whole_hit"), F.lit(False)).when(p.isNull(), F.lit(True)).otherwise(excused)
    keys = [F.col("id").alias(id_col)] + ([] if id_col == phrase_col else [F.col("phrase").alias(phrase_col)])
    return j.select(*keys, "whole_hit", "first_pos", "first_word",
                    (excused & p.isNotNull() & ~F.col("whole_hit")).alias("excused"), vegan.alias("vegan"))


def keyword_flag(col, words=HEURISTIC_ANIMAL_WORDS, case_sensitive: bool = True) -> Column:
    """True when the text contains none of ``words`` as a substring (the simple heuristic).

    Case-sensitive by default, like the heuristic it stands for.
    """
    c = F.col(col) if isinstance(col, str) else col
    if not case_sensitive:
        c, words = F.lower(c), [w.lower() for w in words]
    arr = F.array(*[F.lit(w) for w in words])
    return ~F.exists(arr, lambda w: F.contains(c, w))


def label_sample(sample: DataFrame, id_col: str, list_col: str, lexicon: DataFrame,
                 closure_terms: DataFrame | None, catalogue: DataFrame, name_col: str, carb_col: str,
                 carb_limit: float = 10.0) -> DataFrame:
    """Both diet labels for recipes given as ``ARRAY<STRING>`` ingredient lists.

    Plant-based: the lexicon rules on each distinct ingredient.  Low-carb:
    the carbs of the catalogue product with the same cleaned name (an equi
    join; ``vectors.knn`` is the similarity-based alternative), the lower middle
    if the name occurs several times; no product or NULL / NaN carbs gives false.  Recipe label = all items pass.
    """
    from larder.operators.products import median_per_key
    from larder.operators.recipes import label_recipes
    items = sample.select(F.explode(list_col).alias("item")).distinct() \
        .withColumn("phrase", prepare_phrase("item"))
    vegan = classify_vegan(items, "item", "phrase", lexicon, closure_terms).select("item", "phrase", "vegan")
    cat = median_per_key(catalogue.select(F.col(name_col).alias("phrase"), F.col(carb_col).cast("double").alias("_c")),
                         "phrase", "_c", "_carbs")
    labels = vegan.join(cat, "phrase", "left").select(
        "item", "vegan",
        F.coalesce((F.col("_carbs") <= carb_limit) & ~F.isnan("_carbs"), F.lit(False)).alias("keto"))
    return label_recipes(sample, id_col, list_col, labels, "item", ["keto", "vegan"])
