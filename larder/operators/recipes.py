"""Recipe-level operators: labels from item labels, vocabulary, lookups, filters.

Item labels are computed once per DISTINCT ingredient, then joined back; the
recipe label is a ``bool_and`` aggregate (partial + final), so a recipe with
many rows, or one ingredient shared by a third of all recipes, is split over
tasks instead of landing in one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.fixed_values import DIETS
from larder.functions import text as T
from larder.operators.util import DEFAULT_BROADCAST_ROWS, bounded_broadcast, with_column_once, with_dense_ids


def label_items(items: DataFrame, recipe_cols: list[str], item_col: str, item_labels: DataFrame,
                label_cols: list[str], max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Recipe labels from exploded ``(recipe..., item)`` rows.

    ``item_labels`` holds one row per distinct item.  It is broadcast when its
    row count is within the checked bound; above it the join shuffles and
    adaptive execution splits skewed item keys.  An item without a label
    counts as false.
    """
    labels = bounded_broadcast(item_labels.select(F.col(item_col).alias("_item"), *label_cols),
                               max_broadcast_rows, materialize=True)
    joined = items.join(labels, items[item_col] == labels["_item"], "left")
    aggs = [F.bool_and(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in label_cols]
    return joined.groupBy(*recipe_cols).agg(*aggs)


def label_recipes(recipes: DataFrame, id_col: str, list_col: str, item_labels: DataFrame,
                  item_col: str, label_cols: list[str],
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Recipes with an ``ARRAY<STRING>`` of items to ``(id, labels...)``.

    Empty list: every label true (all of nothing).  NULL list: NULL labels.
    A NULL item has no label, so it counts as false.
    """
    exploded = recipes.select(id_col, F.col(list_col).isNull().alias("_null_list"),
                              (F.coalesce(F.size(list_col), F.lit(0)) > 0).alias("_has_items"),
                              F.explode_outer(list_col).alias("_it"))
    labels = bounded_broadcast(item_labels.select(F.col(item_col).alias("_item"), *label_cols),
                               max_broadcast_rows, materialize=True)
    joined = exploded.join(labels, exploded["_it"] == labels["_item"], "left")
    aggs = [F.bool_and(~F.col("_has_items") | F.coalesce(F.col(c), F.lit(False))).alias(c) for c in label_cols]
    out = joined.groupBy(id_col).agg(F.max("_null_list").alias("_null_list"), *aggs)
    return out.select(id_col, *[F.when(~F.col("_null_list"), F.col(c)).alias(c) for c in label_cols])


def ingredient_vocab(items: DataFrame, item_col: str, out_col: str = "ingredient") -> DataFrame:
    """Global set of normalised ingredient terms (blank terms dropped)."""
    terms = with_column_once(items.select(item_col), out_col, T.normalize_ingredient(item_col))
    return terms.filter(F.col(out_col) != "").select(out_col).distinct()


def vocab_ids(vocab: DataFrame, term_col: str = "ingredient", limit: int | None = None) -> DataFrame:
    """Stable ids 1..n in text order; an optional limit keeps the first n ids."""
    out = with_dense_ids(vocab.select(term_col), [term_col], "id", start=1)
    if limit is not None:
        out = out.filter(F.col("id") <= limit)
    return out.select("id", term_col)


def vocab_suggest(vocab: DataFrame, query: str, term_col: str = "ingredient") -> DataFrame:
    """Case-sensitive substring suggestions ordered by length then id; empty query gives all."""
    q = (query or "").strip()
    out = vocab if q == "" else vocab.filter(F.col(term_col).contains(q))
    return out.select("id", term_col, F.length(term_col).alias("length")).orderBy("length", "id")


def parse_ids(spark, ids_text: str) -> DataFrame:
    """List of ids, separated by blanks or commas, to ``(pos, raw, term_id)``.

    Items that are not all digits are skipped; a number beyond 64 bits has a NULL ``term_id``.
    """
    parts = spark.createDataFrame([(ids_text,)], "s string") \
        .select(F.posexplode(F.split(F.trim("s"), r"\s*,\s*|\s+")).alias("pos", "raw"))
    return parts.filter(F.col("raw").rlike("^[0-9]+$")).select("pos", "raw", F.col("raw").try_cast("long").alias("term_id"))


def ids_to_terms(spark, vocab: DataFrame, ids_text: str, term_col: str = "ingredient",
                 strict: bool = True) -> DataFrame:
    """Ids to vocabulary terms in the given order; unknown ids raise when ``strict``."""
    ids = parse_ids(spark, ids_text)
    found = ids.join(vocab.withColumnRenamed("id", "term_id"), "term_id", "left")
    if strict:
        missing = found.filter(F.col(term_col).isNull()).select("raw").limit(5).collect()
        if missing:
            raise ValueError(f"unknown ingredient ids: {[r.raw for r in missing]}")
    return found.filter(F.col(term_col).isNotNull()).select("pos", "term_id", term_col)


def parse_diets(diets: str) -> list[str]:
    """Comma list of diet names, trimmed and lowercased; empty or unknown names raise."""
    names = [d.strip().lower() for d in (diets or "").split(",") if d.strip()]
    if not names:
        raise ValueError("no diet given")
    bad = [d for d in names if d not in DIETS]
    if bad:
        raise ValueError(f"unknown diet(s): {bad}; allowed: {DIETS}")
    return names


def diet_filter(df: DataFrame, diets: str) -> DataFrame:
    """Rows whose every named boolean diet column is true."""
    cond = reduce(lambda a, b: a & b, [F.coalesce(F.col(d), F.lit(False)) for d in parse_diets(diets)])
    return df.filter(cond)
