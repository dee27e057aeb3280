"""larder: recipe and food-data analytics as Spark DataFrame jobs.

The public functions, by task:

* cleaning products: ``clean_products``, ``write_clean_products``, ``median_per_key``,
  ``apply_overrides``, ``append_rows``
* ingredient text: ``normalize_ingredient``, ``extract_name``, ``singularize``, ``fold_accents``
* labels: ``make_lexicon``, ``category_closure``, ``plant_closure``, ``classify_vegan``,
  ``knn``, ``IvfIndex``, ``classify_keto``, ``label_recipes``, ``label_sample``
* search: ``rank_bm25``, ``build_postings``, ``rank_postings``, ``search_fuzzy``,
  ``search_by_ids``, ``match_search``, ``fuzzy_terms``
* vocabulary and filters: ``ingredient_vocab``, ``vocab_ids``, ``vocab_suggest``,
  ``ids_to_terms``, ``diet_filter``
* evaluation: ``classification_report``, ``misclassified``
* loading: ``guarded_load``, ``resume_missing``, ``load_labelled``, ``ingest``, ``embed_stream``
* session: ``build_session`` (AQE on, shuffle partitions sized from the input)
"""

from larder.functions.text import extract_name, fold_accents, normalize_ingredient, singularize
from larder.operators.evaluate import classification_report, misclassified
from larder.operators.lexicon import (category_closure, classify_vegan, label_sample, make_lexicon,
                                      plant_closure)
from larder.operators.products import (append_rows, apply_overrides, clean_products, median_per_key,
                                       write_clean_products)
from larder.operators.recipes import (diet_filter, ids_to_terms, ingredient_vocab, label_recipes, vocab_ids,
                                      vocab_suggest)
from larder.operators.search import (build_postings, fuzzy_terms, match_search, rank_bm25, rank_postings,
                                     search_by_ids, search_fuzzy)
from larder.operators.vectors import IvfIndex, classify_keto, knn
from larder.session import build_session
from larder.sources.io import guarded_load, load_labelled, resume_missing
from larder.streaming.ingest import embed_stream, ingest

__all__ = [
    "IvfIndex", "append_rows", "apply_overrides", "build_postings", "build_session", "category_closure",
    "classification_report", "classify_keto", "classify_vegan", "clean_products", "diet_filter",
    "embed_stream", "extract_name", "fold_accents", "fuzzy_terms", "guarded_load", "ids_to_terms",
    "ingest", "ingredient_vocab", "knn", "label_recipes", "label_sample", "load_labelled", "make_lexicon",
    "match_search", "median_per_key", "misclassified", "normalize_ingredient", "plant_closure",
    "rank_bm25", "rank_postings", "resume_missing", "search_by_ids", "search_fuzzy", "singularize",
    "vocab_ids", "vocab_suggest", "write_clean_products",
]
