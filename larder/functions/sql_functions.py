"""The text rules and labels as SQL functions, for queries written in SQL alone.

``register(spark)`` defines them as temporary functions of the session.  They
are SQL bodies, so the optimizer sees built-in expressions, as it does for the
column functions of ``functions.text``, whose rule tables they are made from.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from larder.fixed_values import ASCII_PUNCTUATION, HEURISTIC_ANIMAL_WORDS
from larder.functions import text as T


def lit(s: str) -> str:
    """A Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _drop(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)})"


def _chain(x: str, *patterns: str) -> str:
    for p in patterns:
        x = _drop(x, p)
    return x


def _ends(x: str, suffixes) -> str:
    return "(" + " OR ".join(f"endswith({x}, {lit(s)})" for s in suffixes) + ")"


_EXCEPTIONS = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in T.SINGULAR_EXCEPTIONS.items())
_STRIP = f"^{T.WS_RUN}|{T.WS_RUN}$"
_WORDS = f"filter(split(x, {lit(T.WS_RUN)}), w -> w <> '')"
_QUANTITY = f"[0-9]+{T.WS}*[0-9]*/[0-9]*"

# name -> (parameters, type, body); a function may use those before it
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "squeeze_blanks": ("x STRING", "STRING", f"trim({_drop('x', T.WS_RUN, ' ')})"),
    "count_words": ("x STRING", "INT", f"size({_WORDS})"),
    "term_list": ("x STRING", "ARRAY<STRING>", f"filter(split(lower(x), {lit(T.TERM_SPLIT)}), w -> w <> '')"),
    "clean_name": ("x STRING", "STRING", "squeeze_blanks(" + _drop("lower(x)", "[^a-zA-Z0-9_ \\t\\n\\x0B\\f\\r-]+") + ")"),
    "singular_word": ("w STRING", "STRING", f"""CASE w {_EXCEPTIONS} ELSE
        CASE WHEN length(w) < 3 OR {_ends('w', T.KEEP_SUFFIXES)} THEN w
             WHEN endswith(w, 'ies') THEN left(w, length(w) - 3) || 'y'
             WHEN {_ends('w', T.ES_DROP_SUFFIXES)} THEN left(w, length(w) - 2)
             WHEN endswith(w, 's') THEN left(w, length(w) - 1) ELSE w END END"""),
    "stem_last_word": ("x STRING", "STRING", """CASE
        WHEN endswith(x, 'ies') THEN left(x, length(x) - 3) || 'y'
        WHEN endswith(x, 'es') AND length(x) >= 3 AND substr(x, length(x) - 2, 1) IN ('s', 'x', 'z') THEN left(x, length(x) - 2)
        WHEN endswith(x, 's') THEN left(x, length(x) - 1) ELSE x END"""),
    "ingredient_term": ("x STRING", "STRING", "squeeze_blanks(stem_last_word(squeeze_blanks(" + _chain(
        f"translate({_chain('lower(x)', _STRIP, ',[^,]*$', chr(92) + '([^()]+' + chr(92) + ')', _QUANTITY)}, "
        f"{lit(ASCII_PUNCTUATION)}, {lit(' ' * len(ASCII_PUNCTUATION))})",
        T.MEASUREMENT_PATTERN, "[^a-z \\t\\n\\x0B\\f\\r]+") + ")))"),
    "ingredient_name": ("x STRING", "STRING", "squeeze_blanks(" + _chain(
        "squeeze_blanks(" + _chain("lower(x)", _STRIP, ",[^,]*$", "\\([^()]+\\)", "(?s) - .*$") + ")",
        T.QUANTITY_PREFIX, T.UNIT_PREFIX, T.PREPARATION_PATTERN) + ")"),
    "list_items": ("x STRING", "ARRAY<STRING>", "regexp_extract_all(" + _drop("x", "[\\[\\]]+") + f", {lit(chr(39) + '(.*?)' + chr(39))}, 1)"),
    "holds_none": ("x STRING, words ARRAY<STRING>", "BOOLEAN", "NOT exists(words, w -> contains(x, w))"),
    "looks_vegan": ("x STRING", "BOOLEAN", f"holds_none(x, array({', '.join(lit(w) for w in HEURISTIC_ANIMAL_WORDS)}))"),
    "low_carb": ("carbs DOUBLE, most DOUBLE", "BOOLEAN", "coalesce(carbs <= most AND NOT isnan(carbs), false)"),
}
# A lambda's body cannot call a function that is defined in SQL, so this one holds the rule itself.
_RULE = FUNCTIONS["singular_word"][2]
FUNCTIONS["singular_phrase"] = (
    "x STRING", "STRING", f"array_join(transform(split(squeeze_blanks(translate(lower(x), '-', ' ')), ' '), w -> {_RULE}), ' ')")


def register(spark: SparkSession) -> list[str]:
    """Define all functions for this session; their names."""
    for name, (parameters, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
