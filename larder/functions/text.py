"""Column functions for text: cleaning, normalisation, singular forms, terms.

Every function takes and returns a ``Column`` and is made of built-in
expressions, so it stays inside whole-stage code generation.  The one
exception is accent folding (NFKD), which Spark has no expression for; it is
an Arrow-batched pandas UDF that is only fed the non-ASCII rows.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larder.fixed_values import ASCII_PUNCTUATION, MEASUREMENT_WORDS

# ASCII whitespace; spelled out so that Java regex and RE2 agree.
WS = "[ \\t\\n\\x0B\\f\\r]"
WS_RUN = WS + "+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def regex_escape(term: str) -> str:
    """Escape a literal for both Java regex and RE2."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", term)


def alternation(terms) -> str:
    """Regex alternation of escaped literals."""
    return "|".join(regex_escape(t) for t in terms)


# ---------------------------------------------------------------- basics

def py_strip(col) -> Column:
    """Strip leading/trailing whitespace of any kind (``trim`` strips blanks only)."""
    return F.regexp_replace(_c(col), f"^{WS_RUN}|{WS_RUN}$", "")


def collapse_ws(col) -> Column:
    """Runs of whitespace to one blank, then trimmed."""
    return F.trim(F.regexp_replace(_c(col), WS_RUN, " "))


def word_count(col) -> Column:
    """Number of whitespace-separated words; empty text gives 0."""
    return F.size(F.filter(F.split(_c(col), WS_RUN), lambda w: w != ""))


TOKEN_PATTERN = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N} \\t\\n\\x0B\\f\\r]"


def token_count(col) -> Column:
    """Sub-word token count: letter/digit runs plus every other non-blank char."""
    return F.regexp_count(_c(col), F.lit(TOKEN_PATTERN))


TERM_SPLIT = "[^\\p{L}\\p{N}]+"


def analyse_terms(col) -> Column:
    """Index-time analysis: lowercase terms split on anything but letters/digits."""
    return F.array_remove(F.split(F.lower(_c(col)), TERM_SPLIT), "")


# ------------------------------------------------- product-name cleaning

def clean_text(col) -> Column:
    """Lowercase, drop punctuation except hyphen, collapse blanks, trim."""
    s = F.lower(_c(col))
    s = F.regexp_replace(s, "[^a-zA-Z0-9_ \\t\\n\\x0B\\f\\r-]+", "")
    return F.trim(F.regexp_replace(s, WS_RUN, " "))


def has_two_letters(col) -> Column:
    """At least two ASCII letters anywhere in the text."""
    return _c(col).rlike("[a-zA-Z].*[a-zA-Z]")


def not_blank(col) -> Column:
    """Not NULL and not only blanks."""
    c = _c(col)
    return c.isNotNull() & (F.trim(c) != "")


_COMBINING = None


def _combining_table() -> dict:
    """Deletion table of every code point with a non-zero combining class (built once per worker)."""
    global _COMBINING
    if _COMBINING is None:
        _COMBINING = {cp: None for cp in range(0x300, 0x110000) if unicodedata.combining(chr(cp))}
    return _COMBINING


def _fold_series(s: pd.Series) -> pd.Series:
    table = _combining_table()

    def fold(x):
        if x is None:
            return None
        return unicodedata.normalize("NFKD", x).translate(table)
    return s.map(fold)


@F.pandas_udf(StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return _fold_series(s)


_FOLD = None


def _fold_tables():
    """Per-character fold rule (NFKD, then drop combining marks), derived from the Unicode data.

    Folding is character by character (decomposition mappings are per
    character; the canonical reordering only moves combining marks, which
    are dropped).  So a BMP character whose fold is one character, or none,
    is handled by ``translate`` in the JVM; only characters that fold to
    several characters (ligatures, Hangul syllables, ...) or lie outside the
    BMP send their row to Python.
    """
    global _FOLD
    if _FOLD is None:
        src, dst, dels, slow = [], [], [], []
        for cp in range(0x80, 0x110000):
            if 0xD800 <= cp <= 0xDFFF:
                continue
            ch = chr(cp)
            f = unicodedata.normalize("NFKD", ch)
            f = "".join(x for x in f if not unicodedata.combining(x))
            if f == ch:
                continue
            if cp <= 0xFFFF and len(f) == 1:
                src.append(ch)
                dst.append(f)
            elif cp <= 0xFFFF and not f:
                dels.append(ch)
            else:
                slow.append(cp)
        # translate() deletes the characters of `from` that have no partner in `to`
        _FOLD = ("".join(src) + "".join(dels), "".join(dst), "".join(chr(c) for c in slow))
    return _FOLD


# A noncharacter: multi-character folds are marked with it to route their rows
# (a text that already holds it is merely routed to Python, which is also correct).
_MARK = "\uffff"


def fold_accents(col) -> Column:
    """NFKD decomposition with combining marks dropped.

    ASCII rows are returned as they are; rows whose characters all fold to
    at most one character are folded by ``translate`` in the JVM; only rows
    holding a multi-character fold (ligature, Hangul, ...) go to the
    Arrow UDF, which sees NULL for every other row.
    """
    c = _c(col)
    src, dst, slow = _fold_tables()
    ascii_only = c.rlike("^[\\x00-\\x7F]*$")
    # one hash lookup per character (a regex class of thousands of ranges is far slower)
    needs_python = F.instr(F.translate(c, slow, _MARK * len(slow)), _MARK) > 0
    folded = _fold_udf(F.when(needs_python, c))
    return (F.when(c.isNull(), F.lit(None)).when(ascii_only, c)
            .when(needs_python, folded).otherwise(F.translate(c, src, dst)))


# ------------------------------------------------------- singular forms

# Our own irregular plurals (not taken from any library).
SINGULAR_EXCEPTIONS = {
    "leaves": "leaf", "halves": "half", "loaves": "loaf", "knives": "knife", "wives": "wife",
    "lives": "life", "wolves": "wolf", "calves": "calf", "shelves": "shelf", "thieves": "thief",
    "geese": "goose", "teeth": "tooth", "feet": "foot", "mice": "mouse", "children": "child",
    "men": "man", "women": "woman", "people": "person", "oxen": "ox", "shoes": "shoe",
    "cookies": "cookie", "movies": "movie", "pies": "pie", "ties": "tie",
}
ES_DROP_SUFFIXES = ["ches", "shes", "xes", "sses", "zes", "oes"]
KEEP_SUFFIXES = ["ss", "us", "is"]


def singular_word(w: Column) -> Column:
    """Rule-based singular of one lowercase word (first rule that fits)."""
    exc = F.create_map(*[F.lit(x) for kv in SINGULAR_EXCEPTIONS.items() for x in kv])
    n = F.length(w)
    keep = (n < 3)
    for suf in KEEP_SUFFIXES:
        keep = keep | w.endswith(suf)
    drop_es = F.lit(False)
    for suf in ES_DROP_SUFFIXES:
        drop_es = drop_es | w.endswith(suf)
    return (F.when(F.element_at(exc, w).isNotNull(), F.element_at(exc, w))
            .when(keep, w)
            .when(w.endswith("ies"), F.concat(w.substr(F.lit(1), n - 3), F.lit("y")))
            .when(drop_es, w.substr(F.lit(1), n - 2))
            .when(w.endswith("s"), w.substr(F.lit(1), n - 1))
            .otherwise(w))


def singularize(col, split_hyphens: bool = True) -> Column:
    """Lowercase, then every word to its singular.

    Words end at blanks, and at hyphens too unless ``split_hyphens`` is off
    (product names: ``coca-cola`` stays one word).
    """
    s = F.lower(_c(col))
    s = collapse_ws(F.translate(s, "-", " ") if split_hyphens else s)
    words = F.split(s, " ")
    return F.array_join(F.transform(words, singular_word), " ")


# ------------------------------------------------ ingredient line rules

MEASUREMENT_PATTERN = "\\b(" + "|".join(MEASUREMENT_WORDS) + ")\\b"


def drop_after_last_comma(col) -> Column:
    """Text before the last comma (the whole text when there is none)."""
    return F.regexp_replace(_c(col), ",[^,]*$", "")


def drop_brackets(col) -> Column:
    """Remove innermost bracketed parts, brackets included."""
    return F.regexp_replace(_c(col), "\\([^()]+\\)", "")


def suffix_stem(col) -> Column:
    """Plural suffix rule applied to the last word of a phrase."""
    s = _c(col)
    n = F.length(s)
    before_es = s.substr(F.greatest(n - 2, F.lit(1)), F.lit(1))
    return (F.when(s.endswith("ies"), F.concat(s.substr(F.lit(1), n - 3), F.lit("y")))
            .when(s.endswith("es") & (n >= 3) & before_es.isin("s", "x", "z"), s.substr(F.lit(1), n - 2))
            .when(s.endswith("es"), s.substr(F.lit(1), n - 1))
            .when(s.endswith("s"), s.substr(F.lit(1), n - 1))
            .otherwise(s))


def normalize_ingredient(col) -> Column:
    """Ingredient line to a vocabulary term (steps N1 to N8).

    One documented change: the text is trimmed before the suffix rule, so a
    blank left by a removed bracket or unit no longer blocks it.
    """
    s = py_strip(F.lower(_c(col)))
    s = drop_after_last_comma(s)
    s = drop_brackets(s)
    s = F.regexp_replace(s, f"[0-9]+{WS}*[0-9]*/[0-9]*", "")
    s = F.translate(s, ASCII_PUNCTUATION, " " * len(ASCII_PUNCTUATION))
    s = F.regexp_replace(s, MEASUREMENT_PATTERN, "")
    s = F.regexp_replace(s, "[^a-z \\t\\n\\x0B\\f\\r]+", "")
    s = collapse_ws(s)
    return collapse_ws(suffix_stem(s))


# Our own list of preparation words dropped by the name extractor.
PREPARATION_WORDS = [
    "chopped", "diced", "minced", "sliced", "grated", "shredded", "crushed", "peeled", "drained",
    "rinsed", "melted", "softened", "beaten", "divided", "packed", "sifted", "toasted", "cooked",
    "uncooked", "fresh", "freshly", "dried", "frozen", "thawed", "finely", "roughly", "coarsely",
    "thinly", "halved", "quartered", "cubed", "optional",
]
QUANTITY_PREFIX = f"^[0-9]+([.,/-][0-9]+)?({WS_RUN}[0-9]+/[0-9]+)?{WS}*"
UNIT_PREFIX = "^(" + "|".join(MEASUREMENT_WORDS) + f")\\b\\.?{WS}*"
PREPARATION_PATTERN = "\\b(" + "|".join(PREPARATION_WORDS) + ")\\b"


def extract_name(col) -> Column:
    """Ingredient name from a free-text line: quantity, unit, notes removed; no stem."""
    s = py_strip(F.lower(_c(col)))
    s = drop_after_last_comma(s)
    s = drop_brackets(s)
    s = F.regexp_replace(s, "(?s) - .*$", "")
    s = collapse_ws(s)
    s = F.regexp_replace(s, QUANTITY_PREFIX, "")
    s = F.regexp_replace(s, UNIT_PREFIX, "")
    s = F.regexp_replace(s, PREPARATION_PATTERN, "")
    return collapse_ws(s)


def parse_list_text(col) -> Column:
    """A list written as text, e.g. ``['a b' 'c']``, to ``ARRAY<STRING>``."""
    stripped = F.regexp_replace(_c(col), "[\\[\\]]+", "")
    return F.regexp_extract_all(stripped, F.lit("'(.*?)'"), F.lit(1))


# ------------------------------------------------------ nested pickers

def pick_language_text(col, lang: str = "en") -> Column:
    """First ``text`` of an ``ARRAY<STRUCT<lang,text>>`` whose language matches."""
    hits = F.filter(_c(col), lambda x: F.lower(x["lang"]) == F.lit(lang.lower()))
    return F.when(F.size(hits) > 0, F.try_element_at(hits, F.lit(1))["text"])


def pick_nutriment(col, name: str = "carbohydrates", field: str = "100g") -> Column:
    """``field`` of the first struct whose lowercase ``name`` matches; NULL names skipped."""
    hits = F.filter(_c(col), lambda x: F.lower(x["name"]) == F.lit(name.lower()))
    return F.try_element_at(hits, F.lit(1))[field]
