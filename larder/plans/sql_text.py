"""DuckDB spellings of the text rules, for the SQL oracles.

The oracle is a second, independent engine evaluating the same written rules;
these helpers only render the rule tables of ``larder.functions.text`` as
DuckDB SQL text so that both sides use one source of truth for the rules.
"""

from __future__ import annotations

from larder.fixed_values import ASCII_PUNCTUATION
from larder.functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def collapse_ws(x: str) -> str:
    return f"trim({rr(x, T.WS_RUN, ' ')})"


def py_strip(x: str) -> str:
    return rr(x, f"^{T.WS_RUN}|{T.WS_RUN}$")


def word_count(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, {q(T.WS_RUN)}), lambda w: w <> ''))"


def token_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(T.TOKEN_PATTERN)}))"


def analyse_terms(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), {q(T.TERM_SPLIT)}), lambda t: t <> '')"


def clean_text(x: str) -> str:
    s = rr(f"lower({x})", "[^a-zA-Z0-9_ \\t\\n\\x0B\\f\\r-]")
    return f"trim({rr(s, T.WS_RUN, ' ')})"


def singular_word(w: str) -> str:
    exc = " ".join(f"WHEN {w} = {q(k)} THEN {q(v)}" for k, v in T.SINGULAR_EXCEPTIONS.items())
    keep = " OR ".join([f"length({w}) < 3"] + [f"ends_with({w}, {q(s)})" for s in T.KEEP_SUFFIXES])
    drop_es = " OR ".join(f"ends_with({w}, {q(s)})" for s in T.ES_DROP_SUFFIXES)
    return (f"CASE {exc} WHEN {keep} THEN {w} "
            f"WHEN ends_with({w}, 'ies') THEN substr({w}, 1, length({w}) - 3) || 'y' "
            f"WHEN {drop_es} THEN substr({w}, 1, length({w}) - 2) "
            f"WHEN ends_with({w}, 's') THEN substr({w}, 1, length({w}) - 1) "
            f"ELSE {w} END")


def singularize(x: str, split_hyphens: bool = True) -> str:
    s = collapse_ws(f"replace(lower({x}), '-', ' ')" if split_hyphens else f"lower({x})")
    return f"array_to_string(list_transform(string_split({s}, ' '), lambda w: {singular_word('w')}), ' ')"


def suffix_stem(x: str) -> str:
    return (f"CASE WHEN ends_with({x}, 'ies') THEN substr({x}, 1, length({x}) - 3) || 'y' "
            f"WHEN ends_with({x}, 'es') AND length({x}) >= 3 "
            f"AND substr({x}, length({x}) - 2, 1) IN ('s', 'x', 'z') THEN substr({x}, 1, length({x}) - 2) "
            f"WHEN ends_with({x}, 'es') THEN substr({x}, 1, length({x}) - 1) "
            f"WHEN ends_with({x}, 's') THEN substr({x}, 1, length({x}) - 1) "
            f"ELSE {x} END")


def normalize_ingredient(x: str) -> str:
    s = py_strip(f"lower({x})")
    s = rr(s, ",[^,]*$")
    s = rr(s, "\\([^()]+\\)")
    s = rr(s, f"[0-9]+{T.WS}*[0-9]*/[0-9]*")
    s = f"translate({s}, {q(ASCII_PUNCTUATION)}, {q(' ' * len(ASCII_PUNCTUATION))})"
    s = rr(s, T.MEASUREMENT_PATTERN)
    s = rr(s, "[^a-z \\t\\n\\x0B\\f\\r]")
    s = collapse_ws(s)
    return collapse_ws(suffix_stem(f"({s})"))


def extract_name(x: str) -> str:
    s = py_strip(f"lower({x})")
    s = rr(s, ",[^,]*$")
    s = rr(s, "\\([^()]+\\)")
    s = rr(s, "(?s) - .*$")
    s = collapse_ws(s)
    s = rr(s, T.QUANTITY_PREFIX)
    s = rr(s, T.UNIT_PREFIX)
    s = rr(s, T.PREPARATION_PATTERN)
    return collapse_ws(s)


def parse_list_text(x: str) -> str:
    pattern = q("'(.*?)'")
    return f"regexp_extract_all({rr(x, '[\\[\\]]+')}, {pattern}, 1)"
