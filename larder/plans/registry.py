"""Registry of the queries run on the driver tables, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` builder and its oracle SQL."""
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return deco


def load_all():
    # importing the modules fills the registry
    from larder.plans import (io_keys, text_keys, product_keys, lexicon_keys,  # noqa: F401
                              eval_keys, vector_keys, search_keys, stream_keys, sql_keys)
    return QUERIES, ORACLES
