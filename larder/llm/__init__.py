"""Operators of a training-data pipeline: de-duplication, formatting, mixing, packing, filtering.

Each module holds one operator with its own interface; ``queries`` registers
the ``opN_*`` queries that apply them to the whole tables.  Nothing else in
the library imports this subpackage.
"""
