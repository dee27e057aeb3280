"""Token counts per section, attributed by character offsets.

A document is encoded whole and once, as a model would see it.  Each token's
character span is then matched with the spans of the sections; a token that
crosses a boundary is allocated by ``rule``:

* ``first`` - the section of its first character,
* ``last`` - the section of its last character,
* ``most`` - the section with most of its characters, the earlier one in a tie.

Sections are the fields of a row if several are given (joined by a line
break, which belongs to the field before it), else the lines of the text, each
with its line break.  Counts of a document's sections always add up to the
tokens of the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larder.llm.tokens import default_path, encoder

RULES = ("first", "last", "most")


def token_spans(text: bytes, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of byte-level tokens; a token of part of a character covers it whole."""
    stop = np.cumsum(sizes[ids])
    raw = np.frombuffer(text, np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[stop - sizes[ids]], char[stop - 1] + 1


def allocate(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses a boundary; ``starts`` are the sections' first characters."""
    first = np.searchsorted(starts, begin, side="right") - 1
    last = np.searchsorted(starts, end - 1, side="right") - 1
    crossing = first != last
    if rule == "last":
        return last, crossing
    place = first.copy()
    if rule == "most":
        for i in np.flatnonzero(crossing).tolist():
            edges = np.concatenate([[begin[i]], starts[first[i] + 1:last[i] + 1], [end[i]]])
            place[i] = first[i] + int(np.argmax(np.diff(edges)))
    return place, crossing


def section_token_counts(docs: DataFrame, id_col: str = "doc_id", fields: tuple = ("text",), rule: str = "most",
                         tokenizer: str | None = None) -> DataFrame:
    """``id_col, section, char_start, char_end, n_tokens, n_crossing``, one row per section.

    Null fields count as empty; an empty document has one empty section with 0
    tokens.  ``n_crossing`` counts the section's tokens that reach over its
    edge.  Rows with equal ids are documents of their own.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_path()
    source = docs.select(F.col(id_col).alias("id"),
                         *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"f{i}") for i, c in enumerate(fields)])
    names = ["section", "char_start", "char_end", "n_tokens", "n_crossing"]
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType)]
                          + [T.StructField(n, T.LongType()) for n in names])
    arrow = to_arrow_schema(schema)
    lines = len(fields) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        sizes = enc.token_bytes()
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns[1:]]))
            texts = ["\n".join(r) for r in rows]
            which, found = [], []
            for i, (row, text, ids) in enumerate(zip(rows, texts, enc.each(texts))):
                parts = text.split("\n") if lines else row
                lengths = np.fromiter(map(len, parts), np.int64, len(parts))
                lengths[:-1] += 1
                if lines and len(parts) > 1 and not parts[-1]:
                    lengths = lengths[:-1]                      # a final line break opens no section
                stops = np.cumsum(lengths)
                starts = stops - lengths
                n = len(starts)
                if len(ids):
                    begin, end = token_spans(text.encode("utf-8", "surrogatepass"), ids, sizes)
                    place, crossing = allocate(begin, end, starts, rule)
                    counts = np.bincount(place, minlength=n), np.bincount(place[crossing], minlength=n)
                else:
                    counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
                found.append((np.arange(n), starts, stops, *counts))
                which.append(np.full(n, i))
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 5
            at = pa.array(np.concatenate(which) if which else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at)] + [pa.array(c, pa.int64()) for c in columns],
                                             schema=arrow)

    return source.mapInArrow(run, schema)
