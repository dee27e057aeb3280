"""Removal of long repeated byte strings by distributed induced sorting of sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(in a document of smaller id, or further left in the same one).

* Sampling.  Each window of ``LENGTH`` bytes names the suffix that starts at
  its smallest ``GRAM``-byte hash, so equal windows name equal suffixes at equal
  distance.  Neighbouring windows share their suffix: a document becomes a
  list of runs of windows, about one per 39 bytes.
* Naming.  Spark's disk-backed shuffle brings equal sampled suffixes (by the hash
  of their first bytes) together.  Suffixes that occur once end here; runs
  that are equal in all their bytes are merged into their earliest one.
* Induction.  What is left are groups of different runs around one sampled
  suffix.  Their suffix tuples are sorted with the lengths of their common
  prefixes; names of longer strings are then induced one byte to the left at
  a time.  A window ``d`` bytes left of the sampled suffix equals another if
  they share ``LENGTH - d`` bytes of common prefix and the name of the ``d`` bytes before.
  A task holds a bounded number of tuples at a time, whole groups; the tuples of
  a group above the bound are dealt over several parts, each tuple to one.  A window
  that no earlier one of its part equals meets those of the other parts in a
  shuffle by its bytes, at most one of each part.

Only hashes of 64 bits and more join equal bytes in the first two steps; windows are compared byte for byte in the
third.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larder.llm.common import small, staged

LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM                 # a sampled suffix starts at most so far right of its window
CHUNK = 1 << 22                       # windows looked at together; their places fit PLACE bits
PLACE = np.uint64((1 << 23) - 1)
TUPLES = 100_000                      # tuples of a group that are sorted together
BROADCAST_ITEMS = 0                   # numbers of a broadcast side; 0: small inputs are shuffled as large ones are

_rng = np.random.default_rng(11)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; grown by doubling and kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _chunk_runs(raw: np.ndarray) -> tuple:
    """(suffix hash, run hash, first window, windows, distance of the suffix) of a chunk's runs."""
    n = len(raw)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_BASE, n), out=prefix[1:])
    back = _power(_INVERSE, n + 1)
    gram = _mix((prefix[GRAM:] - prefix[:-GRAM]) * back[:n - GRAM + 1])
    low = (gram & ~PLACE) | np.arange(len(gram), dtype=np.uint64)
    width, count = 1, REACH + 1
    while 2 * width <= count:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < count:
        low = np.minimum(low[:width - count], low[count - width:])
    place = (low & PLACE).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
    windows = np.diff(np.append(first, len(place)))
    at = place[first]
    text = (prefix[first + windows + LENGTH - 1] - prefix[first]) * back[first]
    shape = ((at - first) * (REACH + 2) + windows).astype(np.uint64)
    return gram[at], _mix(text + shape * _M1), first, windows, at - first


def sampled_runs(text: bytes) -> list[tuple]:
    """Runs of a document, chunk by chunk; first windows count from the document's start."""
    raw = np.frombuffer(text, np.uint8)
    out = []
    for c in range(0, max(0, len(raw) - LENGTH + 1), CHUNK):
        suffix, run, first, windows, distance = _chunk_runs(raw[c:c + CHUNK + LENGTH - 1])
        out.append((suffix, run, first + c, windows, distance))
    return out


def repeated_windows(group: np.ndarray, order: np.ndarray, distance: np.ndarray, windows: np.ndarray,
                     texts: list[bytes]) -> np.ndarray:
    """For each run and d, whether its window d bytes left of the sampled suffix starts earlier in another run.

    ``group`` tells the sampled suffixes and their parts apart, ``order`` ranks
    the runs by document and place.
    """
    by = np.argsort(order, kind="stable")
    n = len(by)
    distance, windows = distance[by], windows[by]
    size = np.fromiter((len(texts[i]) for i in by.tolist()), np.int64, n)
    raw = np.frombuffer(b"".join([texts[i] for i in by.tolist()]) + bytes(LENGTH), np.uint8)
    anchor = np.cumsum(size) - size + distance
    _, name = np.unique(group[by], return_inverse=True)

    # sort the sampled suffixes in their groups; common prefixes of neighbours, cut at LENGTH
    right = raw[np.minimum(anchor[:, None] + np.arange(LENGTH + 4), len(raw) - 1)]
    room = size - distance
    right[np.arange(LENGTH + 4)[None, :] >= np.minimum(room, LENGTH)[:, None]] = 0
    words = np.ascontiguousarray(right).view(">u8").astype(np.uint64)
    sort = np.lexsort([*words.T[::-1], name])
    differ = right[sort[1:], :LENGTH] != right[sort[:-1], :LENGTH]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    common[name[sort[1:]] != name[sort[:-1]]] = -1

    found = np.zeros((n, REACH + 1), dtype=bool)
    left = name.astype(np.int64)
    cls = np.empty(n, np.int64)
    for d in range(REACH + 1):
        if d:                                    # names one byte to the left
            far = np.flatnonzero(distance >= d)
            if not len(far):
                break
            _, new = np.unique(left[far] * 256 + raw[anchor[far] - d], return_inverse=True)
            left[far] = new
        here = np.flatnonzero((distance >= d) & (distance - windows < d))
        if len(here) < 2:
            continue
        cls[sort] = np.concatenate([[0], np.cumsum(common < LENGTH - d)])
        _, first, which = np.unique(cls[here] * n + left[here], return_index=True, return_inverse=True)
        found[here, d] = here[first[which]] != here
    out = np.empty_like(found)
    out[by] = found
    return out


def _window_spans(found: np.ndarray, first: np.ndarray, distance: np.ndarray) -> tuple:
    """(row, first window, last window) of neighbouring windows that were found."""
    edge = np.diff(np.pad(found[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)   # left to right
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    base = first[row] + distance[row] - REACH
    return row, base + begin, base + end - 1


def _first_windows(found: np.ndarray, first: np.ndarray, distance: np.ndarray, windows: np.ndarray,
                   texts: list[bytes]) -> Iterator[tuple]:
    """(rows, places, bytes) of the windows that were not found, a bounded number at a time."""
    d = np.arange(REACH + 1)
    for a in range(0, len(texts), 500):
        far, n = distance[a:a + 500, None], windows[a:a + 500, None]
        row, left = np.nonzero((far >= d) & (far - n < d) & ~found[a:a + 500])
        if not len(row):
            continue
        size = np.fromiter(map(len, texts[a:a + 500]), np.int64, len(far))
        raw = np.frombuffer(b"".join(texts[a:a + 500]), np.uint8)
        at = (np.cumsum(size) - size + far[:, 0])[row] - left
        cut = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, LENGTH)[at])
        ends = np.arange(0, cut.size + 1, LENGTH, dtype=np.int32)
        yield row + a, first[row + a] + distance[row + a] - left, pa.Array.from_buffers(
            pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(cut)])


def _runs_of(docs: DataFrame) -> DataFrame:
    schema = T.StructType([T.StructField("suffix", T.LongType()), T.StructField("run", T.LongType()),
                           T.StructField("id", T.LongType()), T.StructField("h", T.LongType()),
                           T.StructField("first", T.IntegerType()), T.StructField("windows", T.ShortType()),
                           T.StructField("distance", T.ShortType())])
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, which, size = [], [], 0

            def flush():
                suffix, run, first, windows, distance = (np.concatenate(x) for x in zip(*held))
                at = pa.array(np.concatenate(which))
                return pa.RecordBatch.from_arrays(
                    [pa.array(suffix.view(np.int64)), pa.array(run.view(np.int64)), batch.column(0).take(at),
                     batch.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int16)),
                     pa.array(distance.astype(np.int16))], schema=arrow)

            for i, text in enumerate(batch.column(2).to_pylist()):
                for part in sampled_runs(text):
                    held.append(part)
                    which.append(np.full(len(part[0]), i))
                    size += len(part[0])
                    if size >= 200_000:
                        yield flush()
                        held, which, size = [], [], 0
            if size:
                yield flush()

    return docs.mapInArrow(cut, schema)


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted runs of a document (by their first windows), each with the bytes of its windows."""
    names = ["suffix", "id", "h", "first", "windows", "distance", "text"]
    for batch in batches:
        held: list[pa.RecordBatch] = []
        for i, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            wanted = np.array(wanted, np.int64)
            for suffix, _, first, windows, distance in sampled_runs(text):
                hit = np.flatnonzero(np.isin(first, wanted))
                first, windows = first[hit], windows[hit]
                held.append(pa.RecordBatch.from_arrays(
                    [pa.array(suffix[hit].view(np.int64)), *[batch.column(k).take(pa.array(np.full(len(hit), i)))
                                                             for k in (0, 1)],
                     pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int16)),
                     pa.array(distance[hit].astype(np.int16)),
                     pa.array([text[a:a + n + LENGTH - 1] for a, n in zip(first.tolist(), windows.tolist())],
                              pa.binary())], names=names))
                if sum(b.num_rows for b in held) >= 5000 or len(held) >= 200:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of a partition sorted by suffix and part, a bounded number of tuples at a time.

    Rows without a window are spans to remove.  The others are the windows of groups in several parts that are the
    first ones of their part.
    """
    names = ["id", "h", "begin", "end", "window"]

    def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: np.asarray(rows.column(c)) for c in ("suffix", "part", "parts", "id", "h", "first", "windows",
                                                       "distance")}
        first, distance, windows = (col[c].astype(np.int64) for c in ("first", "distance", "windows"))
        rank = np.empty(rows.num_rows, np.int64)
        rank[np.lexsort((first + distance, col["h"], col["id"]))] = np.arange(rows.num_rows)
        new = (np.diff(col["suffix"]) != 0) | (np.diff(col["part"]) != 0)      # sorted by both
        texts = rows.column("text").to_pylist()
        found = repeated_windows(np.concatenate([[0], np.cumsum(new)]), rank, distance, windows, texts)
        row, begin, end = _window_spans(found, first, distance)
        yield pa.RecordBatch.from_arrays([pa.array(col["id"][row]), pa.array(col["h"][row]), pa.array(begin),
                                          pa.array(end), pa.nulls(len(row), pa.binary())], names=names)
        split = np.flatnonzero(col["parts"] > 1)
        for row, begin, window in _first_windows(found[split], first[split], distance[split], windows[split],
                                                 [texts[i] for i in split.tolist()]):
            yield pa.RecordBatch.from_arrays([pa.array(col["id"][split[row]]), pa.array(col["h"][split[row]]),
                                              pa.array(begin), pa.array(begin), window], names=names)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < 2 * TUPLES:
            continue
        rows = pa.Table.from_batches(held)
        suffix, part = np.asarray(rows.column("suffix")), np.asarray(rows.column("part"))
        edges = np.flatnonzero((np.diff(suffix) != 0) | (np.diff(part) != 0)) + 1
        if len(edges):                                    # the last group may go on
            yield from judge(rows.slice(0, int(edges[-1])))
            held = rows.slice(int(edges[-1])).to_batches()
            size = sum(b.num_rows for b in held)
    if size:
        yield from judge(pa.Table.from_batches(held))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept`` for every row.

    Texts are taken as UTF-8 bytes, null as empty; ``kept`` (binary) is what
    is left, ``n_spans`` the maximal removed runs.  Rows of equal id and equal
    text are one document (each row gets its result); of equal ids with different texts,
    a hash of the text decides which is earlier.  A null id comes before all others.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc"),
                         F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")) \
        .withColumn("id", F.coalesce("doc", F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    runs = staged(_runs_of(source.where(F.length("text") >= LENGTH).select("id", "h", "text")), "runs")
    # written first: both sides of the join are then plain shuffles, whose skewed partitions Spark can split
    often = staged(runs.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("suffix"), "often")
    again = staged(runs.join(often, "suffix"), "repeated-runs")
    place = F.struct("id", "h", "first")
    kinds = again.groupBy("suffix", "run").agg(F.min(F.struct("id", "h", "first", "windows", "distance")).alias("x"),
                                               F.count(F.lit(1)).alias("times"))
    kinds = staged(kinds.select("suffix", "run", "x.*", "times"), "run-kinds")

    # every occurrence of a run but its earliest goes whole
    whole = again.join(kinds.where("times > 1").select("suffix", "run", place.alias("earliest")), ["suffix", "run"]) \
        .where(place != F.col("earliest")) \
        .select("id", "h", F.col("first").cast("long").alias("begin"),
                (F.col("first") + F.col("windows") - 1).cast("long").alias("end"))

    # different runs around one sampled suffix are compared window by window
    groups = kinds.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select("suffix", F.ceil(F.col("n") / TUPLES).cast("long").alias("parts"))
    groups = staged(groups, "suffix-groups")
    wanted = staged(kinds.join(groups, "suffix").groupBy("id", "h").agg(F.collect_list("first").alias("wanted")),
                    "wanted-runs")
    n_wanted = wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0
    # equal rows are one document: it is cut once
    texts = source.where(F.length("text") >= LENGTH).select("id", "h", "text").dropDuplicates(["id", "h"]).join(
        F.broadcast(wanted) if n_wanted <= BROADCAST_ITEMS else wanted, ["id", "h"]) \
        .mapInArrow(_tuples, "suffix long, id long, h long, first int, windows short, distance short, text binary") \
        .join(small(groups.where("parts > 1")), "suffix", "left") \
        .withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))) \
        .withColumn("part", F.expr("pmod(xxhash64(id, h, first), parts)"))
    judged = staged(texts.repartition("suffix", "part").sortWithinPartitions("suffix", "part")
                    .mapInArrow(_compare, "id long, h long, begin long, end long, window binary"), "judged")
    earlier = F.row_number().over(Window.partitionBy("window").orderBy("id", "h", "begin")) - 1
    across = judged.where("window is not null").withColumn("earlier", earlier).where("earlier > 0")

    spans = whole.unionByName(judged.where("window is null").drop("window")) \
        .unionByName(across.select("id", "h", "begin", "end")).groupBy("id", "h") \
        .agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans")) \
        .select("id", "h", F.col("spans.begin").alias("begin"), F.col("spans.end").alias("end"))
    spans = staged(spans.mapInArrow(_merged, "id long, h long, begin array<long>, end array<long>"), "document-spans")
    n_spans = spans.agg(F.sum(2 * F.size("begin"))).first()[0] or 0
    rows = source.join(F.broadcast(spans) if n_spans <= BROADCAST_ITEMS else spans, ["id", "h"], "left") \
        .select("doc", "text", "begin", "end")
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField("kept", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, begin, end in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                gone, n, at, kept = 0, 0, 0, []
                for a, b in zip(begin or [], end or []):
                    kept.append(text[at:a])
                    gone, n, at = gone + b - a, n + 1, b
                out.append((len(text), gone, n, b"".join([*kept, text[at:]])))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(list(c), type=f.type) for c, f in
                                                                  zip(columns, list(arrow)[1:])], schema=arrow)

    return rows.mapInArrow(remove, schema)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_covered(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1)]
            + [pa.array([[x[i] for x in f] for f in found], pa.list_(pa.int64())) for i in (0, 1)],
            names=["id", "h", "begin", "end"])


def _covered(begin: list, end: list) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows that start from ``begin`` to ``end`` (sorted by begin)."""
    out: list[list[int]] = []
    for a, b in zip(begin, end):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LENGTH)
        else:
            out.append([a, b + LENGTH])
    return [tuple(x) for x in out]
