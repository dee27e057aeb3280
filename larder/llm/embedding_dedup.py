"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length 1, so a cosine of ``c`` is a distance of
``sqrt(2 - 2 c)``.  A hash is ``floor((a x + b) / w)`` with Gaussian ``a`` and
uniform ``b``; ``k`` of them make a bucket, and there are ``tables``
independent buckets per vector.  Width, ``k`` and ``tables`` follow from the
number of vectors: the cheapest ones by which a pair right at the threshold
meets in some table with probability ``recall``.

Members of a bucket are compared by exact cosine in double precision.  A bucket
beyond ``TILE`` members is cut into tiles, and each pair of tiles is one unit of
work, so no unit grows with a bucket.  A pair that meets in several tables is
counted in the first.

Equal vectors (by a 128-bit hash of their components) hash and compare once, as
one representative that carries their number, so copies add no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import staged
from larder.llm.components import connected_components

TILE = 1024
RECALL = 0.99


def collision(distance: float, width: float) -> float:
    """Probability that one hash of width ``width`` is equal for two points at ``distance``."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def choose_parameters(n: int, threshold: float, recall: float = RECALL) -> tuple[float, int, int]:
    """(width, k, tables) of least expected work for ``n`` vectors, unrelated pairs being orthogonal."""
    best = None
    for width in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        near, far = collision(sqrt(2 - 2 * threshold), width), collision(sqrt(2), width)
        for k in range(2, 33):
            tables = ceil(log(1 - recall) / log(1 - near ** k))
            work = tables * (20 + n * far ** k)
            if best is None or work < best[0]:
                best = (work, width, k, tables)
    return best[1:]


@cache
def projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The fixed random directions and shifts for vectors of ``dim`` components."""
    rng = np.random.default_rng([7, dim, k, tables])
    return rng.standard_normal((dim, k * tables)), rng.random(k * tables)


def unit_vector(values) -> np.ndarray | None:
    """The vector at length 1 in double precision; None if null, empty, zero or not finite."""
    if values is None:
        return None
    x = np.asarray(values, dtype=np.float64)
    top = np.abs(x).max(initial=0.0)
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def signature(x: np.ndarray, width: float, k: int, tables: int) -> np.ndarray:
    """One 64-bit bucket name per table."""
    directions, shift = projections(len(x), k, tables)
    cells = np.floor((x @ directions) / width + shift).astype(np.int32).reshape(tables, k)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), seed=(len(x) << 32) + t) for t, row in enumerate(cells)], np.uint64)


def _linked(ids, vectors, weight, tile, table: int, crossing: bool, threshold: float, names):
    """Links of one unit of work: (ids, vectors linked here, smallest linked id) of its linked members.

    ``names`` gives the bucket names of some rows; pairs that met in an earlier table were counted there.
    """
    cosine = vectors @ vectors.T
    link = np.triu(cosine >= threshold, 1) & (ids[:, None] != ids[None, :])
    if crossing:
        link &= tile[:, None] != tile[None, :]
    a, b = np.nonzero(link)
    if len(a) and table:
        some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        own = names(vectors[some])[:, :table]
        new = ~(own[at[:len(a)]] == own[at[len(a):]]).any(axis=1)
        a, b = a[new], b[new]
    if not len(a):
        return None
    count = np.zeros(len(ids), np.int64)
    np.add.at(count, a, weight[b])
    np.add.at(count, b, weight[a])
    label = np.arange(len(ids))
    both = np.zeros((len(ids), len(ids)), dtype=bool)
    both[a, b] = both[b, a] = True
    seen = np.zeros(len(ids), dtype=bool)
    for i in np.argsort(ids).tolist():
        if not seen[i] and count[i]:
            seen[i], todo = True, [i]
            while todo:
                reached = np.flatnonzero(both[todo].any(axis=0) & ~seen)
                seen[reached], label[reached] = True, i
                todo = reached.tolist()
    hit = np.flatnonzero(count)
    return ids[hit], count[hit], ids[label[hit]]


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of equal, adjacent keys of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*[batch.column(k).to_pylist() for k in key]))
        start = 0
        for i, k in enumerate(keys):
            if last is not None and k != last:
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, start = [], i
            last = k
        held.append(batch.slice(start))
    if last is not None:
        yield pa.Table.from_batches(held)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.9, recall: float = RECALL) -> DataFrame:
    """``id_col, n_links, component_id, kept``, one row per id.

    A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing; vectors of different length never link.  Rows of equal
    id count once (the largest vector by array order); a null id links with nothing.
    ``n_links`` counts the other vectors found at the threshold or above,
    ``component_id`` is the smallest id reachable by links and ``kept`` says
    that it is the vector's own.
    """
    own = vectors.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(vector_col).alias("v"))
    width, k, tables = choose_parameters(max(2, vectors.count()), threshold, recall)
    single = own.schema["v"].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64         # a vector travels as it was given

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            units = [unit_vector(x) for x in raw]
            packed = [None if u is None else np.asarray(x, kind).tobytes() for x, u in zip(raw, units)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed, pa.binary()),
                 pa.array([None if x is None else xxhash.xxh3_128_digest(x) for x in packed], pa.binary()),
                 pa.array([None if x is None else signature(x, width, k, tables).view(np.int64).tolist()
                           for x in units], pa.list_(pa.int64()))], names=["id", "raw", "same", "names"])

    points = staged(own.mapInArrow(hashed, "id long, raw binary, same binary, names array<long>"), "points")
    usable = points.where("same IS NOT NULL AND id IS NOT NULL")
    copies = staged(usable.groupBy("same").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")), "vector-copies")
    distinct = usable.drop("same").join(copies.select("id", "weight"), "id")          # an id is in one row
    entries = distinct.select("id", F.posexplode("names").alias("t", "bucket"))
    shared = entries.groupBy("t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1") \
        .select("t", "bucket", F.ceil(F.col("n") / TILE).alias("n_tiles"))
    units = entries.join(shared, ["t", "bucket"]) \
        .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("n_tiles"))) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))) \
        .select("id", "t", "bucket", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    key = ["t", "bucket", "i", "j"]
    rows = units.join(distinct.select("id", "weight", "raw"), "id").repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def names(x: np.ndarray) -> np.ndarray:
            return np.stack([signature(row, width, k, tables) for row in x])

        for run in _runs(batches, key):
            if run.num_rows < 2:
                continue
            t, i, j = run.column("t")[0].as_py(), run.column("i")[0].as_py(), run.column("j")[0].as_py()
            vectors = [unit_vector(np.frombuffer(x, kind)) for x in run.column("raw").to_pylist()]
            found = _linked(np.asarray(run.column("id")), np.stack(vectors), np.asarray(run.column("weight")),
                            np.asarray(run.column("tile")), t, i != j, threshold, names)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["id", "n", "low"])

    links = staged(rows.mapInArrow(compare, "id long, n long, low long"), "vector-links")
    degree = links.groupBy("id").agg(F.sum("n").alias("n"))
    groups = connected_components(links.select(F.col("id").alias("u"), F.col("low").alias("v")))
    found = copies.join(degree, "id", "left").join(groups.select(F.col("node").alias("id"), "component"), "id", "left") \
        .select(F.col("same").alias("__same"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("component", "id").alias("component"))
    out = points.select("id", F.when(F.col("id").isNotNull(), F.col("same")).alias("same")) \
        .join(found, F.col("same") == F.col("__same"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
