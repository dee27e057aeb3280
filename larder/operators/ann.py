"""Approximate and certified nearest neighbours: a stored two-level index with compressed vectors.

``TwoLevelIndex.build`` cuts the catalogue of N vectors into about sqrt(N)
cells in two levels of about N^(1/4) k-means centroids each, so a vector is compared
with 2 N^(1/4) centroids instead of sqrt(N), and the driver never
holds more than N^(1/4) of them (a task that ranks a block of queries reads all sqrt(N)).  Centroids are learned on a
bounded sample (``TRAIN_ROWS`` vectors per centroid); every vector is assigned.

What a vector leaves to its cell's centroid is product-quantised: one byte for
each ``SUB`` dimensions.  A query reads the codes of its nearest cells and ranks
them; only the short list meets the original vectors for
exact cosines, in the task that holds both: it is never written or shuffled, as it grows with the catalogue.  How many cells are probed and how long that list is are measured at build time on a
sample of the catalogue for a target recall.

``query(exact=True)`` goes on where the approximate search stops: a cell whose nearest
possible member (angle to its centroid less the cell's radius) could still beat
the k-th match is searched exactly, so the answer is that of ``vectors.knn`` while
cells that cannot matter are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators import vectors as V
from larder.operators.search_index import marker_row, sorted_write, source_fingerprint
from larder.operators.util import bounded_broadcast, dealt_evenly, written
from larder.session import shared_path

TRAIN_ROWS = 64              # sample vectors for each centroid to learn
SUB = 4                      # dimensions that one byte of a code stands for
CODES = 256
CODE_ROWS = 16_384           # sample vectors that teach the codes
RECALL_SAMPLE = 2048         # queries that measure the probes; the error of their shares is left as a margin
TARGET_RECALL = 0.95
LEAST_LIST = 16              # candidates for each wanted match that get exact cosines, at least
BAR_PROBES, BAR_LIST = 4, 8  # cells and candidates that set the bar of a certified search
EXACT_PAIRS = 1_000_000_000  # comparisons up to which an index is not worth building
BLOCK_ROWS = 20_000          # vectors of a cell, or queries of a cell, in one task
TILE_BYTES = 64 << 20        # original vectors of a tile, as doubles
PIECE = 1024                 # codes that are written out at once, and queries that meet them
SAMPLE_RANK = 16             # place in a sample of the codes that stands for the last place of the short list
PACKED = "cell int, ids binary, code binary, vectors binary, centroid array<double>"
PROBES = "_id long, coarse array<int>, wanted binary, vector binary"
CELL_LISTS = "_id long, coarse int, cells array<int>"
NO_CELLS = pd.DataFrame({"_id": [], "coarse": [], "cells": []}).astype({"_id": "int64", "coarse": "int32", "cells": "object"})
SLACK = 1e-5                 # cosine by which a cell's bound is widened before the cell is left out
BOOK = "parent int, child int, centroid array<double>"
META = "n long, dim int, coarse_probes int, probes int, short_list int"
LEAST_NORM = 0.1             # shorter vectors: cosine and similarity may differ, their cell is never left out


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at length one; zero rows stay."""
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid (Euclidean; the first on a tie) of each row."""
    half = 0.5 * (centroids * centroids).sum(axis=1)
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        out[i:i + 4096] = (x[i:i + 4096] @ centroids.T - half).argmax(axis=1)
    return out


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Up to ``k`` centroids by Lloyd's rounds; fewer if there are fewer distinct rows."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x
    centroids = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        cell = nearest(x, centroids)
        size = np.bincount(cell, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, cell, x)
        full = size > 0
        centroids[full] = total[full] / size[full, None]
        if not full.all():                       # an empty cell starts again at the row that fits worst
            worst = np.argsort(((x - centroids[cell]) ** 2).sum(axis=1))[::-1]
            centroids[~full] = x[worst[:int((~full).sum())]]
    return centroids


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _train(sample: DataFrame, k: int, seed: int) -> DataFrame:
    """``parent, child, centroid``: k-means of each parent's sample, one parent in a task."""
    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("_id")
        found = kmeans(_stack(rows["_u"]), k, seed + int(key[0]))
        return pd.DataFrame({"parent": int(key[0]), "child": np.arange(len(found)), "centroid": list(found)})
    return sample.groupBy("parent").applyInPandas(fit, BOOK)


def _hash_share(col: str, share) -> Column:
    unit_ = F.pmod(F.xxhash64(F.col(col), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return unit_ < share


def _meet(left: DataFrame, right: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(fn, schema)


def _encode(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    """One byte per sub-space (rows x m)."""
    m, _, width = books.shape
    padded = np.zeros((len(residual), m * width))
    padded[:, :residual.shape[1]] = residual
    return np.stack([nearest(padded[:, j * width:(j + 1) * width], books[j]) for j in range(m)], axis=1).astype(np.uint8)


class TwoLevelIndex:
    """Stored tables below ``path``: ``coarse``, ``cells``, ``codes``, ``vectors``, ``books``, ``meta``."""

    def __init__(self, spark: SparkSession, path: str, meta):
        self.spark, self.path = spark, path
        self.cells = spark.read.schema("coarse int, cell int, centroid array<double>, n long, radius double") \
            .parquet(f"{path}/cells")
        self.codes = spark.read.schema("cell int, _id long, code binary").parquet(f"{path}/codes")
        self.vectors = spark.read.schema("cell int, _id long, _v array<double>, norm double, code binary").parquet(f"{path}/vectors")
        self.dim, self.n, self.short_list = meta["dim"], meta["n"], meta["short_list"]
        self.coarse_probes, self.probes = meta["coarse_probes"], meta["probes"]
        coarse = sorted(spark.read.schema("child int, centroid array<double>, radius double")
                        .parquet(f"{path}/coarse").collect(), key=lambda r: r["child"])           # N^(1/4) rows
        loads = {r["coarse"]: r["load"] for r in self.cells.groupBy("coarse").agg(F.sum("n").alias("load")).collect()}
        self.coarse = np.array([r["centroid"] for r in coarse]).reshape(len(coarse), self.dim)
        self.coarse_ids = np.array([r["child"] for r in coarse], np.int64)
        self.coarse_radius = np.array([r["radius"] for r in coarse])
        self.coarse_loads = np.array([loads.get(r["child"], 0) for r in coarse], np.int64)
        books = spark.read.schema(BOOK).parquet(f"{path}/books").collect()                          # m x 256 short vectors
        m = max((r["parent"] for r in books), default=-1) + 1
        self.books = np.full((m, CODES, SUB), np.inf)
        for r in books:
            self.books[r["parent"], r["child"]] = r["centroid"]

    # ------------------------------------------------------------- building

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "TwoLevelIndex | None":
        """The index that ``build`` completed below ``path``; None if there is none."""
        meta = marker_row(spark, f"{path}/meta", META)
        return cls(spark, path, meta) if meta else None

    @classmethod
    def build(cls, catalogue: DataFrame, path: str, item_id: str = "item_id", vec: str = "embedding", seed: int = 42,
              branch: int | None = None, target_recall: float = TARGET_RECALL) -> "TwoLevelIndex":
        """Learn the cells and codes, assign every vector that is not null, measure the probes; ``meta`` is written last."""
        spark = catalogue.sparkSession
        raw = written(catalogue.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(
            F.col(item_id).cast("long").alias("_id"), F.col(vec).cast("array<double>").alias("_v")), "ann-vectors")
        size = raw.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("dim")).first()
        n, dim = size["n"], size["dim"] or 1
        branch = branch or max(1, math.ceil(n ** 0.25))
        units = raw.withColumn("_u", V.l2_normalize(F.col("_v"), as_float=False))

        # first level: one task learns N^(1/4) centroids from a bounded sample
        share = min(1.0, TRAIN_ROWS * branch / max(n, 1))
        first = written(_train(units.where(_hash_share("_id", share)).select(F.lit(0).alias("parent"), "_id", "_u"),
                               branch, seed), "ann-coarse")
        rows = first.orderBy("child").collect()                                       # N^(1/4) rows
        top = np.array([r["centroid"] for r in rows]).reshape(len(rows), dim)
        assigned = written(units.mapInPandas(_assign_top(top), "_id long, _v array<double>, _u array<double>, coarse int, angle double")
                           if len(rows) else units.withColumn("coarse", F.lit(0)).withColumn("angle", F.lit(0.0)), "ann-assigned")
        loads = written(assigned.groupBy("coarse").agg(F.count(F.lit(1)).alias("load"), F.max("angle").alias("radius")), "ann-loads")

        # second level: each coarse cell's own sample, one task each
        picked = assigned.join(F.broadcast(loads), "coarse") \
            .where(_hash_share("_id", F.lit(float(TRAIN_ROWS * branch)) / F.col("load"))) \
            .select(F.col("coarse").alias("parent"), "_id", "_u")
        second = written(_train(picked, branch, seed + 1).select(
            F.col("parent").alias("coarse"), (F.col("parent") * branch + F.col("child")).alias("cell"), "centroid"), "ann-cells")

        # codes: residuals of a bounded sample, one task for each sub-space
        teach = written(cls._placed(assigned.where(_hash_share("_id", min(1.0, CODE_ROWS / max(n, 1)))), second, loads),
                        "ann-residuals")
        m = -(-dim // SUB)
        parts = teach.select("_id", F.posexplode(F.array(*[
            F.concat(F.slice("rest", j * SUB + 1, SUB), F.array_repeat(F.lit(0.0), max(0, (j + 1) * SUB - dim)))
            for j in range(m)])).alias("parent", "_u"))
        _train(parts, CODES, seed + 2).write.mode("overwrite").parquet(f"{path}/books")
        found = spark.read.parquet(f"{path}/books").collect()
        books = np.full((m, CODES, SUB), np.inf)
        for r in found:
            books[r["parent"], r["child"]] = r["centroid"]
        books[~np.isfinite(books).all(axis=2)] = 1e150                                # codes that were not needed

        placed = written(cls._placed(assigned, second, loads, books), "ann-placed")
        sorted_write(placed.select("cell", "_id", "code"), f"{path}/codes", ["cell", "_id"])
        sorted_write(placed.select("cell", "_id", "_v", V.norm("_v").alias("norm"), "code"), f"{path}/vectors", ["cell", "_id"])
        spread = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
        second.join(spread, "cell").select("coarse", "cell", "centroid", "n", "radius").write.mode("overwrite").parquet(f"{path}/cells")
        first.join(loads, first["child"] == loads["coarse"]).select("child", "centroid", "radius") \
            .write.mode("overwrite").parquet(f"{path}/coarse")

        def note(coarse_probes: int, probes: int, short_list: int) -> "TwoLevelIndex":
            meta = spark.createDataFrame([(n, dim, coarse_probes, probes, short_list)], META)
            meta.write.mode("overwrite").parquet(f"{path}/meta")
            return cls(spark, path, meta.first())
        index = note(len(rows) or 1, max(1, n), LEAST_LIST)
        # coarse cells, cells and codes may each miss a third of what the target leaves
        return note(*index._measured(raw, n, 1 - (1 - target_recall) / 3)) if n > 1 else index

    @classmethod
    def stored(cls, catalogue: DataFrame, source: str, root: str, rebuild: bool = False, **options) -> "TwoLevelIndex":
        """The index of a source below ``root``, built if it is not there, the source's files changed or ``rebuild``."""
        path = f"{root.rstrip('/')}/ann-coded-{source_fingerprint(catalogue.sparkSession, source)}"
        return (None if rebuild else cls.open(catalogue.sparkSession, path)) or cls.build(catalogue, path, **options)

    @staticmethod
    def _placed(assigned: DataFrame, cells: DataFrame, loads: DataFrame, books: np.ndarray | None = None) -> DataFrame:
        """Vectors with their cell: a coarse cell's vectors, cut into salts, meet its centroids."""
        salts = loads.select("coarse", F.ceil(F.col("load") / BLOCK_ROWS).cast("int").alias("salts"))
        left = assigned.join(F.broadcast(salts), "coarse") \
            .select("coarse", F.pmod(F.xxhash64("_id"), "salts").cast("int").alias("salt"), "_id", "_v", "_u")
        right = cells.join(salts, "coarse").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))) \
            .select("coarse", "salt", "cell", "centroid")

        def place(items: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if items.empty or own.empty:
                return pd.DataFrame({c: [] for c in ("cell", "_id", "_v", "rest", "code", "angle")}).astype(
                    {"cell": "int32", "_id": "int64", "angle": "float64"})
            own = own.sort_values("cell")
            centroids, x = _stack(own["centroid"]), _stack(items["_u"])
            at = nearest(x, centroids)
            rest = x - centroids[at]
            angle = np.arccos(np.clip((x * unit(centroids)[at]).sum(axis=1), -1, 1))
            # the length decides whether a cosine bounds the similarity
            angle[np.linalg.norm(_stack(items["_v"]), axis=1) < LEAST_NORM] = math.pi
            code = [None] * len(x) if books is None else [c.tobytes() for c in _encode(rest, books)]
            return pd.DataFrame({"cell": own["cell"].to_numpy()[at], "_id": items["_id"], "_v": items["_v"],
                                 "rest": list(rest) if books is None else None, "code": code, "angle": angle})
        return _meet(left, right, ["coarse", "salt"], place,
                     "cell int, _id long, _v array<double>, rest array<double>, code binary, angle double")

    def _measured(self, raw: DataFrame, n: int, target: float) -> tuple[int, int, int]:
        """(coarse cells, cells, short list): the place of the true neighbour's cells and code, at the target share of a sample.

        What a share of the sample may be off by (two standard errors, none if the sample is the whole catalogue) is added to the target.
        """
        share = min(1.0, 2 * RECALL_SAMPLE / n)
        sample = written(raw.where(_hash_share("_id", share)).orderBy(F.xxhash64("_id", F.lit(17)), "_id").limit(RECALL_SAMPLE), "ann-sample")
        best = V.knn(sample, raw, k=1, query_id="_id", item_id="_id", vec="_v", exclude_same_id=True)
        home = self.codes.join(self.cells.select("cell", "coarse", "centroid"), "cell")
        true = best.select("query_id", F.col("item_id").alias("_id")).join(home, "_id").dropDuplicates(["query_id"])
        true = written(true.drop("_id").withColumnRenamed("query_id", "_id"), "ann-true")
        asked, size = self._queries(sample, "_id", "_v").join(true, "_id"), true.count()
        miss = 1 - target
        target = 1 - max(miss - 2 * math.sqrt(miss / max(size, 1) * max(0.0, 1 - size / n)), miss / 8)

        def at(places: DataFrame) -> int:
            return max(1, math.ceil(places.agg(F.percentile("place", target)).first()[0] or 1))
        coarse = at(self._home_places(asked, size))
        fine = at(self._home_places(asked, size, coarse))
        near = written(self._nearest_cells(asked, size, coarse, fine), "ann-probes")
        bars = written(asked.select("_id", "_u", "centroid", "code").mapInPandas(_code_score(self.books), "_id long, bar float"), "ann-bars")
        places = self._on_codes(near.join(bars, "_id"), *self._code_grid(size), self.codes.withColumn("_v", F.lit(None).cast("array<double>")),
                                _better(self.books, self.dim), "_id long, n long")
        return coarse, fine, max(LEAST_LIST, at(places.groupBy("_id").agg(F.sum("n").alias("place"))))

    def _home_places(self, asked: DataFrame, n: int, coarse_probes: int | None = None) -> DataFrame:
        """``_id, place`` of each query's own ``coarse`` cell, or with ``coarse_probes`` of its ``cell`` in so many coarse cells."""
        top, ids = self.coarse, self.coarse_ids
        half = 0.5 * (top * top).sum(axis=1)

        def place(score: np.ndarray, at: np.ndarray) -> np.ndarray:
            own = np.take_along_axis(score, at[:, None], axis=1)
            return 1 + ((score > own) | (score == own) & (np.arange(score.shape[1]) < at[:, None])).sum(axis=1)

        def rank(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out, cells = [pd.DataFrame({"_id": np.zeros(0, np.int64), "place": np.zeros(0, np.int64)})], _Cells(own)
            for part in _chunks(queries if len(cells.ids) else queries[:0]):
                x = _stack(part["_u"])
                score, at = x @ top.T - half, np.searchsorted(ids, part["coarse"].to_numpy())
                if coarse_probes is not None:
                    order = np.argsort(-score, axis=1, kind="stable")[:, :coarse_probes]
                    near = np.zeros(score.shape, bool)
                    np.put_along_axis(near, order, True, axis=1)
                    there = near[np.arange(len(x)), at]
                    part, x, near = part[there], x[there], near[there][:, np.searchsorted(ids, cells.coarse)]
                    score = np.where(near, x @ cells.centroids.T - 0.5 * (cells.centroids ** 2).sum(axis=1), -np.inf)
                    score, at = np.round(score, 12), np.searchsorted(cells.ids, part["cell"].to_numpy())
                out.append(pd.DataFrame({"_id": part["_id"].to_numpy(), "place": place(score, at)}))
            return pd.concat(out)
        return self._by_block(asked.select("_id", "_u", "coarse", "cell"), n, rank, "_id long, place long")

    # ------------------------------------------------------------- querying

    def _queries(self, queries: DataFrame, query_id: str, vec: str) -> DataFrame:
        """One row for each query id with a vector of the index's length; the unit vector beside the given one."""
        q = queries.where(F.size(vec) == self.dim).select(F.col(query_id).cast("long").alias("_id"),
                                                          F.col(vec).cast("array<double>").alias("_v"))
        q = q.groupBy("_id").agg(F.max("_v").alias("_v")).withColumn("norm", V.norm("_v"))
        return written(q.withColumn("_u", V.l2_normalize(F.col("_v"), as_float=False)), "ann-queries")

    # Queries meet whole tiles, not cells: a tile is a run of neighbouring coarse cells of up to ``rows_fit``
    # vectors (a larger one is cut by a hash), a block a share of the queries.  A query is shuffled once for each
    # tile that holds a cell of its own, with the list of these cells, a vector once for each block.

    def _tiles(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(first tile, tiles) of each coarse cell."""
        first, parts, at, held = [], [], -1, rows
        for load in self.coarse_loads.tolist():
            cut = max(1, math.ceil(load / rows))
            if held + load > rows or cut > 1:
                at, held = at + 1, 0
            first.append(at)
            parts.append(cut)
            held = held + load if cut == 1 else rows
            at += cut - 1
        return np.array(first, np.int64), np.array(parts, np.int64)

    def _by_block(self, q: DataFrame, n: int, fn, schema: str) -> DataFrame:
        """Blocks of queries meet the centroids of all cells (N^(1/2) rows)."""
        blocks = V.block_grid(n, n, self.spark.sparkContext.defaultParallelism, BLOCK_ROWS)[0]
        left = dealt_evenly(q, F.pmod(F.xxhash64("_id"), F.lit(blocks)), blocks)
        right = dealt_evenly(self.cells.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), F.col("block"), blocks)
        return _meet(left, right.drop("block"), ["slot"], fn, schema)

    def _nearest_cells(self, q: DataFrame, n: int, coarse_probes: int, probes: int) -> DataFrame:
        """Each query's nearest ``probes`` cells of its nearest coarse cells: a bit for each cell, and their coarse cells."""
        top, ids = self.coarse, self.coarse_ids
        half = 0.5 * (top * top).sum(axis=1)

        def rank(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out, cells = [pd.DataFrame({"_id": np.zeros(0, np.int64), "coarse": [], "wanted": [], "vector": []})], _Cells(own)
            first = np.flatnonzero(np.diff(cells.coarse, prepend=-1))
            for part in _chunks(queries if len(cells.ids) else queries[:0]):
                x = _stack(part["_u"])
                near = np.zeros((len(x), len(ids)), bool)
                order = np.argsort(half - x @ top.T, axis=1, kind="stable")[:, :coarse_probes]
                np.put_along_axis(near, order, True, axis=1)
                near = near[:, np.searchsorted(ids, cells.coarse)]
                score = np.where(near, x @ cells.centroids.T - 0.5 * (cells.centroids ** 2).sum(axis=1), -np.inf)
                chosen = _first_places(np.round(score, 12), probes) & near
                row, at = np.nonzero(np.logical_or.reduceat(chosen, first, axis=1))
                bits = np.zeros((len(x), cells.ids[-1] + 1), bool)
                bits[:, cells.ids] = chosen
                out.append(pd.DataFrame({
                    "_id": part["_id"].to_numpy(), "wanted": [b.tobytes() for b in np.packbits(bits, axis=1)],
                    "coarse": np.split(cells.coarse[first][at].astype(np.int32), np.searchsorted(row, np.arange(1, len(x)))),
                    "vector": [v.tobytes() for v in _narrow(_stack(part["_v"]))]}))
            return pd.concat(out)
        return self._by_block(q.select("_id", "_u", "_v"), n, rank, PROBES)

    def _on_tiles(self, q: DataFrame, n: int, lists: DataFrame, items: DataFrame, fn, schema: str) -> DataFrame:
        """Queries with ``lists(_id, coarse, ...)`` (arrays) meet the rows of their tiles; ``fn`` gets both sides of a tile."""
        blocks, tiles = V.block_grid(n, self.n, self.spark.sparkContext.defaultParallelism, max(1, TILE_BYTES // (8 * self.dim)))
        first, parts = self._tiles(math.ceil(self.n / tiles))
        where = F.broadcast(self.spark.createDataFrame(
            list(zip(self.coarse_ids.tolist(), first.tolist(), parts.tolist())), "coarse int, first int, parts int"))
        block = F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")
        asked = [c for c in lists.columns if c not in ("_id", "coarse")]
        left = lists.join(where, "coarse").groupBy("_id", "first", "parts").agg(
            *[F.flatten(F.collect_list(c)).alias(c) for c in asked]).join(q, "_id") \
            .withColumn("tile", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1))) \
            .withColumn("block", block).drop("first", "parts")
        cells = bounded_broadcast(self.cells.select("cell", "coarse").join(where, "coarse"))
        right = items.join(cells.drop("coarse"), "cell") \
            .withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("_id", F.lit(1)), "parts")).cast("int")) \
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("first", "parts")
        groups = int((first + parts).max()) * blocks
        left, right = (dealt_evenly(df, F.col("tile") * blocks + F.col("block"), groups).drop("tile", "block") for df in (left, right))
        return _meet(left, right, ["slot"], fn, schema)

    def _code_grid(self, n: int) -> tuple[int, int]:
        """Blocks and tiles where only codes are read: they are short, so tiles are larger."""
        fit = max(1, TILE_BYTES // (8 * self.dim))
        blocks, tiles = V.block_grid(n, self.n, self.spark.sparkContext.defaultParallelism, fit)
        few = max(1, math.ceil(self.n / max(1, TILE_BYTES // (2 * (len(self.books) + 16)))))
        return max(math.ceil(n / fit), math.ceil(blocks * tiles / few)), few

    def _on_codes(self, near: DataFrame, blocks: int, tiles: int, items: DataFrame, fn, schema: str) -> DataFrame:
        """Queries of ``_nearest_cells`` meet the coded rows of their tiles, packed by cell, and the cells' centroids."""
        first, parts = self._tiles(math.ceil(self.n / tiles))
        where = F.broadcast(self.spark.createDataFrame(
            list(zip(self.coarse_ids.tolist(), first.tolist(), parts.tolist())), "coarse int, first int, parts int"))
        cells = self.cells.join(where, "coarse")
        cut = items.join(bounded_broadcast(cells.select("cell", "first", "parts")), "cell") \
            .withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("_id", F.lit(1)), "parts")).cast("int")).drop("first", "parts")
        heads = cells.select("cell", *[F.lit(None).cast("binary").alias(c) for c in ("ids", "code", "vectors")], "centroid",
                             F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("tile"))
        right = cut.mapInPandas(_pack, f"{PACKED}, tile int").unionByName(heads) \
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        span = {c: list(range(f, f + p)) for c, f, p in zip(self.coarse_ids.tolist(), first.tolist(), parts.tolist())}
        spans = F.array(*[F.array(*map(F.lit, span.get(c, []))).cast("array<int>") for c in range(max(span) + 1)])
        left = near.withColumn("tile", F.explode(F.array_distinct(F.flatten(F.transform("coarse", lambda c: spans[c]))))) \
            .withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int")).drop("coarse")
        groups = int((first + parts).max()) * blocks
        left, right = (dealt_evenly(df, F.col("tile") * blocks + F.col("block"), groups).drop("tile", "block") for df in (left, right))
        return _meet(left, right, ["slot"], fn, schema)

    def _short_listed(self, q: DataFrame, n: int, near: DataFrame, keep: int, k: int, exclude_same_id: bool) -> DataFrame:
        """The best ``k`` by exact cosine of the ``keep`` codes (and a few more) that fit each query best in its cells.

        A sample of the codes gives a score that ``keep`` codes should reach; where a tile has both codes and vectors,
        the codes that reach it are the short list, and what is left of it is ``k`` rows and its length.  Queries
        whose list is too short are searched again with a lower score.
        """
        codes = self.codes.withColumn("_v", F.lit(None).cast("array<double>"))
        grid = V.block_grid(n, self.n, self.spark.sparkContext.defaultParallelism, max(1, TILE_BYTES // (8 * self.dim)))
        done, wider = [], 1
        while True:
            bars = self._on_codes(near, *self._code_grid(n), codes, _bars(self.books, self.dim, keep, wider, exclude_same_id),
                                  "_id long, bar float")
            bars = written(bars.groupBy("_id").agg(F.max("bar").alias("bar")), "ann-list-bars")
            listed = written(self._on_codes(near.join(bars, "_id"), *grid, self.vectors.drop("norm"),
                                            _listed_cosines(self.books, self.dim, k, exclude_same_id),
                                            "query_id long, item_id long, cell int, sim double, n long"), "ann-listed")
            long = listed.groupBy(F.col("query_id").alias("_id")).agg(F.sum("n").alias("n"))
            short = written(bars.where(F.col("bar") > F.lit(float("-inf"))).join(long, "_id", "left")
                            .where(F.coalesce("n", F.lit(0)) < keep).select("_id"), "ann-short")
            left = short.count()
            done.append(listed.join(short, listed["query_id"] == short["_id"], "left_anti") if left else listed)
            if not left:
                break
            near, n, wider = near.join(short, "_id", "left_semi"), left, 2 * wider
        found = done[0]
        for more in done[1:]:
            found = found.unionByName(more)
        return written(V._merge_topk(found.where(F.col("item_id").isNotNull()).drop("n"), k), "ann-found")

    def query(self, queries: DataFrame, k: int = 1, query_id: str = "query_id", vec: str = "embedding",
              exclude_same_id: bool = False, exact: bool = False, probes: int | None = None,
              short_list: int | None = None) -> DataFrame:
        """Top-k cosine neighbours ``query_id, item_id, sim, rank``; ties go to the smaller ``item_id``.

        A null vector, or one of another length, matches nothing; of several
        rows with one query id the largest vector is searched.  ``exact`` gives the rows of ``vectors.knn``.
        """
        q = self._queries(queries, query_id, vec)
        if not self.n:
            return self.spark.createDataFrame([], "query_id long, item_id long, sim double, rank int")
        n = q.count()
        if exact:                    # any good match will do here: what it leaves open is searched in full
            probes, short_list = probes or min(BAR_PROBES, self.probes), short_list or BAR_LIST * k
        coarse = min(self.coarse_probes if probes is None else probes, len(self.coarse))
        near = written(self._nearest_cells(q, n, coarse, probes or self.probes), "ann-probes")
        found = self._short_listed(q, n, near, short_list or self.short_list * k, k, exclude_same_id)
        if not exact:
            return found.drop("cell")
        more = written(self._could_matter(q, found, k), "ann-more")
        rest = self._on_tiles(q.select("_id", "_v"), n, more, self.vectors.drop("norm", "code"), _in_full(k, exclude_same_id),
                              "_id long, item_id long, cell int, sim double")
        w = Window.partitionBy("_id").orderBy(F.round("sim", 12).desc(), "item_id")
        rest = rest.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("_id", "item_id", "cell")
        first = found.select(F.col("query_id").alias("_id"), "item_id", "cell")
        return self._exact_cosines(q, n, first.unionByName(rest).distinct(), k).drop("cell")

    def _exact_cosines(self, q: DataFrame, n: int, pairs: DataFrame, k: int) -> DataFrame:
        """``_id, item_id, cell`` with the similarity of the original vectors, the best ``k`` of each query."""
        coarse = bounded_broadcast(self.cells.select("cell", "coarse"))
        lists = pairs.join(coarse, "cell").groupBy("_id", "coarse").agg(
            F.collect_list("item_id").alias("items"), F.collect_list("cell").alias("cells"))
        scored = self._on_tiles(q.select("_id", "_v", "norm"), n, lists, self.vectors.drop("code"), _scored(k),
                                "query_id long, item_id long, cell int, sim double")
        return V._merge_topk(scored, k)

    def _could_matter(self, q: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """``_id, coarse, cells``: the cells whose nearest possible member could beat or tie a query's k-th match.

        Cells that were probed are among them: their codes ranked the members, their bound did not.
        """
        kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("sim").alias("_bar"))
        bars = q.join(kth, "_id", "left").withColumn(
            "_bar", F.when(F.col("norm") < LEAST_NORM, -2.0).otherwise(F.coalesce("_bar", F.lit(-2.0))))
        bars = written(bars.select("_id", "_u", "_bar"), "ann-bars")
        top, radius, ids = unit(self.coarse), self.coarse_radius, self.coarse_ids

        def reach(x: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
            angle = np.arccos(np.clip(x @ c.T, -1, 1)) - r - 1e-6
            return np.cos(np.maximum(angle, 0)) + SLACK

        def matter(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out, cells = [NO_CELLS], _Cells(own)
            directions = unit(cells.centroids)
            for part in _chunks(queries if len(cells.ids) else queries[:0]):
                x, bar = _stack(part["_u"]), part["_bar"].to_numpy()[:, None]
                near = (reach(x, top, radius) >= bar)[:, np.searchsorted(ids, cells.coarse)]
                out.append(cells.lists(part["_id"].to_numpy(), near & (reach(x, directions, cells.radius) >= bar)))
            return pd.concat(out)
        return self._by_block(bars, bars.count(), matter, CELL_LISTS)


class _Cells:
    """The cells of an index in one task, by number."""

    def __init__(self, own: pd.DataFrame):
        own = own.sort_values("cell")
        self.ids, self.coarse = own["cell"].to_numpy(np.int64), own["coarse"].to_numpy(np.int64)
        self.radius = own["radius"].to_numpy(np.float64)
        self.centroids = _stack(own["centroid"]) if len(own) else np.zeros((0, 0))

    def lists(self, ids: np.ndarray, chosen: np.ndarray) -> pd.DataFrame:
        """One row for each query and coarse cell with a chosen cell; cells of a coarse cell are neighbours."""
        row, at = np.divmod(np.flatnonzero(chosen), chosen.shape[1])
        group = np.flatnonzero(np.diff(row * (self.coarse.max(initial=0) + 1) + self.coarse[at], prepend=-1))
        cells = self.ids[at].astype(np.int32)
        return pd.DataFrame({"_id": ids[row[group]], "coarse": self.coarse[at[group]].astype(np.int32),
                             "cells": np.split(cells, group[1:]) if len(group) else []})


def _chunks(rows: pd.DataFrame, size: int = 1024):
    for i in range(0, len(rows), size):
        yield rows.iloc[i:i + size]


def _wanted(queries: pd.DataFrame, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query x cell, cell of each row) of a tile whose rows have these sorted cells."""
    own, at = np.unique(cells, return_inverse=True)
    lists = queries["cells"].to_list()
    flat = np.concatenate(lists)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    there = own[place] == flat
    out = np.zeros((len(lists), len(own)), bool)
    out[row[there], place[there]] = True
    return out, at


def _listed(qids: np.ndarray, s: np.ndarray, i: np.ndarray, ids: np.ndarray, cells: np.ndarray, names: list[str]) -> pd.DataFrame:
    """What ``top_matches`` found, as rows."""
    row, at = np.nonzero(np.isfinite(s))
    place = i[row, at]
    return pd.DataFrame(dict(zip(names, (qids[row], ids[place], cells[place].astype(np.int32), s[row, at]))))


def _nothing(names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: [] for c in names}).astype(dict(zip(names, ("int64", "int64", "int32", "float64"))))


def _in_full(k: int, exclude_same_id: bool):
    """The ``k`` best of a tile's vectors for each query, in the cells that could matter to it."""
    names = ["_id", "item_id", "cell", "sim"]

    def fn(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or items.empty:
            return _nothing(names)
        items = items.sort_values(["cell", "_id"])
        qids, cells, ids = queries["_id"].to_numpy(), items["cell"].to_numpy(), items["_id"].to_numpy()
        s, i = V.top_cosines(qids, _stack(queries["_v"]), ids, _stack(items["_v"]), k, exclude_same_id,
                             digits=12, wanted=_wanted(queries, cells))
        return _listed(qids, s, i, ids, cells, names)
    return fn


def _scored(k: int):
    """The best ``k`` of the listed items of each query by their cosine, summed left to right as ``vectors.cosine``."""
    names = ["query_id", "item_id", "cell", "sim"]

    def fn(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = [_nothing(names)]
        if queries.empty or items.empty:
            return out[0]
        items = items.sort_values(["cell", "_id"])
        ids, cells, norms = items["_id"].to_numpy(), items["cell"].to_numpy(), items["norm"].to_numpy()
        vectors, own = _stack(items["_v"]), np.unique(ids)
        key = cells.astype(np.int64) * len(own) + np.searchsorted(own, ids)
        for part in _chunks(queries, 512):
            lists = part["items"].to_list()
            item = np.concatenate(lists)
            place = np.minimum(np.searchsorted(own, item), len(own) - 1)
            asked = np.concatenate(part["cells"].to_list()).astype(np.int64) * len(own) + place
            at, n = V._runs(key, np.where(own[place] == item, asked, -1))       # a cut cell's items lie in several tiles
            row = np.repeat(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), n)
            x, total = _stack(part["_v"]), np.zeros(len(at))
            for d in range(x.shape[1]):
                total += x[row, d] * vectors[at, d]
            sim = total / (part["norm"].to_numpy()[row] * norms[at] + V.EPS)
            order = np.lexsort((ids[at], -sim, row))
            row, at, sim = row[order], at[order], sim[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pd.DataFrame({"query_id": part["_id"].to_numpy()[row[kept]], "item_id": ids[at[kept]],
                                     "cell": cells[at[kept]].astype(np.int32), "sim": sim[kept]}))
        return pd.concat(out)
    return fn


def best_matches(queries: DataFrame, catalogue: DataFrame, k: int = 1, query_id: str = "query_id",
                 item_id: str = "item_id", vec: str = "embedding", exclude_same_id: bool = False,
                 pairs: int = EXACT_PAIRS) -> DataFrame:
    """The rows of ``vectors.knn``: block by block up to ``pairs`` comparisons, by a certified index search beyond.

    Both ways give the same matches; only what is worth an index gets one.
    """
    if queries.count() * catalogue.count() <= pairs:
        return V.knn(queries, catalogue, k, query_id, item_id, vec, exclude_same_id)
    index = TwoLevelIndex.build(catalogue, shared_path(catalogue.sparkSession, "ann-index"), item_id, vec)
    return index.query(queries, k, query_id, vec, exclude_same_id, exact=True)


def _assign_top(centroids: np.ndarray):
    """Nearest coarse centroid and the angle to it; a short vector's angle counts as half a turn."""
    directions = unit(centroids)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf["_u"])
                at = nearest(x, centroids)
                angle = np.arccos(np.clip((x * directions[at]).sum(axis=1), -1, 1))
                angle[np.linalg.norm(_stack(pdf["_v"]), axis=1) < LEAST_NORM] = math.pi
                yield pdf.assign(coarse=at.astype(np.int32), angle=angle)
    return run


def _first_places(score: np.ndarray, n: int) -> np.ndarray:
    """Which are the ``n`` largest of each row; of equal ones the first."""
    if n >= score.shape[1]:
        return np.ones(score.shape, bool)
    bar = np.partition(score, -n, axis=1)[:, -n][:, None]
    over, same = score > bar, score == bar
    return over | same & (same.cumsum(axis=1) <= n - over.sum(axis=1, keepdims=True))


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """The same values in single precision, if they fit."""
    with np.errstate(over="ignore", invalid="ignore"):
        single = vectors.astype(np.float32)
    return single if np.array_equal(single, vectors, equal_nan=True) else vectors


def _wide(blobs: list, counts: np.ndarray, dim: int) -> np.ndarray:
    """The vectors of ``_narrow``, as doubles; a blob has ``counts`` of them."""
    kinds = [np.float32 if len(b) == 4 * dim * c else np.float64 for b, c in zip(blobs, counts.tolist())]
    if len(set(kinds)) == 1:
        return np.frombuffer(b"".join(blobs), kinds[0]).reshape(-1, dim).astype(np.float64)
    return np.concatenate([np.zeros((0, dim)), *[np.frombuffer(b, t).reshape(-1, dim) for b, t in zip(blobs, kinds)]])


def _pack(batches):
    """Rows of a cell and tile that follow each other as one row."""
    for pdf in batches:
        if len(pdf):
            cell, tile = pdf["cell"].to_numpy(), pdf["tile"].to_numpy()
            order = np.lexsort((cell, tile))
            pdf, cell, tile = pdf.iloc[order], cell[order], tile[order]
            ids, code = pdf["_id"].to_numpy(np.int64), pdf["code"].to_numpy()
            vectors = None if pdf["_v"].iloc[0] is None else _narrow(_stack(pdf["_v"]))
            first = np.flatnonzero(np.diff(cell, prepend=-1) | np.diff(tile, prepend=-1))
            runs = [slice(a, b) for a, b in zip(first, [*first[1:], len(cell)])]
            yield pd.DataFrame({"cell": cell[first], "ids": [ids[r].tobytes() for r in runs], "code": [b"".join(code[r]) for r in runs],
                                "vectors": [None if vectors is None else vectors[r].tobytes() for r in runs],
                                "centroid": None, "tile": tile[first]})


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors in single precision, lengths, which have numbers only)."""
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.linalg.norm(vectors, axis=1)
        out = np.divide(vectors, length[:, None], out=np.zeros_like(vectors), where=length[:, None] != 0)
    usable = np.isfinite(out).all(axis=1)
    out[~usable] = 0
    return out.astype(np.float32), length, usable


class _Coded:
    """The coded rows of a tile by cell and id; ``cells`` are those that have rows."""

    def __init__(self, books: np.ndarray, dim: int, items: pd.DataFrame):
        heads, rows = items[items["ids"].isna()].sort_values("cell"), items[items["ids"].notna()]
        blobs, m = rows["ids"].to_list(), len(books)
        counts = np.array([len(b) // 8 for b in blobs], np.int64)
        cell, ids = np.repeat(rows["cell"].to_numpy(np.int64), counts), np.frombuffer(b"".join(blobs), np.int64)
        order = np.lexsort((ids, cell))
        self.books, self.dim, self.cell, self.ids = np.where(np.isfinite(books), books, 0.0).astype(np.float32), dim, cell[order], ids[order]
        self.code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(ids), m)[order]
        self.cells, self.first, self.sizes = np.unique(self.cell, return_index=True, return_counts=True)
        heads = heads[np.isin(heads["cell"].to_numpy(np.int64), self.cells)]
        self.centroids = _stack(heads["centroid"]).astype(np.float32) if len(heads) else np.zeros((0, dim), np.float32)
        if len(rows) and rows["vectors"].iloc[0] is not None:
            self.vectors = _wide(rows["vectors"].to_list(), counts, dim)[order]

    def meant(self, places) -> np.ndarray:
        """What the codes at some places stand for: their centroid and one short vector for each byte."""
        code = self.code[places]
        out = self.books[np.arange(len(self.books)), code].reshape(len(code), -1)[:, :self.dim]
        return out + self.centroids[np.searchsorted(self.cells, self.cell[places])]

    def pieces(self):
        """(number of the cell, places) of at most ``PIECE`` rows."""
        for j, (a, n) in enumerate(zip(self.first.tolist(), self.sizes.tolist())):
            for i in range(a, a + n, PIECE):
                yield j, slice(i, min(a + n, i + PIECE))

    def reaching(self, x: np.ndarray, near: np.ndarray, bar: np.ndarray):
        """(rows, places) whose scores reach the rows' bars, piece by piece; ``near`` is cells x rows."""
        for j, places in self.pieces():
            rows = np.flatnonzero(near[j])
            if not len(rows):
                continue
            meant = self.meant(places)
            for i in range(0, len(rows), PIECE):
                part = rows[i:i + PIECE]
                row, at = np.divmod(np.flatnonzero(x[part] @ meant.T >= bar[part][:, None]), len(meant))
                if len(row):
                    yield part[row], places.start + at

    def ranked(self, x: np.ndarray, qids: np.ndarray, near: np.ndarray, stride: int, rank: int, exclude_same_id: bool) -> np.ndarray:
        """The score at place ``rank`` among every ``stride``-th row of each query's cells; minus infinity if there are fewer."""
        picked = np.arange(0, len(self.ids), stride)
        number = np.searchsorted(self.cells, self.cell[picked])
        best = np.full((len(x), rank), -np.inf, np.float32)
        near = np.ascontiguousarray(near.T)
        for c in range(0, len(picked), PIECE):
            places, cell = picked[c:c + PIECE], number[c:c + PIECE]
            meant, ids = self.meant(places), self.ids[places]
            order, some = np.argsort(ids, kind="stable"), near[:, cell[0]:cell[-1] + 1]
            times = np.bincount(cell - cell[0])
            rows = np.flatnonzero(some.any(axis=1))
            for i in range(0, len(rows), PIECE):
                part = rows[i:i + PIECE]
                s = x[part] @ meant.T
                np.copyto(s, -np.inf, where=np.repeat(~some[part], times, axis=1))
                if exclude_same_id:
                    own, n = V._runs(ids[order], qids[part])
                    s[np.repeat(np.arange(len(part)), n), order[own]] = -np.inf
                best[part] = np.partition(np.hstack([best[part], s]), -rank, axis=1)[:, -rank:]
        return best.min(axis=1)


def _asked(queries: pd.DataFrame, tile: _Coded) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, unit vectors, lengths, cells of the tile x queries) of the queries that have numbers only."""
    vectors = _wide(queries["vector"].to_list(), np.ones(len(queries), np.int64), tile.dim)
    bits = np.frombuffer(b"".join(queries["wanted"]), np.uint8).reshape(len(queries), -1)
    near = np.empty((len(tile.cells), len(queries)), bool)
    for i in range(0, len(queries), PIECE):                # a query has a bit for every cell of the index
        near[:, i:i + PIECE] = np.unpackbits(bits[i:i + PIECE], axis=1)[:, tile.cells].T
    x, length, usable = _units(vectors)
    near &= usable
    return queries["_id"].to_numpy(np.int64), vectors, x, length, near


def _bars(books: np.ndarray, dim: int, keep: int, wider: int, exclude_same_id: bool):
    """A score that about ``keep`` codes of a tile reach, or more, for each query; minus infinity if there are fewer.

    Of a long list the bar is the score at a place of every so-manieth code, four standard errors down and ``wider`` times that.
    """
    stride = max(1, keep // SAMPLE_RANK)
    rank = keep if stride == 1 else wider * math.ceil(keep / stride + 4 * math.sqrt(keep / stride))

    def fn(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or not items["ids"].notna().any():
            return pd.DataFrame({"_id": np.zeros(0, np.int64), "bar": np.zeros(0, np.float32)})
        tile = _Coded(books, dim, items)
        qids, _, x, _, near = _asked(queries, tile)
        return pd.DataFrame({"_id": qids, "bar": tile.ranked(x, qids, near, stride, rank, exclude_same_id)})
    return fn


def _listed_cosines(books: np.ndarray, dim: int, k: int, exclude_same_id: bool):
    """The best ``k`` by cosine of a tile's codes that reach a query's bar, and the number of these codes in one of the rows.

    Similarities are summed left to right as in ``vectors.cosine``.
    """
    names = ["query_id", "item_id", "cell", "sim", "n"]

    def in_order(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        total = np.zeros(len(v))
        for d in range(dim):
            total += v[:, d] * w[:, d]
        return total

    def fn(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or not items["ids"].notna().any():
            return pd.DataFrame({c: [] for c in names})
        tile = _Coded(books, dim, items)
        qids, q, x, q_len, near = _asked(queries, tile)
        v, v_len, usable = _units(tile.vectors)
        margin = V.rounding(dim)
        bar = V._below(queries["bar"].to_numpy(np.float64) - 2 * margin, np.dtype(np.float32))   # products differ in their last bits
        best_s, best_i = np.full((len(qids), k), -np.inf), np.zeros((len(qids), k), np.int64)
        long = np.zeros(len(qids), np.int64)
        for rows, places in tile.reaching(x, near, bar):
            if exclude_same_id:
                other = tile.ids[places] != qids[rows]
                rows, places = rows[other], places[other]
            long += np.bincount(rows, minlength=len(qids))
            rows, places = rows[usable[places]], places[usable[places]]
            for i in range(0, len(rows), V.PAIRS_AT_ONCE):
                row, at = rows[i:i + V.PAIRS_AT_ONCE], places[i:i + V.PAIRS_AT_ONCE]
                with np.errstate(over="ignore"):
                    scale = 1 / (1 + V.EPS / np.maximum(q_len[row] * v_len[at], 1e-300))
                rough = np.einsum("ij,ij->i", x[row], v[at]) * scale
                least = best_s[row, -1] - margin
                if k == 1:                               # nothing but the best of these
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    top = np.maximum.reduceat(rough, first)
                    least = np.maximum(least, np.repeat(top, np.diff(first, append=len(row))) - 2 * margin)
                row, at = row[rough >= least], at[rough >= least]
                if len(row):
                    with np.errstate(over="ignore", invalid="ignore"):
                        sim = np.einsum("ij,ij->i", q[row], tile.vectors[at]) / (q_len[row] * v_len[at] + V.EPS)
                    V.put_in_order(best_s, best_i, row, np.nan_to_num(sim, nan=-np.inf), at, tile.ids)
        row, place = np.nonzero(np.isfinite(best_s))
        at = best_i[row, place]
        a, b = q[row], tile.vectors[at]
        with np.errstate(over="ignore", invalid="ignore"):
            sim = in_order(a, b) / (np.sqrt(in_order(a, a)) * np.sqrt(in_order(b, b)) + V.EPS)
        found = pd.DataFrame(dict(zip(names, (qids[row], tile.ids[at], tile.cell[at].astype(np.int32), sim, np.where(place == 0, long[row], 0)))))
        # a list may hold nothing that can match
        bare = np.flatnonzero((long > 0) & ~np.isfinite(best_s[:, 0]))
        return pd.concat([found, pd.DataFrame({"query_id": qids[bare], "n": long[bare]})]) if len(bare) else found
    return fn


def _code_score(books: np.ndarray):
    """The score of a code and its centroid for the query beside them."""
    usable = np.where(np.isfinite(books), books, 0.0)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = _stack(pdf["_u"])
                code = np.frombuffer(b"".join(pdf["code"]), np.uint8).reshape(len(x), -1)
                meant = usable[np.arange(len(books)), code].reshape(len(x), -1)[:, :x.shape[1]] + _stack(pdf["centroid"])
                yield pd.DataFrame({"_id": pdf["_id"], "bar": (x * meant).sum(axis=1).astype(np.float32)})
    return run


def _better(books: np.ndarray, dim: int):
    """How many codes of a tile reach a query's ``bar``, itself left out."""
    def fn(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or not items["ids"].notna().any():
            return pd.DataFrame({"_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        tile = _Coded(books, dim, items)
        qids, _, x, _, near = _asked(queries, tile)
        n = np.zeros(len(qids), np.int64)
        for row, at in tile.reaching(x, near, queries["bar"].to_numpy(np.float32)):
            n += np.bincount(row[tile.ids[at] != qids[row]], minlength=len(n))
        return pd.DataFrame({"_id": qids, "n": n})
    return fn
