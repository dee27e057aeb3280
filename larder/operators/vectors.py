"""Vector operators: dot / cosine / normalisation, blocked exact kNN, IVF kNN, encoder.

Exact kNN never materialises the pair table.  Both sides are cut into
blocks; each (query block, catalogue block) pair meets in ONE cogroup task
that does a NumPy matrix product in bounded chunks and keeps only its top-k
per query; a final per-query top-k (k x blocks rows per query) merges them.
Queries are replicated once per catalogue block and the catalogue once per
query block, so the shuffle is ``|Q| x C + |C| x Q`` rows, with the block
counts chosen from the row counts.

IVF kNN trains k-means on the catalogue (MLlib, distributed), sends each
query to its ``nprobe`` nearest cells (a kNN against the centroid table),
and runs the same blocked top-k inside each probed cell; large cells are
salted into sub-blocks so a cell holding a third of the rows is still split
over many tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators.util import dealt_evenly

EPS = 1e-8
LOWEST = -np.finfo(np.float64).max
TASKS_PER_CORE = 4
ENCODE_ROWS = 256            # texts that a plug-in encoder gets at once
PAIRS_PER_TASK = 8 << 20     # comparisons that are worth a task of their own
PAIRS_AT_ONCE = 1 << 14      # pairs whose vectors are side by side in memory
LEAST_LENGTH = 0.1           # shorter vectors: the epsilon of the similarity may outweigh single precision


# ------------------------------------------------------------ expressions

def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    """Dot product in double precision, summed left to right."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """``dot / (|a| |b| + 1e-8)``: a zero vector gives 0."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPS))


def l2_normalize(a, as_float: bool = True) -> Column:
    """Unit-length vector; the zero vector is returned unchanged."""
    t = "float" if as_float else "double"
    # the outer lambda binds the length: the inner one would take it anew for each element
    return F.transform(F.array(norm(a)), lambda n: F.when(n == 0, F.transform(_c(a), lambda x: x.cast(t)))
                       .otherwise(F.transform(_c(a), lambda x: (x.cast("double") / n).cast(t))))[0]


# -------------------------------------------------------- blocked top-k

def top_matches(qids, cids, k, score, exclude_same_id=False, q_chunk=1024, c_chunk=1024, digits=None, wanted=None):
    """The ``k`` best of ``cids`` for each of ``qids``: (scores, places in ``cids``), short rows filled with minus infinity.

    ``score(rows, columns)`` gives one tile of at most ``q_chunk x c_chunk`` scores (8 MB), so task memory
    does not grow with the block.  Only what reaches a row's k-th best score so far is put in order: by score
    rounded to ``digits`` (the last bits of a product do not part equal vectors), then by id.
    Where a tile's scores may be off by ``score.margin``, ``score.pairs`` scores what could be among the best anew.
    ``wanted`` is (rows x cells, cell of each column): a row meets the columns of its own cells only.
    """
    k = min(k, len(cids))
    out_s, out_i = np.full((len(qids), k), -np.inf), np.zeros((len(qids), k), dtype=np.int64)
    if not k:
        return out_s, out_i
    margin, slack = getattr(score, "margin", 0.0), 0.0 if digits is None else 10.0 ** -digits
    orders = {}
    for qs in range(0, len(qids), q_chunk):
        best_s, best_i = out_s[qs:qs + q_chunk], out_i[qs:qs + q_chunk]
        for cs in range(0, len(cids), c_chunk):
            ci, rows, mask = cids[cs:cs + c_chunk], np.arange(len(best_s)), None
            if wanted is not None:
                cell = wanted[1][cs:cs + c_chunk]
                near = wanted[0][qs:qs + q_chunk, cell[0]:cell[-1] + 1]
                rows = np.flatnonzero(near.any(axis=1))
                mask = None if near[rows].all() else near[rows][:, cell - cell[0]]
            if not len(rows):
                continue
            sims = score(qs + rows, slice(cs, cs + len(ci)))
            if mask is not None:
                sims[~mask] = -np.inf
            if exclude_same_id:
                if cs not in orders:
                    orders[cs] = np.argsort(ci, kind="stable")
                order = orders[cs]
                own, n = _runs(ci[order], qids[qs + rows])
                sims[np.repeat(np.arange(len(rows)), n), order[own]] = -np.inf
            top = sims.max(axis=1)
            bar = _below(best_s[rows, -1] - slack - margin, sims.dtype)
            hot = np.flatnonzero(top >= bar)                 # later tiles have nothing better for most rows
            if not len(hot):
                continue
            if len(hot) < len(rows):
                rows, sims, top, bar = rows[hot], sims[hot], top[hot], bar[hot]
            fits = sims >= bar[:, None]
            if np.count_nonzero(fits) > 4 * k * len(rows) and sims.shape[1] > k:       # a higher bar: the k-th best here
                here = top if k == 1 else np.partition(sims, -k, axis=1)[:, -k]
                fits = sims >= np.maximum(bar, _below(here - slack - 2 * margin, sims.dtype))[:, None]
            row, at = np.divmod(np.flatnonzero(fits), fits.shape[1])
            s = score.pairs(qs + rows[row], cs + at) if margin else sims[row, at]
            put_in_order(best_s, best_i, rows[row], s, cs + at, cids, digits)
    return out_s, out_i


def put_in_order(best_s: np.ndarray, best_i: np.ndarray, rows: np.ndarray, s: np.ndarray, i: np.ndarray, ids: np.ndarray, digits=None):
    """New scores ``s`` of places ``i`` (of ``ids``) among the best of their rows, by score and then by id."""
    hit = np.unique(rows)
    old_r, old_c = np.nonzero(best_s[hit] > -np.inf)
    r = np.concatenate([hit[old_r], rows])
    s = np.concatenate([best_s[hit][old_r, old_c], s])
    i = np.concatenate([best_i[hit][old_r, old_c], i])
    order = np.lexsort((i, ids[i], -s if digits is None else -np.round(s, digits), r))
    r, s, i = r[order], s[order], i[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    kept = place < best_s.shape[1]
    best_s[r[kept], place[kept]], best_i[r[kept], place[kept]] = s[kept], i[kept]


def _below(bar: np.ndarray, kind) -> np.ndarray:
    """The bars in the type of the scores, rounded down; minus infinity reaches none."""
    if kind == np.float64:
        return np.maximum(bar, LOWEST)
    least = np.finfo(kind).min
    with np.errstate(over="ignore"):
        return np.maximum(np.nextafter(np.maximum(bar, least).astype(kind), kind.type(-np.inf)), least)


def _runs(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each value in an ordered array, one after the other, and how many each has."""
    first = np.searchsorted(ordered, values, side="left")
    n = np.searchsorted(ordered, values, side="right") - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def _products(a: np.ndarray, b: np.ndarray, scale=None):
    """Scores for ``top_matches``: the rows' products, by ``scale(rows, columns)``; what is no number matches nothing."""
    # the longest of either side bounds every product
    finite = np.isfinite(np.linalg.norm(a, axis=1).max(initial=0) * np.linalg.norm(b, axis=1).max(initial=0))

    def score(rows, columns):
        sims = a[rows] @ b[columns].T
        if scale is not None:
            sims /= scale(rows, columns)
        if not finite:
            sims[np.isnan(sims)] = -np.inf
        return sims
    return score


def _cosines(qmat: np.ndarray, cmat: np.ndarray):
    """Scores for ``top_matches``: dot / (|q| |c| + 1e-8)."""
    qn, cn = np.linalg.norm(qmat, axis=1), np.linalg.norm(cmat, axis=1)

    def scale(rows, columns):
        out = np.outer(qn[rows], cn[columns])
        out += EPS
        return out
    return _products(qmat, cmat, scale)


def rounding(dim: int) -> float:
    """How far a single-precision product of two unit vectors may be from theirs: rounded factors, a sum in any order."""
    return 1.01 * (dim + 8) * 2.0 ** -24


class _RoughCosines:
    """Scores for ``top_matches`` of vectors of ``LEAST_LENGTH`` at least: single precision, pairs that matter in double."""

    def __init__(self, qmat: np.ndarray, cmat: np.ndarray, qn: np.ndarray, cn: np.ndarray):
        self.qmat, self.cmat, self.qn, self.cn = qmat, cmat, qn, cn
        self.q, self.c = (qmat / qn[:, None]).astype(np.float32), (cmat / cn[:, None]).astype(np.float32)
        self.margin = rounding(qmat.shape[1]) + EPS / LEAST_LENGTH ** 2

    def __call__(self, rows, columns):
        return self.q[rows] @ self.c[columns].T

    def pairs(self, rows, columns) -> np.ndarray:
        out = np.empty(len(rows))
        for i in range(0, len(rows), PAIRS_AT_ONCE):
            r, c = rows[i:i + PAIRS_AT_ONCE], columns[i:i + PAIRS_AT_ONCE]
            out[i:i + len(r)] = np.einsum("ij,ij->i", self.qmat[r], self.cmat[c]) / (self.qn[r] * self.cn[c] + EPS)
        return out


def top_cosines(qids, qmat, cids, cmat, k, exclude_same_id=False, q_chunk=1024, c_chunk=1024, digits=None, wanted=None):
    """``top_matches`` by cosine: short vectors and those with a value that is no number are scored in double throughout."""
    with np.errstate(over="ignore"):
        qn, cn = np.linalg.norm(qmat, axis=1), np.linalg.norm(cmat, axis=1)
    usual = [np.isfinite(n) & (n >= LEAST_LENGTH) for n in (qn, cn)]
    k = min(k, len(cids))
    out_s, out_i = np.full((len(qids), k), -np.inf), np.zeros((len(qids), k), dtype=np.int64)
    for rough, of_q, of_c in ((True, usual[0], usual[1]), (False, usual[0], ~usual[1]), (False, ~usual[0], np.full(len(cids), True))):
        r, c = np.flatnonzero(of_q), np.flatnonzero(of_c)
        if not (len(r) and len(c)):
            continue
        a, b = qmat if len(r) == len(qmat) else qmat[r], cmat if len(c) == len(cmat) else cmat[c]
        score = _RoughCosines(a, b, qn[r], cn[c]) if rough else _cosines(a, b)
        s, i = top_matches(qids[r], cids[c], k, score, exclude_same_id, q_chunk, c_chunk, digits,
                           wanted and (wanted[0][r], wanted[1][c]))
        s, i = np.hstack([out_s[r], s]), np.hstack([out_i[r], c[i]])
        order = np.lexsort((i, cids[i], -s if digits is None else -np.round(s, digits)), axis=1)[:, :k]
        out_s[r], out_i[r] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
    return out_s, out_i


def _topk_block(qids, qmat, cids, cmat, k, exclude_same_id, q_chunk=1024, c_chunk=1024, digits=None):
    """Top-k cosine of each query against one catalogue block: (similarities, ids)."""
    s, i = top_cosines(qids, qmat, cids, cmat, k, exclude_same_id, q_chunk, c_chunk, digits)
    return s, cids[i]


def _block_fn(k, exclude_same_id, digits=None):
    def fn(qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or cdf.empty:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"),
                                 "item_id": pd.Series([], dtype="int64"),
                                 "sim": pd.Series([], dtype="float64")})
        qids = qdf["_id"].to_numpy(dtype=np.int64)
        cids = cdf["_id"].to_numpy(dtype=np.int64)
        qmat = np.stack(qdf["_v"].to_numpy()).astype(np.float64)
        cmat = np.stack(cdf["_v"].to_numpy()).astype(np.float64)
        s, i = _topk_block(qids, qmat, cids, cmat, k, exclude_same_id, digits=digits)
        keep = np.isfinite(s)
        rows_q = np.broadcast_to(qids[:, None], s.shape)
        return pd.DataFrame({"query_id": rows_q[keep], "item_id": i[keep], "sim": s[keep]})
    return fn


def _merge_topk(cands: DataFrame, k: int) -> DataFrame:
    """Global top-k per query from per-block candidates (k x blocks rows per query)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), F.asc("item_id"))
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(vec).alias("_v"))


def _blocks(n: int, block_rows: int) -> int:
    return max(1, math.ceil(n / block_rows))


def block_grid(nq: int, nc: int, cores: int, rows_fit: int) -> tuple[int, int]:
    """Blocks of either side: as many as memory asks for, and enough pairs of them to use every core.

    The second number does not grow with the tables, so neither does what is
    shuffled for each row until blocks are as large as memory lets them be.  Where
    it can be met without a rest, no core waits for a last round of a few tasks.
    """
    tasks = max(1, min(TASKS_PER_CORE * cores, math.ceil(nq * nc / PAIRS_PER_TASK)))
    best = math.sqrt(tasks * nq / max(nc, 1))
    qb = max(1, min(tasks, round(best)))
    even = [x for x in range(1, tasks + 1) if tasks % x == 0 and best / 1.5 <= x <= 1.5 * best]
    qb = min(even, key=lambda x: abs(x - best)) if even else qb
    return max(_blocks(nq, rows_fit), qb), max(_blocks(nc, rows_fit), math.ceil(tasks / qb))


def knn(queries: DataFrame, catalogue: DataFrame, k: int = 1, query_id: str = "query_id",
        item_id: str = "item_id", vec: str = "embedding", exclude_same_id: bool = False,
        query_block_rows: int | None = None, item_block_rows: int | None = None,
        block_bytes: int = 64 << 20) -> DataFrame:
    """Exact top-k cosine neighbours: ``(query_id, item_id, sim, rank)``; ties by ``item_id``.

    A NULL vector matches nothing; of several rows with one query id the
    largest vector (by array order) is searched.  Blocks hold at most ``block_bytes`` of float64 vectors per
    side and are cut further only until every core has work (``block_grid``), which keeps the
    replication (``|Q| x C + |C| x Q`` rows) low.
    """
    # both sides are written once (shared checkpoint folder): the row counts that size
    # the blocks and the block join then read the vectors instead of recomputing
    # whatever produced them (an encoder, a lexicon pass), and a lost executor
    # resumes from the written vectors
    q = _vectors(queries, query_id, vec).groupBy("_id").agg(F.max("_v").alias("_v")).checkpoint(eager=True)
    c = _vectors(catalogue, item_id, vec).checkpoint(eager=True)
    nq, nc = q.count(), c.count()
    first = c.select(F.size("_v")).first()
    dim = max(1, int(first[0]) if first and first[0] else 1)
    QB, CB = block_grid(nq, nc, q.sparkSession.sparkContext.defaultParallelism, max(1, block_bytes // (dim * 8)))
    QB = _blocks(nq, query_block_rows) if query_block_rows else QB
    CB = _blocks(nc, item_block_rows) if item_block_rows else CB
    qb = q.withColumn("qb", F.pmod(F.xxhash64("_id"), F.lit(QB)).cast("int")) \
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(CB - 1))))
    cb = c.withColumn("cb", F.pmod(F.xxhash64("_id"), F.lit(CB)).cast("int")) \
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(QB - 1))))
    qb, cb = (dealt_evenly(df, F.col("qb") * CB + F.col("cb"), QB * CB).drop("qb", "cb") for df in (qb, cb))
    cands = qb.groupBy("slot").cogroup(cb.groupBy("slot")).applyInPandas(
        _block_fn(k, exclude_same_id), "query_id long, item_id long, sim double")
    return _merge_topk(cands, k)


RECALL_SAMPLE = 256      # catalogue vectors on which ``build`` measures the cells to probe
TARGET_RECALL = 0.95


class IvfIndex:
    """An inverted-file index over a catalogue: k-means cells, stored once, probed many times.

    ``build`` trains MLlib k-means on the L2-normalised catalogue (distributed)
    and writes the centroids and the catalogue with its cell to the shared
    folder.  The cells that a query probes are measured, not fixed: for a
    sample of the catalogue, the rank of the cell that holds the exact nearest
    neighbour, at the share ``target_recall`` of the sample, so the number grows with
    the cells.  ``query`` sends each query to its nearest centroids (a blocked kNN against the
    centroid table) and runs the blocked top-k inside each probed cell; a cell is
    cut into salts by its own size and its queries into blocks, so neither
    side of a group grows.  With ``nprobe >= cells`` every cell is searched and the
    answer equals ``knn``.
    """

    def __init__(self, centroids: DataFrame, items: DataFrame, salts: DataFrame, cells: int, nprobe: int,
                 block_rows: int):
        self.centroids, self.items, self.salts = centroids, items, salts
        self.cells, self.nprobe, self.block_rows = cells, nprobe, block_rows

    @classmethod
    def build(cls, catalogue: DataFrame, item_id: str = "item_id", vec: str = "embedding",
              cells: int | None = None, seed: int = 42, max_iter: int = 20, cell_block_rows: int = 20_000,
              path: str | None = None, target_recall: float = TARGET_RECALL) -> "IvfIndex":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        from larder.session import shared_path
        spark = catalogue.sparkSession
        c = _vectors(catalogue, item_id, vec).select("_id", l2_normalize(F.col("_v"), as_float=False).alias("_v")) \
            .checkpoint(eager=True)
        nc = c.count()
        cells = cells or max(1, round(math.sqrt(nc)))
        feats = c.withColumn("_f", array_to_vector("_v"))
        model = KMeans(k=cells, seed=seed, featuresCol="_f", predictionCol="cell", maxIter=max_iter).fit(feats)
        assigned = model.transform(feats).select("_id", "_v", F.col("cell").cast("int"))
        path = path or shared_path(spark, "ivf")
        assigned.write.mode("overwrite").parquet(f"{path}/items")
        items = spark.read.parquet(f"{path}/items")
        # the mean of a cell's members is its centroid: no list of centroids goes through the driver
        items.groupBy("cell").agg(vector_to_array(Summarizer.mean(array_to_vector("_v"))).alias("embedding")) \
            .write.mode("overwrite").parquet(f"{path}/centroids")
        centroids = spark.read.parquet(f"{path}/centroids")
        salts = items.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_block_rows).cast("int").alias("salts"))
        salts.write.mode("overwrite").parquet(f"{path}/salts")
        salts = spark.read.parquet(f"{path}/salts")
        cells = salts.count()
        # rank of the cell of the exact neighbour, for a sample by hash
        share = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 2 * RECALL_SAMPLE / max(nc, 1)))
        sample = c.where(share).limit(RECALL_SAMPLE).checkpoint(eager=True)
        best = knn(sample, c, k=1, query_id="_id", item_id="_id", vec="_v", exclude_same_id=True)
        order = knn(sample.withColumnRenamed("_v", "embedding"), centroids, k=cells, query_id="_id", item_id="cell")
        ranks = best.select("query_id", F.col("item_id").alias("_id")).join(items.select("_id", "cell"), "_id") \
            .join(order.select("query_id", F.col("item_id").alias("cell"), "rank"), ["query_id", "cell"])
        nprobe = ranks.agg(F.percentile("rank", target_recall)).first()[0]
        return cls(centroids, items, salts, cells, max(1, math.ceil(nprobe or 1)), cell_block_rows)

    def query(self, queries: DataFrame, k: int = 1, nprobe: int | None = None, query_id: str = "query_id",
              vec: str = "embedding", exclude_same_id: bool = False) -> DataFrame:
        nprobe = min(nprobe or self.nprobe, self.cells)
        q = _vectors(queries, query_id, vec).groupBy("_id").agg(F.max("_v").alias("_v")).checkpoint(eager=True)
        probes = knn(q.withColumnRenamed("_v", "embedding"), self.centroids, k=nprobe, query_id="_id", item_id="cell")
        probes = probes.select(F.col("query_id").alias("_id"), F.col("item_id").cast("int").alias("cell")) \
            .checkpoint(eager=True)
        blocks = probes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / self.block_rows).cast("int").alias("blocks"))
        plan = self.salts.join(blocks, "cell").checkpoint(eager=True)
        qs = probes.join(q, "_id").join(plan, "cell") \
            .withColumn("block", F.pmod(F.xxhash64("_id"), "blocks").cast("int")) \
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        its = self.items.join(plan, "cell") \
            .withColumn("salt", F.pmod(F.xxhash64("_id"), "salts").cast("int")) \
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        key = ["cell", "salt", "block"]
        cands = qs.select("_id", "_v", *key).groupBy(*key).cogroup(its.select("_id", "_v", *key).groupBy(*key)) \
            .applyInPandas(_block_fn(k, exclude_same_id), "query_id long, item_id long, sim double")
        return _merge_topk(cands, k)


def knn_ivf(queries: DataFrame, catalogue: DataFrame, k: int = 1, cells: int | None = None,
            nprobe: int | None = None, seed: int = 42, query_id: str = "query_id", item_id: str = "item_id",
            vec: str = "embedding", exclude_same_id: bool = False, cell_block_rows: int = 20_000,
            max_iter: int = 20) -> DataFrame:
    """Approximate top-k: build an ``IvfIndex`` over the catalogue and query it once."""
    index = IvfIndex.build(catalogue, item_id, vec, cells, seed, max_iter, cell_block_rows)
    return index.query(queries, k, nprobe, query_id, vec, exclude_same_id)


def classify_keto(matches: DataFrame, catalogue: DataFrame, item_id: str, carb_col: str,
                  threshold: float = 0.1, limit: float = 10.0) -> DataFrame:
    """Low-carb label from the best match: close enough AND carbs at most ``limit`` (NULL/NaN: false)."""
    carbs = catalogue.select(F.col(item_id).cast("long").alias("item_id"), F.col(carb_col).cast("double").alias("carbs"))
    j = matches.join(carbs, "item_id", "left")
    ok = (F.col("sim") >= threshold) & (F.col("carbs") <= limit) & ~F.isnan("carbs")
    return j.withColumn("keto", F.coalesce(ok, F.lit(False)))


# ----------------------------------------------------------------- encoder

def term_buckets(col, dim: int) -> Column:
    """The bucket of each term of a text, as strings: the first 32 bits of the term's MD5 modulo ``dim``."""
    return F.transform(T.analyse_terms(col), lambda t: F.pmod(
        F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("string"))


class _TextEncoder:
    """Fitted pipeline whose ``transform`` adds ``out`` as ``ARRAY<FLOAT>``."""

    def __init__(self, model, col, dim, out):
        self.model, self.col, self.dim, self.out = model, col, dim, out

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        buckets = F.coalesce(term_buckets(self.col, self.dim), F.array().cast("array<string>"))
        return self.model.transform(df.withColumn("_tok", buckets)) \
            .withColumn(self.out, vector_to_array("_n", "float32")).drop("_tok", "_tf", "_idf", "_n")


def fit_text_encoder(df: DataFrame, col: str, dim: int = 256, out: str = "embedding", min_doc_freq: int = 0):
    """Built-in text encoder: lowercase terms -> hashed term frequencies -> IDF -> L2 norm.

    Buckets are a column expression (``term_buckets``), the rest are MLlib
    stages, fitted on the cluster (IDF is one distributed pass whose state is a
    ``dim``-long vector); the returned object embeds any frame.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer

    counts = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="_tok", outputCol="_tf")
    buckets = F.coalesce(term_buckets(col, dim), F.array().cast("array<string>"))
    idf = IDF(inputCol="_tf", outputCol="_idf", minDocFreq=min_doc_freq) \
        .fit(counts.transform(df.select(buckets.alias("_tok"))))
    model = PipelineModel([counts, idf, Normalizer(inputCol="_idf", outputCol="_n", p=2.0)])
    return _TextEncoder(model, col, dim, out)


def encode_text(df: DataFrame, col: str, dim: int = 256, out: str = "embedding",
                min_doc_freq: int = 0) -> DataFrame:
    """Fit the built-in encoder on ``df`` and embed it; output ``ARRAY<FLOAT>``."""
    return fit_text_encoder(df, col, dim, out, min_doc_freq).transform(df)


def encode_with(df: DataFrame, col: str, encoder, out: str = "embedding") -> DataFrame:
    """Plug-in encoder: ``encoder.dim`` and ``encoder.transform(iter of pandas Series) -> iter of arrays``.

    Runs on Arrow batches, one encoder instance per partition; the encoder sees ``ENCODE_ROWS`` texts at a
    time, and only these become Python objects, however many rows or long texts a batch holds.
    """
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out, ArrayType(FloatType()))])
    at, names = df.columns.index(col), schema.names

    def run(batches):
        enc = encoder() if callable(encoder) and not hasattr(encoder, "transform") else encoder
        for batch in batches:
            for start in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(start, ENCODE_ROWS)
                vecs = enc.transform(pd.Series(part.column(at).to_pylist(), dtype=object))
                found = pa.array([np.asarray(v, dtype=np.float32) for v in vecs], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=names)
    return df.mapInArrow(run, schema)


class HashedNgramEncoder:
    """Example plug-in encoder for ``encode_with``: hashed character n-grams, L2-normalised.

    Deterministic (CRC32 buckets), no model files; stands in for a neural
    sentence encoder with the same ``dim`` / ``transform`` interface.
    """

    def __init__(self, dim: int = 256, n: int = 3):
        self.dim, self.n = dim, n

    def transform(self, texts):
        import zlib
        out = []
        for t in texts:
            v = np.zeros(self.dim, dtype=np.float32)
            s = f" {(t or '').lower()} "
            for i in range(max(0, len(s) - self.n + 1)):
                v[zlib.crc32(s[i:i + self.n].encode("utf-8")) % self.dim] += 1.0
            nrm = np.linalg.norm(v)
            out.append(v / nrm if nrm > 0 else v)
        return out


class HashedTermEncoder:
    """Example plug-in encoder: counts of MD5-hashed terms (``term_buckets``' rule), L2-normalised."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def transform(self, texts):
        import hashlib

        import regex
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for term in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()):
                if term:
                    v[int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % self.dim] += 1
            length = np.sqrt((v * v).sum())
            out.append((v / length if length else v).astype(np.float32))
        return out


class PluginModel:
    """Wraps a plug-in encoder (``dim`` / ``transform(texts)``) as a model with ``transform(df)``,

    so the resumable embedding stream can run a user model on Arrow batches.
    """

    def __init__(self, encoder, col: str, out: str = "embedding"):
        self.encoder, self.col, self.out = encoder, col, out

    def transform(self, df: DataFrame) -> DataFrame:
        return encode_with(df, self.col, self.encoder, self.out)
