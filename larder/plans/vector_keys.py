"""Vector queries on ``embeddings`` (the product catalogue) and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import vectors as V
from larder.operators.ann import SUB, TwoLevelIndex
from larder.plans import sql_text as S
from larder.plans.registry import register
from larder.session import ensure_checkpoint_dir, read_table, table_path

_DBL = "CAST(embedding AS DOUBLE[])"
_SUM = "lambda a, b: a + b"


def _dot_sql(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), {_SUM})"


@register("cosine_pairs", f"""
WITH e AS (SELECT vec_id, {_DBL} AS v FROM embeddings)
SELECT a.vec_id, b.vec_id AS next_id, {_dot_sql('a.v', 'b.v')} AS dot,
       {_dot_sql('a.v', 'b.v')} / (sqrt({_dot_sql('a.v', 'a.v')}) * sqrt({_dot_sql('b.v', 'b.v')}) + 1e-8) AS cosine
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"),
                   F.col("embedding").alias("nv"))
    j = e.join(nxt, "vec_id")
    return j.select("vec_id", "next_id", V.dot("embedding", "nv").alias("dot"),
                    V.cosine("embedding", "nv").alias("cosine"))


@register("normalize_vectors", f"""
WITH s AS (SELECT vec_id, list_transform({_DBL}, lambda x: x * (vec_id + 1)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt({_dot_sql('v', 'v')}) AS nv FROM s),
u AS (SELECT vec_id, nv, CASE WHEN nv = 0 THEN list_transform(v, lambda x: CAST(x AS FLOAT))
                             ELSE list_transform(v, lambda x: CAST(x / nv AS FLOAT)) END AS f FROM n)
SELECT vec_id, nv AS norm_in,
       sqrt({_dot_sql('CAST(f AS DOUBLE[])', 'CAST(f AS DOUBLE[])')}) AS norm_out, f[1] AS first FROM u""")
def normalize_vectors(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    scaled = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)).alias("v"))
    unit = scaled.select("vec_id", V.norm("v").alias("norm_in"), V.l2_normalize("v").alias("f"))
    return unit.select("vec_id", "norm_in", V.norm("f").alias("norm_out"), F.col("f")[0].alias("first"))


_KNN_SQL = f"""
WITH e AS (SELECT vec_id, {_DBL} AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt({_dot_sql('v', 'v')}) AS nv FROM e),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id,
             list_dot_product(a.v, b.v) / (a.nv * b.nv + 1e-8) AS sim
      FROM n a JOIN n b ON a.vec_id <> b.vec_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS r
                        FROM p) WHERE r = 1)"""


def _knn_all(spark, sf_dir, **kw):
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return V.knn(e, e, k=1, query_id="vec_id", item_id="vec_id", exclude_same_id=True, **kw)


@register("knn_exact", _KNN_SQL + "\nSELECT query_id, item_id, round(sim, 6) AS sim FROM best")
def knn_exact(spark, sf_dir):
    return _knn_all(spark, sf_dir).select("query_id", "item_id", F.round("sim", 6).alias("sim"))


def _index(spark, sf_dir, rebuild=False) -> TwoLevelIndex:
    """The stored index of ``embeddings``; built by whichever query needs it first."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return TwoLevelIndex.stored(e, table_path(sf_dir, "embeddings"), f"{ensure_checkpoint_dir(spark)}/larder/indexes",
                                rebuild, item_id="vec_id")


@register("knn_ivf_build", f"""
SELECT vec_id, CAST(ceil(len(embedding) / {SUB}.0) AS INTEGER) AS code_bytes, len(embedding) * 4 AS raw_bytes
FROM embeddings WHERE embedding IS NOT NULL""")
def knn_ivf_build(spark, sf_dir):
    """A fresh two-level index of ``embeddings``: bytes that a search reads of each vector, against its own."""
    index = _index(spark, sf_dir, rebuild=True)
    coded = index.codes.join(index.vectors.select("cell", "_id", F.size("_v").alias("dim")), ["cell", "_id"])
    return coded.select(F.col("_id").alias("vec_id"), F.octet_length("code").alias("code_bytes"),
                        (F.col("dim") * 4).cast("long").alias("raw_bytes"))


@register("knn_ivf", _KNN_SQL + "\nSELECT query_id, item_id, round(sim, 6) AS sim FROM best")
def knn_ivf(spark, sf_dir):
    """The certified search of the stored index: the answer of the exact search."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    m = _index(spark, sf_dir).query(e, query_id="vec_id", exclude_same_id=True, exact=True)
    return m.select("query_id", "item_id", F.round("sim", 6).alias("sim"))


@register("knn_ivf_recall", "SELECT count(*) AS queries, true AS recall_ok FROM embeddings")
def knn_ivf_recall(spark, sf_dir):
    """The codes of the probed cells lead to at least 95 of 100 nearest neighbours."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = _index(spark, sf_dir).query(e, query_id="vec_id", exclude_same_id=True) \
        .select("query_id", F.col("item_id").alias("found"))
    right = F.count_if(F.col("found") == F.col("item_id"))
    return _knn_all(spark, sf_dir).join(found, "query_id", "left") \
        .agg(F.count(F.lit(1)).alias("queries"), (right >= 0.95 * F.count(F.lit(1))).alias("recall_ok"))


KETO_THRESHOLD = 0.38
CARB_LIMIT = 10.0


@register("keto_items", _KNN_SQL + f"""
SELECT query_id, item_id, round(sim, 6) AS sim, CAST(item_id % 20 AS DOUBLE) AS carbs,
       coalesce(sim >= {KETO_THRESHOLD} AND item_id % 20 <= {CARB_LIMIT}, false) AS keto FROM best""")
def keto_items(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    matches = _index(spark, sf_dir).query(e, query_id="vec_id", exclude_same_id=True, exact=True)
    cat = e.select("vec_id", (F.col("vec_id") % 20).cast("double").alias("carbs"))
    lab = V.classify_keto(matches, cat, "vec_id", "carbs", KETO_THRESHOLD, CARB_LIMIT)
    return lab.select("query_id", "item_id", F.round("sim", 6).alias("sim"), "carbs", "keto")


def vectors_cte(texts: str, fitted: str, dim: int, out: str) -> str:
    """CTE ``out(id, embedding)``: hashed TF-IDF vectors of ``texts(id, text)`` by the bucket rule of
    ``vectors.term_buckets``, weighted by the documents of ``fitted(id, text)``."""
    def counts(table: str) -> str:
        return f"""(SELECT id, bucket, count(*)::DOUBLE AS n FROM (
  SELECT id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} AS bucket
  FROM (SELECT id, unnest({S.analyse_terms('text')}) AS term FROM {table})) GROUP BY id, bucket)"""
    return f"""{out}_idf AS (SELECT bucket, count(*) AS df FROM {counts(fitted)} GROUP BY bucket),
{out}_x AS (SELECT id, t.bucket, n * ln(((SELECT count(*) FROM {fitted}) + 1.0::DOUBLE) / (coalesce(df, 0) + 1.0::DOUBLE)) AS v
  FROM {counts(texts)} t LEFT JOIN {out}_idf i ON i.bucket = t.bucket),
{out}_l AS (SELECT id, sqrt(list_reduce(list(v * v ORDER BY bucket), lambda a, b: a + b)) AS len,
             map_from_entries(list((bucket, v))) AS m FROM {out}_x GROUP BY id),
{out} AS (SELECT d.id, list_transform(range({dim}), lambda i:
    CAST(coalesce(CASE WHEN len > 0 THEN element_at(m, i)[1] / len END, 0.0) AS FLOAT)) AS embedding
  FROM {texts} d LEFT JOIN {out}_l l ON l.id = d.id)"""


def encoder_sql(dim: int) -> str:
    """Vectors of ``documents``, fitted on themselves."""
    return f"""
WITH d AS (SELECT doc_id AS id, text FROM documents),
{vectors_cte('d', 'd', dim, 'e')}
SELECT id AS doc_id, embedding FROM e"""


@register("encode_text", encoder_sql(256))
def encode_text(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return V.encode_text(docs, "text", dim=256).select("doc_id", "embedding")
