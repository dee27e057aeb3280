"""Product-table operators: cleaning, per-name medians, corrections, appends.

All of them are declarative DataFrame plans.  Aggregations are partial +
final (map-side combine), so one product name holding a large share of the
rows does not end up as a single huge task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.functions import text as T
from larder.operators.util import bounded_broadcast, with_column_once, with_dense_ids

ROWS_PER_PARTITION = 1_000_000     # of appended rows


def select_products(raw: DataFrame, name_col: str = "product_name",
                    nutriment_col: str = "nutriments", lang: str = "en",
                    nutriment: str = "carbohydrates") -> DataFrame:
    """Raw nested product rows to ``(product_name, carbohydrates_100g)``.

    The nutriment field is chosen from the schema at plan time: ``100g``
    when the struct has it, ``value`` otherwise (a NULL ``100g`` stays NULL).
    """
    elem = raw.schema[nutriment_col].dataType.elementType
    assert isinstance(elem, StructType)
    field = "100g" if "100g" in elem.fieldNames() else "value"
    return raw.select(
        T.pick_language_text(name_col, lang).alias("product_name"),
        T.pick_nutriment(nutriment_col, nutriment, field).cast("double").alias("carbohydrates_100g"),
    )


def clean_names(df: DataFrame, name_col: str = "product_name", value_col: str | None = "carbohydrates_100g",
                fold: bool = True) -> DataFrame:
    """Name cleaning chain: blank filter, accents, lowercase, punctuation, two letters, singular."""
    keep = T.not_blank(name_col)
    if value_col:
        keep = keep & F.col(value_col).isNotNull()
    out = df.filter(keep)
    name = T.fold_accents(name_col) if fold else F.col(name_col)
    out = with_column_once(out, name_col, T.clean_text(F.lower(name)))
    out = out.filter(T.has_two_letters(name_col) & T.not_blank(name_col))
    out = with_column_once(out, name_col, T.singularize(name_col, split_hyphens=False))
    return out.filter(T.not_blank(name_col))


def median_per_key(df: DataFrame, key: str, value: str, out: str = "median",
                   accuracy: int = 10000) -> DataFrame:
    """Lower-middle median per key (``percentile_approx``), partial + final aggregate."""
    return df.groupBy(key).agg(F.percentile_approx(value, 0.5, accuracy).cast("double").alias(out))


def median_join(df: DataFrame, key: str, value: str, out: str = "median",
                accuracy: int = 10000) -> DataFrame:
    """Attach the per-key median to every row.

    The aggregate side shrinks to one row per key before the join; no hint is
    forced: adaptive execution broadcasts it only when it is small at run
    time and otherwise uses a sort-merge join with skew splitting.
    """
    med = median_per_key(df, key, value, out, accuracy)
    return df.join(med, on=key, how="left")


def dedupe_by_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per key: the row with the smallest ``order_col`` (deterministic)."""
    others = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*others), F.col(order_col)).alias("_best")
    return df.groupBy(key).agg(best).select(key, "_best.*")


def clean_products(raw: DataFrame, name_col: str = "product_name", nutriment_col: str = "nutriments",
                   lang: str = "en", accuracy: int = 10000) -> DataFrame:
    """Whole cleaning job: pick, clean, one row per name with its median carbs."""
    picked = select_products(raw, name_col, nutriment_col, lang)
    cleaned = clean_names(picked)
    return median_per_key(cleaned, "product_name", "carbohydrates_100g", "carbohydrates_100g", accuracy) \
        .withColumn("carbohydrates_100g", F.col("carbohydrates_100g").cast("float"))


def write_clean_products(raw: DataFrame, path: str, name_col: str = "product_name",
                         nutriment_col: str = "nutriments", lang: str = "en", accuracy: int = 10000) -> DataFrame:
    """Run the cleaning job into ``path`` and return ``(stage_no, stage, rows)`` for it.

    The row counts after each step are observed while the job runs (named
    ``observe`` metrics), so they cost no extra pass over the data; the
    written table is read back and counted, as the original job did.
    """
    from pyspark.sql import Observation
    spark = raw.sparkSession
    obs = [Observation(f"s{i}") for i in range(4)]
    one = F.count(F.lit(1)).alias("rows")
    picked = select_products(raw.observe(obs[0], one), name_col, nutriment_col, lang)
    kept = picked.filter(T.not_blank("product_name") & F.col("carbohydrates_100g").isNotNull()).observe(obs[1], one)
    cleaned = clean_names(kept).observe(obs[2], one)
    out = median_per_key(cleaned, "product_name", "carbohydrates_100g", "carbohydrates_100g", accuracy) \
        .withColumn("carbohydrates_100g", F.col("carbohydrates_100g").cast("float")).observe(obs[3], one)
    out.write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path).count()
    names = ["input", "named_with_carbs", "cleaned", "distinct_names"]
    rows = [(i, n, int(o.get["rows"])) for i, (n, o) in enumerate(zip(names, obs))] + [(4, "written", written)]
    return spark.createDataFrame(rows, "stage_no int, stage string, rows long")


def stage_counts(df: DataFrame, stages: list[tuple[str, object]], distinct_col=None,
                 distinct_stage: str = "distinct") -> DataFrame:
    """Row counts after each cumulative filter stage in ONE pass.

    ``stages`` is a list of ``(name, predicate Column)``; each stage keeps
    the rows of the stage before it.  Output: ``(stage_no, stage, rows)``.
    """
    aggs, names = [F.count(F.lit(1)).alias("s0")], ["input"]
    cond = F.lit(True)
    for i, (name, pred) in enumerate(stages, start=1):
        cond = cond & F.coalesce(pred, F.lit(False))
        aggs.append(F.count_if(cond).alias(f"s{i}"))
        names.append(name)
    if distinct_col is not None:
        aggs.append(F.count_distinct(F.when(cond, distinct_col)).alias(f"s{len(names)}"))
        names.append(distinct_stage)
    row = df.agg(*aggs)
    stack = ", ".join(f"{i}, '{n}', s{i}" for i, n in enumerate(names))
    return row.selectExpr(f"stack({len(names)}, {stack}) as (stage_no, stage, rows)") \
        .select(F.col("stage_no").cast("int"), "stage", F.col("rows").cast("long"))


def apply_overrides(df: DataFrame, overrides: DataFrame, key: str, value: str,
                    override_key: str = "product_name", override_value: str | None = None,
                    max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Table-driven correction by exact lowercase key; a repeated key is an error."""
    override_value = override_value or value
    ov = overrides.select(F.lower(F.col(override_key)).alias("_k"), F.col(override_value).alias("_v"))
    dup = ov.groupBy("_k").count().filter("count > 1").limit(1).collect()
    if dup:
        raise ValueError(f"override table repeats key {dup[0]['_k']!r}")
    ov = bounded_broadcast(ov, max_broadcast_rows)
    joined = df.join(ov, F.lower(F.col(key)) == F.col("_k"), "left")
    return joined.withColumn(value, F.coalesce(F.col("_v").cast(df.schema[value].dataType), F.col(value))) \
        .drop("_k", "_v")


def append_rows(df: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """Append rows with ids ``max(id) + 1, + 2, ...`` (empty table starts at 0)."""
    top = df.agg(F.max(id_col).alias("m")).first()["m"]  # one scalar
    start = 0 if top is None else int(top) + 1
    # consecutive ids in the order of the new rows' columns, without a one-task window
    numbered = with_dense_ids(rows, list(rows.columns), id_col, start=start,
                              num_partitions=-(-rows.count() // ROWS_PER_PARTITION) or 1)
    return df.unionByName(numbered.select(*df.columns))
