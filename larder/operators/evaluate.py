"""Evaluation and table statistics: classification report, mismatches, samples.

Every statistic is one aggregation (partial + final); the only values that
reach the driver are scalars (min/max for histogram edges) or per-class
counts, whose size is bounded by the number of classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators.util import with_dense_ids


def classification_report(df: DataFrame, truth: str, pred: str, digits: int | None = None) -> DataFrame:
    """Per-class precision / recall / F1 / support, then accuracy, macro and weighted averages.

    One ``groupBy(truth, pred).count()`` over the data; everything after it
    works on the confusion table (classes squared rows): each cell adds its
    count to its true class (support, and true positives on the diagonal)
    and to its predicted class, one small aggregate gives the per-class rows,
    which are checkpointed so the summary rows do not recompute them.
    0/0 gives 0.0.  The accuracy row fills only ``f1`` and ``support``.
    """
    cells = df.select(F.col(truth).cast("string").alias("t"), F.col(pred).cast("string").alias("p"))
    return _report(cells, [], digits)


def classification_reports(df: DataFrame, pairs: dict[str, tuple[str, str]], name_col: str,
                           digits: int | None = None) -> DataFrame:
    """The report of every ``name: (truth, prediction)`` pair in ``name_col``, from one pass over the data."""
    each = F.array(*[F.struct(F.lit(name).alias(name_col), F.col(t).cast("string").alias("t"),
                              F.col(p).cast("string").alias("p")) for name, (t, p) in pairs.items()])
    return _report(df.select(F.explode(each).alias("x")).select("x.*"), [name_col], digits)


def _report(cells: DataFrame, groups: list[str], digits: int | None) -> DataFrame:
    conf = cells.groupBy(*groups, "t", "p").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    parts = F.array(
        F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), n).otherwise(0).alias("tp"),
                 n.alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"),
                 n.alias("predicted")))
    cells = conf.select(*groups, F.explode(parts).alias("c")).select(*groups, "c.*").filter(F.col("label").isNotNull())
    per = cells.groupBy(*groups, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                                     F.sum("predicted").alias("predicted"))

    def ratio(a, b):
        return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)

    per = per.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))) \
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0))
                         .otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
    per = per.checkpoint(eager=True)  # classes-sized
    tot = per.groupBy(*groups).agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"), F.count(F.lit(1)).alias("k"),
                  F.sum("precision").alias("sp"), F.sum("recall").alias("sr"), F.sum("f1").alias("sf"),
                  F.sum(F.col("precision") * F.col("support")).alias("wp"),
                  F.sum(F.col("recall") * F.col("support")).alias("wr"),
                  F.sum(F.col("f1") * F.col("support")).alias("wf"))
    null = F.lit(None).cast("double")
    summary = tot.select(*groups, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), null.alias("precision"), null.alias("recall"),
                 ratio(F.col("tp"), F.col("n")).alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ratio(F.col("sp"), F.col("k")).alias("precision"),
                 ratio(F.col("sr"), F.col("k")).alias("recall"), ratio(F.col("sf"), F.col("k")).alias("f1"),
                 F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), ratio(F.col("wp"), F.col("n")).alias("precision"),
                 ratio(F.col("wr"), F.col("n")).alias("recall"), ratio(F.col("wf"), F.col("n")).alias("f1"),
                 F.col("n").alias("support")))).alias("r")).select(*groups, "r.*")
    out = per.select(*groups, "label", "precision", "recall", "f1", "support").unionByName(summary) \
        .withColumn("support", F.col("support").cast("long"))
    if digits is not None:
        out = out.select(*groups, "label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support")
    return out


def misclassified(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Rows where truth and prediction differ (NULL-safe)."""
    return df.filter(~F.col(truth).eqNullSafe(F.col(pred)))


def every_nth(df: DataFrame, order_col: str, n: int) -> DataFrame:
    """Systematic sample: rows 1, n+1, 2n+1, ... of the total order, plus the last row."""
    numbered = with_dense_ids(df, [order_col], "rn", start=1)
    total = numbered.agg(F.max("rn")).first()[0] or 0
    return numbered.filter(((F.col("rn") - 1) % n == 0) | (F.col("rn") == total))


def join_by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str],
                     how: str = "left", index_col: str = "idx") -> DataFrame:
    """Join two tables row by row when no key exists: row ``i`` of each side's total order.

    Both sides get consecutive positions from ``with_dense_ids`` (no
    one-task window), then an equi join on the position.
    """
    lpos = with_dense_ids(left, left_order, index_col, start=1)
    rpos = with_dense_ids(right, right_order, index_col, start=1)
    return lpos.join(rpos, index_col, how)


def alignment_check(left: DataFrame, right: DataFrame, key: str, col: str, preview: int = 38) -> DataFrame:
    """Row-by-row comparison of two tables on ``key``; NULL-safe, whole values.

    A key present on one side only is never ``same``.
    """
    l_ = left.select(key, F.col(col).alias("_l"), F.lit(True).alias("_lp"))
    r_ = right.select(key, F.col(col).alias("_r"), F.lit(True).alias("_rp"))
    j = l_.join(r_, key, "full_outer")
    both = F.col("_lp").isNotNull() & F.col("_rp").isNotNull()
    return j.select(key, (both & F.col("_l").eqNullSafe(F.col("_r"))).alias("same"),
                    F.substring("_l", 1, preview).alias("left_preview"),
                    F.substring("_r", 1, preview).alias("right_preview"))


def longest_per_group(df: DataFrame, group: str, id_col: str, text_col: str) -> DataFrame:
    """Per group: the largest word count and the row holding it (smallest id on ties)."""
    wc = df.select(group, id_col, T.word_count(text_col).alias("n_words"))
    best = F.min(F.struct((-F.col("n_words")).alias("less"), F.col(id_col).alias("id"))).alias("b")
    return wc.groupBy(group).agg(best).select(group, (-F.col("b.less")).alias("max_words"),
                                             F.col("b.id").alias(id_col))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram; empty bins kept; the maximum falls in the last bin.

    Edges come from one ``min/max`` aggregate (two scalars to the driver);
    counting is one partial aggregate; the bin table has ``bins`` rows.
    """
    spark = df.sparkSession
    lo, hi = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    all_bins = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return all_bins.select("bin", F.lit(None).cast("double").alias("lo"),
                               F.lit(None).cast("double").alias("hi"), F.lit(0).cast("long").alias("n"))
    width = (hi - lo) / bins
    x = F.col(col).cast("double")
    b = F.lit(1) if hi == lo else F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int") + 1,
                                          F.lit(bins))
    counts = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(all_bins).join(counts, "bin", "left").select(
        "bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def column_counts(df: DataFrame) -> DataFrame:
    """Non-NULL count of every column, one row, ``n_<column>``."""
    return df.agg(*[F.count(F.col(c)).alias(f"n_{c}") for c in df.columns])


def top_by(df: DataFrame, value, id_col: str, k: int, value_name: str) -> DataFrame:
    """The ``k`` largest rows by ``value`` (ties by smaller id): a top-k, not a full sort."""
    return df.select(id_col, value.alias(value_name)).orderBy(F.desc(value_name), F.asc(id_col)).limit(k)
