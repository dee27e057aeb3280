"""Mixing sources to target weights, in DataFrame operations only.

Sizes are summed per source; targets share the total by weight, no source above
``limit`` times its own size (water filling: the excess of the capped sources
goes to the others by weight).  A source's repetition rate is target / size;
each document is taken floor(rate) times plus once more if a number in [0, 1)
from a hash of its id and the seed is below the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import WORD, renamed, small, staged

LIMIT = 3


def word_count(text):
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_unit(key, seed: str):
    """A number in [0, 1) from the first 52 bits of an MD5 of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``source, source_size, weight, target`` from rows ``source, size``.

    Sources are numbered by code point with null last and weigh 1, 2, 3,
    repeating.  Ordered by cap / weight, the capped sources come first; the
    level (target per weight) of the first source that the level does not fill
    holds for all sources that are not capped.  The windows run over one row
    per source, after the sum.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")) \
        .withColumn("cap", limit * F.col("source_size"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("level",
                         (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
                         / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    per = per.withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)
    return per.withColumn("target", F.least(F.col("cap").cast("double"),
                                            F.coalesce(level["level"] * F.col("weight"), F.col("cap")))) \
        .select("source", "source_size", "weight", "target")


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               keep: list[str] | None = None, seed: str = "mix", limit: int = LIMIT) -> DataFrame:
    """``keep`` plus ``m_size, m_source_size, m_target, m_copies`` for every document.

    A null source is a source of its own; a null or empty text has size 0 and
    rate 0 if its whole source is empty.  Rows with equal ids make the same
    draw.  Nothing depends on partitioning, so reruns agree.
    """
    keep = keep or [id_col]
    base = docs.select(*[F.col(c) for c in keep], F.col(id_col).alias("__id"),
                       F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("m_size"))
    # one row per source is written; the words are counted again rather than written with the texts
    targets = staged(source_targets(base.select(F.col("__source").alias("source"), F.col("m_size").alias("size")),
                                    limit), "targets") \
        .select(F.col("source").alias("__s"), F.col("source_size").alias("m_source_size"),
                F.col("target").alias("m_target"))
    rate = F.when(F.col("m_source_size") > 0, F.col("m_target") / F.col("m_source_size")).otherwise(F.lit(0.0))
    out = base.join(small(targets), F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__rate", rate)
    copies = F.floor("__rate") + (hash_unit(F.col("__id"), seed) < F.col("__rate") - F.floor("__rate")).cast("long")
    return out.select(*keep, "m_size", "m_source_size", "m_target", copies.cast("long").alias("m_copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: every document's row as often as it is taken, all columns kept."""
    plain, name = renamed(docs)
    columns = {k: name[options.pop(k, default)] for k, default in
               (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    out = mix_counts(plain, keep=plain.columns, **columns, **options)
    return out.where("m_copies > 0").withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.col("m_copies")))) \
        .select(*plain.columns).toDF(*docs.columns)
