"""Exact order statistics of groups of any size, by counting.

A value's rank is found by narrowing: count the values of each group by bucket,
take the bucket in which the wanted rank falls, and count again inside it, until a
bucket holds one value only.  The first pass takes sign and power of two as buckets,
so what is left of a group differs by less than a factor of two; each later pass
cuts that into ``BUCKETS`` equal parts, and since a double has 53 bits, six of them
suffice for any data.  All passes are partial aggregates: no group meets in one task and no
sketch is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.util import bounded_broadcast, written

BUCKETS = 1024


def _power_bucket(v: Column) -> Column:
    """Sign and power of two, in the order of the values; infinities and NaN (largest) have their own."""
    power = F.floor(F.log2(F.abs(v))) + 1100
    return F.when(F.isnan(v), 4001).when(v == float("inf"), 4000).when(v == float("-inf"), -4000) \
        .when(v == 0, 0).when(v > 0, power).otherwise(-power).cast("int")


def _narrowed(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The bucket of each group in which its rank falls: ``keys, low, high, rank``, rank counted in the bucket."""
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("_upto", F.sum("_n").over(upto))
    return run.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))) \
        .select(*keys, "_low", "_high", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float = 0.5, out: str = "median",
                   max_broadcast_rows: int = 200_000) -> DataFrame:
    """``keys, out``: the value at rank ``ceil(q n)`` of each group's n values that are not null, as double.

    For q = 0.5 that is the lower middle.  A group without values has null; a null key is a group of
    its own.  Buckets per group are bounded (about 4,200, then ``BUCKETS``), whatever its size.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = written(df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)],
                             F.col(value).cast("double").alias("_v")), "selection-values")
    per = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    first = rows.where("_v IS NOT NULL").withColumn("_bucket", _power_bucket(F.col("_v"))).groupBy(*names, "_bucket").agg(*per)
    total = F.sum("_n").over(Window.partitionBy(*names))
    first = first.withColumn("_rank", F.greatest(F.ceil(total * F.lit(q)), F.lit(1)))
    open_ = written(_narrowed(first, names), "selection")
    done = []
    while True:
        done.append(open_.where(F.col("_low") == F.col("_high")))
        open_ = open_.where(F.col("_low") < F.col("_high"))
        if open_.isEmpty():
            break
        asked = bounded_broadcast(open_.toDF(*[f"{n}q" for n in names], "_from", "_to", "_rank"), max_broadcast_rows)
        same = [F.col(n).eqNullSafe(F.col(f"{n}q")) for n in names]
        inside = rows.join(asked, [*same, F.col("_v") >= F.col("_from"), F.col("_v") <= F.col("_to")])
        # halves, so that the width of a range of huge values stays finite
        part = (F.col("_v") / 2 - F.col("_from") / 2) / (F.col("_to") / 2 - F.col("_from") / 2)
        bucket = F.least(F.floor(part * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
        counts = inside.withColumn("_bucket", bucket).groupBy(*names, "_bucket", "_rank").agg(*per)
        open_ = written(_narrowed(counts, names), "selection")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    groups = rows.select(*names).distinct()
    same = [F.col(n).eqNullSafe(F.col(f"{n}g")) for n in names]
    found = found.select(*[F.col(n).alias(f"{n}g") for n in names], F.col("_low").alias("_out"))
    return groups.join(found, same, "left").select(*[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("_out").alias(out))
