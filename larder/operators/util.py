"""Small shared plan helpers: size-checked broadcast, dense ids, parameter tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.session import shared_path

# Parameter tables (lexicons, term lists, overrides) at or under this many rows
# are broadcast; the bound is checked, never assumed.
DEFAULT_BROADCAST_ROWS = 200_000
DEFAULT_BROADCAST_BYTES = 256 << 20
MOST_SLOTS = 1024


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: texts by their length, arrays of numbers by their size, other values 8."""
    parts = [F.lit(8)]
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        size = F.octet_length(f.name) if kind in ("string", "binary", "varchar", "char") else \
            F.size(f.name) * 8 if kind in ("array", "map") else F.lit(8)
        parts.append(F.coalesce(size.cast("long"), F.lit(0)) + 8)
    return sum(parts[1:], parts[0])


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS,
                      known_rows: int | None = None, materialize: bool = False,
                      max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows of ``max_bytes`` together.

    Both are taken with ``limit(max_rows + 1)`` so the check itself never
    reads more rows than the bound.  Above the bound the plain DataFrame comes back
    and the optimizer picks a shuffle join.  ``materialize`` first writes a
    derived (expensive) table to the shared checkpoint folder, so counting it
    and joining it do not compute it twice.
    """
    if known_rows is None and materialize:
        df = df.checkpoint(eager=True)
    if known_rows is not None:
        return F.broadcast(df) if known_rows <= max_rows else df
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and size <= max_bytes else df


def param_table(spark: SparkSession, rows: list, schema: str,
                max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """A small parameter table given by the caller; broadcast when within the bound."""
    df = spark.createDataFrame(rows, schema)
    return bounded_broadcast(df, max_rows, known_rows=len(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    What follows reads files that every executor sees: the plan above runs
    once, and a lost executor costs only its own tasks.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def even_keys(n: int) -> list[int]:
    """``n`` whole numbers that Spark's hash partitioning deals to ``n`` partitions one by one (Murmur3 of an int, seed 42)."""
    found, i, full = {}, 0, (1 << 32) - 1

    def turned(x: int, by: int) -> int:
        return (x << by | x >> 32 - by) & full
    while len(found) < n:
        h = turned(42 ^ turned(i * 0xcc9e2d51 & full, 15) * 0x1b873593 & full, 13) * 5 + 0xe6546b64 & full
        h ^= 4
        h = (h ^ h >> 16) * 0x85ebca6b & full
        h = (h ^ h >> 13) * 0xc2b2ae35 & full
        h ^= h >> 16
        found.setdefault((h - (1 << 32) if h >> 31 else h) % n, i)
        i += 1
    return [found[p] for p in range(n)]


def dealt_evenly(df: DataFrame, number: Column, n: int) -> DataFrame:
    """``df`` with a column ``slot`` of the groups ``number`` (0 to n - 1), each group in a partition of its own.

    Groups that take long would otherwise share a task by chance or as their rows are few.  Above
    ``MOST_SLOTS`` groups chance is even enough.
    """
    if n > MOST_SLOTS:
        return df.withColumn("slot", number.cast("int")).repartition(MOST_SLOTS, "slot")
    return df.withColumn("slot", F.array(*map(F.lit, even_keys(n)))[number.cast("int")]).repartition(n, "slot")


def with_dense_ids(df: DataFrame, order_cols: list[str], id_col: str = "id", start: int = 1,
                   num_partitions: int | None = None) -> DataFrame:
    """Consecutive ids in the total order of ``order_cols`` without a one-task window.

    Range-partition and sort, number rows inside each partition from
    ``monotonically_increasing_id`` (partition index in the high bits), then
    add per-partition offsets.  The offsets table has one row per partition,
    so its broadcast is bounded by the partition count.  The sorted frame is
    checkpointed to the shared checkpoint folder so that both passes see the
    same partitioning, and so that a lost executor does not change the ids.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ties on the order columns are broken by a row hash, so a value shared by a
    # large share of the rows is still split over several range partitions
    tie = F.xxhash64(*[F.col(c) for c in df.columns]).alias("_tie")
    keys = list(order_cols) + ["_tie"]
    sorted_df = (df.select("*", tie).repartitionByRange(n, *keys)
                 .sortWithinPartitions(*keys)
                 .withColumn("_mid", F.monotonically_increasing_id())
                 .checkpoint(eager=True))
    part = F.shiftright(F.col("_mid"), 33)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_df.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = sorted_df.withColumn("_pid", part).join(F.broadcast(offsets), "_pid")
    return out.withColumn(id_col, (F.col("_off") + local + F.lit(start)).cast("long")) \
        .drop("_mid", "_pid", "_off", "_tie")


def with_column_once(df: DataFrame, name: str, expr) -> DataFrame:
    """Add (or replace) a column that later filters cannot inline.

    Catalyst pushes a filter below the projection that defines its column by
    substituting the defining expression, so an expensive expression (regex
    chains, lambdas, Python UDF) then runs once in the filter and again in
    the projection, and the filter can even slide below a repartition meant
    to spread the work.  Emitting the value from a one-element ``explode``
    (a Generate node) evaluates it once: predicates on generator output are
    never pushed below the generator.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(expr)).alias(name))
