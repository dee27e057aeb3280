"""Sources and sinks: pruned Parquet scans, part files, CSV, guarded and resumable loads.

Paths handed to these functions must be on storage every executor sees;
``larder.session.shared_path`` gives one below the cluster's checkpoint
folder.  Writes are whole-DataFrame writes by the executors; nothing is
funnelled through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.session import path_exists, shared_path

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": "\\N",
    "lineSep": "\n",
}


def scan(spark: SparkSession, path: str, columns: list[str] | None = None,
         where: Column | None = None, schema: StructType | None = None) -> DataFrame:
    """Parquet scan of the named columns only; the filter reaches the reader.

    For nested columns pass ``schema`` naming only the needed struct fields:
    lambdas over arrays of structs are not pruned by the optimizer, an
    explicit read schema is.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if columns:
        df = df.select(*columns)
    if where is not None:
        df = df.filter(where)
    return df


def write_parts(df: DataFrame, path: str, parts: int) -> str:
    """Write as ``parts`` Parquet files (round-robin split, no key shuffle skew)."""
    df.repartition(parts).write.mode("overwrite").parquet(path)
    return path


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All part files of a folder as one table; no row order is promised."""
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, max_records_per_file: int = 200_000) -> str:
    """CSV with header; quotes escaped by doubling so cells may hold quotes and newlines.

    A file whose cells hold newlines cannot be split, so a reader has a task
    for each file: files are bounded in rows, not in number.
    """
    df.write.mode("overwrite").options(**CSV_OPTIONS).option("maxRecordsPerFile", max_records_per_file).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with header and cells holding newlines, typed by an explicit schema."""
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write, read back and count (the count runs on the written files)."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path).count()


def has_rows(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.parquet(path).limit(1).count() > 0
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):   # not loaded yet
            return False
        raise


def guarded_load(df: DataFrame, target: str, rebuild: bool = False) -> int:
    """Load ``df`` into ``target`` unless it already holds rows.

    Returns the number of rows written (0 when skipped).  ``rebuild`` drops
    what is there and loads again (overwrite).
    """
    spark = df.sparkSession
    if not rebuild and has_rows(spark, target):
        return 0
    df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


MANIFEST = "chunk string, n long"


def _committed(spark: SparkSession, target: str) -> list:
    """The manifest's rows: chunks whose rows count."""
    path = f"{target.rstrip('/')}/_manifest"
    return spark.read.schema(MANIFEST).parquet(path).collect() if path_exists(spark, path) else []      # one row a chunk


def _commit(spark: SparkSession, target: str, chunk: str, n: int) -> None:
    spark.createDataFrame([(chunk, n)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{target.rstrip('/')}/_manifest")


def read_resumed(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a ``resume_missing`` target: those of committed chunks, whatever a crash left beside them."""
    chunks = [f"{target.rstrip('/')}/chunk={r['chunk']}" for r in _committed(spark, target)]
    if not chunks:
        raise FileNotFoundError(f"no committed chunk below {target}")
    return spark.read.parquet(*chunks)


def resume_missing(source: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], target: str,
                   rows_per_chunk: int = 50_000_000, least_chunks: int = 4) -> int:
    """Compute and add only the keys not yet in ``target`` (resumable long job); returns the rows there.

    The source is read once: what an anti join against the committed chunks
    leaves is written to the shared folder, and its files are dealt into chunks of about
    ``rows_per_chunk`` rows (at least ``least_chunks`` of them, as far as there are files).  Each chunk is read once,
    written to a folder of its own and then committed by one row of a manifest.  A
    crash loses the chunk it meets; if it falls between the rows and the commit, ``read_resumed``
    does not see those rows and the next run makes them again.  A null key is a key.
    """
    spark = source.sparkSession
    todo = source
    if _committed(spark, target):
        done = read_resumed(spark, target).select(F.col(key).alias("_done")).distinct()
        todo = source.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")
    staged = shared_path(spark, "resume-todo")
    todo.write.option("maxRecordsPerFile", rows_per_chunk).parquet(staged)
    files = spark.read.schema(todo.schema).parquet(staged).groupBy(F.col("_metadata.file_path").alias("file")) \
        .agg(F.count(F.lit(1)).alias("n")).collect()                                  # one row a file
    size = min(rows_per_chunk, -(-sum(r["n"] for r in files) // least_chunks))
    chunks, load = [], size
    for r in sorted(files, key=lambda r: r["file"]):
        if load + r["n"] > size:
            chunks.append([])
            load = 0
        chunks[-1].append(r["file"])
        load += r["n"]
    for chunk in chunks:
        name, seen = uuid.uuid4().hex[:12], Observation()
        rows = compute(spark.read.schema(todo.schema).parquet(*chunk)).observe(seen, F.count(F.lit(1)).alias("n"))
        rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/chunk={name}")
        _commit(spark, target, name, int(seen.get["n"]))
    return sum(r["n"] for r in _committed(spark, target))


def conform(df: DataFrame, schema: StructType, defaults: dict | None = None) -> DataFrame:
    """Fixed target schema: cast every field, fill missing columns / NULLs with defaults."""
    defaults = defaults or {}
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        c = c.cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def load_labelled(df: DataFrame, target: str, label_cols: list[str], max_records_per_file: int = 1_000_000) -> str:
    """Write labelled rows clustered by their boolean labels (one folder per label combination).

    Diet filters on the loaded table then prune whole folders at planning
    time (partition filters) instead of reading every file.  Read it back
    with the table's schema so the label folders come back as booleans.
    """
    # adaptive execution brings the rows of a label together, splits large ones and merges small ones
    df.hint("rebalance", *label_cols).write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file) \
        .partitionBy(*label_cols).parquet(target)
    return target
