"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larder.session import shared_path

WORD = r"[^\x20\x09-\x0D]+"          # a word: no space, tab, LF, VT, FF or CR
SLICE_BYTES = 4 << 20                # of texts that a Python task works on at a time
BROADCAST_ROWS = 10_000              # a side with more rows is joined by a shuffle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, unchanged."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches to Python hold a few megabytes, unless the session sets their size itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    It cuts the lineage: what follows reads files that every executor sees,
    so a lost executor repeats only its own tasks, and the work above runs once.
    """
    bounded_batches(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of ``staged`` tables that nothing reads any more.

    What came of them is written, so a lost executor never needs them again.
    """
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/larder/" in folder:                     # a folder that ``shared_path`` named
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files that no plan refers to any more.

    Its cleaner follows the driver's garbage collection, which otherwise may not run before a job's end.
    """
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a bounded count shows at most ``bound`` rows."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def renamed(df: DataFrame) -> tuple[DataFrame, dict]:
    """``df`` with its columns named c0, c1, ... and the new name of each old one.

    An operator's own columns then clash with none of them; ``toDF`` with the old names undoes it.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def slices(batches: Iterator[pa.RecordBatch], column: int = -1) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``SLICE_BYTES`` of a text column, so that memory follows the bytes, not the rows."""
    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column % batch.num_columns)), 0)))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + SLICE_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_bytes(df: DataFrame, column: str, fn: Callable[[list], dict], fields: list[T.StructField],
              keep: list[str]) -> DataFrame:
    """Append columns computed from a text column's UTF-8 bytes, batch by batch in Arrow.

    ``fn`` takes a list of ``bytes`` (``None`` for null) and returns a dict of
    one list or array per field of ``fields``.  Only ``keep`` and the new
    fields come back; names must differ.
    """
    source = df.select(*keep, F.col(column).cast("binary").alias("__text"))
    schema = T.StructType([f for f in source.schema.fields if f.name != "__text"] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            new = fn(batch.column(batch.num_columns - 1).to_pylist())
            arrays = [c.cast(f.type) for c, f in zip(batch.columns[:-1], arrow)]
            arrays += [pa.array(new[f.name], type=f.type) for f in list(arrow)[len(arrays):]]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)
