"""Incremental ingest with Structured Streaming.

New files in a source folder are read as a stream, labelled in
``foreachBatch`` and written to ONE folder per batch id with overwrite, so a
batch replayed after a failure replaces its own output instead of adding
rows twice; the checkpoint folder records which files were taken.  With
``trigger(availableNow=True)`` a run processes what is there and stops;
running it again processes only new files.  The vocabulary grows by keyed state, see
``grow_vocabulary``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.operators.util import with_dense_ids
from larder.session import path_exists

TERMS_PER_PARTITION = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def ingest(spark: SparkSession, src: str, schema: StructType | str, target: str, checkpoint: str,
           labeller: Callable[[DataFrame], DataFrame], vocab: str | None = None,
           vocab_terms: Callable[[DataFrame], DataFrame] | None = None,
           max_files_per_trigger: int | None = None, fmt: str = "parquet") -> int:
    """Run the ingest stream until the available files are done; returns batches run.

    ``labeller`` turns a micro-batch into output rows.  When ``vocab`` is
    given, ``vocab_terms(batch)`` yields ``(term)`` rows for ``grow_vocabulary``,
    which runs as a query of its own beside the labels.
    """
    stream = _files(spark, src, schema, max_files_per_trigger, fmt)
    ran = []

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        ran.append(batch_id)
        labeller(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    query = (stream.writeStream.foreachBatch(run_batch)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if vocab is not None and vocab_terms is not None:
        grow_vocabulary(spark, vocab_terms(_files(spark, src, schema, max_files_per_trigger, fmt)), vocab,
                        f"{checkpoint}-vocabulary")
    return len(ran)


def _files(spark: SparkSession, src: str, schema: StructType | str, max_files_per_trigger: int | None,
           fmt: str) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(src)


def grow_vocabulary(spark: SparkSession, terms: DataFrame, vocab: str, checkpoint: str) -> int:
    """Add the terms of a stream that no earlier batch had; returns batches run.

    ``terms`` is a streaming frame with a ``term`` column.  A keyed de-duplication
    in the RocksDB state store lets each term through once, ever, so the vocabulary
    that is already there is neither read nor joined; the state is versioned
    by batch, so a replayed batch lets the same terms through and overwrites its
    own folder ``batch=<id>``.  Ids continue the sequence in text order within a batch: the
    first id of a batch is the one row that its predecessor left in ``next``.  A null term is skipped.
    """
    ran = []
    counters = f"{vocab.rstrip('/')}-next"

    def run_batch(new: DataFrame, batch_id: int) -> None:
        ran.append(batch_id)
        new = new.persist()                          # counted and written, one pass over the state
        n, start = new.count(), 1
        if batch_id and path_exists(spark, f"{counters}/batch={batch_id - 1}"):
            start = spark.read.schema("first BIGINT").parquet(f"{counters}/batch={batch_id - 1}").first()["first"]
        with_dense_ids(new.select("term"), ["term"], "id", start=start, num_partitions=-(-n // TERMS_PER_PARTITION) or 1) \
            .write.mode("overwrite").parquet(f"{vocab}/batch={batch_id}")
        spark.createDataFrame([(start + n,)], "first BIGINT").write.mode("overwrite").parquet(f"{counters}/batch={batch_id}")
        new.unpersist()

    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        query = (terms.where(F.col("term").isNotNull()).select("term").dropDuplicates(["term"])
                 .writeStream.foreachBatch(run_batch).outputMode("append")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_PROVIDER, before) if before else spark.conf.unset(STATE_PROVIDER)
    return len(ran)


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """The ingested table without the batch column."""
    return spark.read.parquet(target).drop("batch")


def embed_stream(spark: SparkSession, src: str, schema: StructType | str, target: str, checkpoint: str,
                 model, text_col: str, out_col: str = "embedding", key: str = "id",
                 max_files_per_trigger: int | None = None) -> int:
    """Resumable embedding of a large table: a fitted encoder applied per micro-batch.

    ``model`` is a fitted Spark ML model (or anything with ``transform(df)``)
    whose output has ``out_col``; rows are written per batch id, so a crash
    resumes at the first batch not committed in the checkpoint.
    """
    def label(batch: DataFrame) -> DataFrame:
        return model.transform(batch).select(key, text_col, out_col)
    return ingest(spark, src, schema, target, checkpoint, label, max_files_per_trigger=max_files_per_trigger)
