"""Incremental ingest of ``documents`` split into files, run twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.operators.lexicon import keyword_flag
from larder.plans import sql_text as S
from larder.plans.registry import register
from larder.plans.vector_keys import encoder_sql
from larder.plans.sql_text import q
from larder.session import read_table, shared_path, stored_bytes, table_path
from larder.streaming import ingest as ING

FLAG_WORDS = ["worthless", "enau"]
DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


FILE_BYTES = 32 << 20        # of the table, in one arriving file
TRIGGER_FILES = 64


def _arriving(spark, sf_dir) -> tuple[int, int]:
    """(files that the documents arrive in, files of a batch): four and two, and more for a larger table.

    No file or task grows with the table, and a batch keeps more files than there are cores.
    """
    files = max(4, -(-stored_bytes(spark, table_path(sf_dir, "documents")) // FILE_BYTES))
    return files, min(TRIGGER_FILES, max(2, files // 2))


def _label(batch):
    return batch.select("doc_id", "lang", T.word_count("text").alias("n_words"),
                        keyword_flag("text", FLAG_WORDS, case_sensitive=False).alias("clean"))


@register("stream_ingest", f"""
SELECT doc_id, lang, CAST({S.word_count('text')} AS INTEGER) AS n_words,
       NOT ({' OR '.join(f"contains(lower(text), {q(w)})" for w in FLAG_WORDS)}) AS clean
FROM documents""")
def stream_ingest(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    src = shared_path(spark, "stream-src")
    # the arriving files: the table split by source into several files, a large source into several of them
    files, per_batch = _arriving(spark, sf_dir)
    docs.repartition(files, "source", F.pmod(F.xxhash64("doc_id"), F.lit(files))).write.mode("overwrite").parquet(src)
    target, ckpt = shared_path(spark, "stream-out"), shared_path(spark, "stream-ckpt")
    vocab = shared_path(spark, "stream-vocab")

    def terms(batch):
        return batch.select(F.explode(F.array_distinct(T.analyse_terms("text"))).alias("term"))
    ING.ingest(spark, src, DOC_SCHEMA, target, ckpt, _label, vocab, terms, max_files_per_trigger=per_batch)
    # a restart finds nothing new and writes nothing
    again = ING.ingest(spark, src, DOC_SCHEMA, target, ckpt, _label, vocab, terms, max_files_per_trigger=per_batch)
    assert again == 0, "second run must not re-process committed files"
    return ING.read_ingested(spark, target)


@register("embed_resume", encoder_sql(64))
def embed_resume(spark, sf_dir):
    """Resumable embedding (R2): fit the encoder once, then embed arriving files batch by batch."""
    from larder.operators.vectors import fit_text_encoder
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_text_encoder(docs, "text", dim=64)
    src = shared_path(spark, "embed-src")
    files, per_batch = _arriving(spark, sf_dir)
    docs.repartition(files).write.mode("overwrite").parquet(src)
    target, ckpt = shared_path(spark, "embed-out"), shared_path(spark, "embed-ckpt")
    ING.embed_stream(spark, src, "doc_id BIGINT, text STRING", target, ckpt, model, "text",
                     key="doc_id", max_files_per_trigger=per_batch)
    again = ING.embed_stream(spark, src, "doc_id BIGINT, text STRING", target, ckpt, model, "text",
                             key="doc_id", max_files_per_trigger=per_batch)
    assert again == 0, "second run must not re-process committed files"
    return ING.read_ingested(spark, target).select("doc_id", "embedding")


@register("embed_plugin", f"""
WITH t AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket
           FROM (SELECT doc_id, unnest({S.analyse_terms('text')}) AS term FROM documents)),
n AS (SELECT doc_id, bucket, count(*)::DOUBLE AS n FROM t GROUP BY doc_id, bucket),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS len, map_from_entries(list((bucket, n))) AS m FROM n GROUP BY doc_id)
SELECT d.doc_id, list_transform(range(64), lambda i: CAST(coalesce(element_at(m, i)[1] / len, 0.0) AS FLOAT)) AS embedding
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id""")
def embed_plugin(spark, sf_dir):
    """Resumable embedding by an encoder that the user brings, in Arrow batches."""
    from larder.operators.vectors import HashedTermEncoder, PluginModel
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    src, target, ckpt = (shared_path(spark, f"plugin-{x}") for x in ("src", "out", "ckpt"))
    files, per_batch = _arriving(spark, sf_dir)
    docs.repartition(files).write.mode("overwrite").parquet(src)
    ING.embed_stream(spark, src, "doc_id BIGINT, text STRING", target, ckpt, PluginModel(HashedTermEncoder(64), "text"), "text",
                     key="doc_id", max_files_per_trigger=per_batch)
    return ING.read_ingested(spark, target).select("doc_id", "embedding")
