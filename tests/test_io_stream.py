"""Sources, sinks and the ingest stream on small hand-made inputs."""

from pyspark.sql import functions as F

from larder.functions import text as T
from larder.session import shared_path
from larder.sources import io as IO
from larder.streaming import ingest as ING


def test_csv_roundtrip_tricky_cells(spark):
    rows = [(1, 'say "hi",\nthen leave'), (2, "  padded  "), (3, ""), (4, None), (5, "a\\b")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    path = IO.write_csv(df, shared_path(spark, "t-csv"))
    back = sorted(tuple(r) for r in IO.read_csv(spark, path, "id bigint, text string").collect())
    assert back == rows


def test_guarded_and_resumed_loads(spark):
    df = spark.range(0, 50).withColumnRenamed("id", "k")
    target = shared_path(spark, "t-guard")
    assert IO.guarded_load(df, target) == 50
    assert IO.guarded_load(df, target) == 0
    assert IO.guarded_load(df, target, rebuild=True) == 50
    out = shared_path(spark, "t-resume")
    IO.resume_missing(df.filter("k < 20"), "k", lambda d: d.withColumn("sq", F.col("k") * F.col("k")), out)
    IO.resume_missing(df, "k", lambda d: d.withColumn("sq", F.col("k") * F.col("k")), out)
    got = spark.read.parquet(out)
    assert got.count() == 50 and got.select("k").distinct().count() == 50


def test_ingest_twice_and_new_files(spark):
    src, target = shared_path(spark, "t-src"), shared_path(spark, "t-out")
    ckpt, vocab = shared_path(spark, "t-ckpt"), shared_path(spark, "t-vocab")
    schema = "doc_id bigint, text string"
    spark.createDataFrame([(1, "egg milk"), (2, "rice")], schema).write.mode("append").parquet(src)

    def label(b):
        return b.select("doc_id", T.word_count("text").alias("n_words"))

    def terms(b):
        return b.select(F.explode(T.analyse_terms("text")).alias("term"))
    assert ING.ingest(spark, src, schema, target, ckpt, label, vocab, terms) == 1
    assert ING.ingest(spark, src, schema, target, ckpt, label, vocab, terms) == 0
    spark.createDataFrame([(3, "egg tofu")], schema).write.mode("append").parquet(src)
    assert ING.ingest(spark, src, schema, target, ckpt, label, vocab, terms) == 1
    got = sorted(tuple(r) for r in ING.read_ingested(spark, target).collect())
    assert got == [(1, 2), (2, 1), (3, 2)]
    words = sorted((r.id, r.term) for r in spark.read.parquet(vocab).collect())
    # egg added once; ids continue from batch to batch and never change
    assert words == [(1, "egg"), (2, "milk"), (3, "rice"), (4, "tofu")]


def test_embed_stream_with_plugin_model(spark):
    from larder.operators.vectors import HashedNgramEncoder, PluginModel
    src, target, ckpt = shared_path(spark, "t-esrc"), shared_path(spark, "t-eout"), shared_path(spark, "t-eckpt")
    schema = "id bigint, text string"
    spark.createDataFrame([(1, "egg"), (2, "rice")], schema).write.mode("append").parquet(src)
    model = PluginModel(HashedNgramEncoder(dim=16), "text")
    assert ING.embed_stream(spark, src, schema, target, ckpt, model, "text") == 1
    assert ING.embed_stream(spark, src, schema, target, ckpt, model, "text") == 0
    got = {r.id: len(r.embedding) for r in ING.read_ingested(spark, target).collect()}
    assert got == {1: 16, 2: 16}


def test_vocabulary_state_survives_a_replay(spark):
    """A batch whose output is lost before its commit is run again: same terms, same ids, and no later ones move."""
    import os
    import shutil
    src, vocab, ckpt = (shared_path(spark, f"t-{x}").removeprefix("file:") for x in ("vsrc", "vvocab", "vckpt"))

    def run():
        lines = spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).parquet(src)
        return ING.grow_vocabulary(spark, lines.select(F.explode(T.analyse_terms("text")).alias("term")), vocab, ckpt)

    def words():
        return sorted((r.id, r.term) for r in spark.read.parquet(vocab).collect())
    for line in ("b a", "c a"):
        spark.createDataFrame([(line,)], "text string").coalesce(1).write.mode("append").parquet(src)
        assert run() == 1
    assert words() == [(1, "a"), (2, "b"), (3, "c")]
    # the second batch's commit is lost with its rows: the state goes back to the first batch
    os.remove(f"{ckpt}/commits/1")
    crc = f"{ckpt}/commits/.1.crc"
    if os.path.exists(crc):
        os.remove(crc)
    shutil.rmtree(f"{vocab}/batch=1")
    assert run() == 1
    assert words() == [(1, "a"), (2, "b"), (3, "c")]
    spark.createDataFrame([("d c b",), (None,)], "text string").coalesce(1).write.mode("append").parquet(src)
    assert run() == 1 and run() == 0
    assert words() == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    state = [os.path.join(w, n) for w, _, ns in os.walk(f"{ckpt}/state") for n in ns]
    assert any(n.endswith((".zip", ".changelog")) for n in state)          # files of the RocksDB state store


def test_resume_after_a_crash_between_rows_and_commit(spark, monkeypatch):
    import pytest
    target = shared_path(spark, "t-manifest")
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(30)] + [(None, "null")], "k long, v string").repartition(8)
    real, calls = IO._commit, []

    def lost(*args):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("lost")
        real(*args)
    monkeypatch.setattr(IO, "_commit", lost)
    with pytest.raises(RuntimeError):
        IO.resume_missing(rows, "k", lambda d: d, target)
    monkeypatch.setattr(IO, "_commit", real)
    before = IO.read_resumed(spark, target).count()
    assert 0 < before < spark.read.parquet(target).count() < 31        # the third chunk's rows are there, but do not count
    assert IO.resume_missing(rows, "k", lambda d: d, target) == 31
    got = IO.read_resumed(spark, target)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert IO.resume_missing(rows, "k", lambda d: d, target) == 31      # nothing is left to do


def test_resume_reads_the_source_and_each_chunk_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    source = spark.range(100).withColumnRenamed("id", "k").mapInPandas(count, "k long")
    sizes = []

    def compute(df):
        sizes.append(df.count())
        return df
    target = shared_path(spark, "t-once")
    assert IO.resume_missing(source, "k", compute, target, rows_per_chunk=10) == 100
    assert seen.value == 100 and sum(sizes) == 100 and max(sizes) <= 13 and len(sizes) >= 8


def test_resume_of_an_empty_source(spark):
    target = shared_path(spark, "t-none")
    assert IO.resume_missing(spark.range(0).withColumnRenamed("id", "k"), "k", lambda d: d, target) == 0


def test_arriving_files_grow_in_number_not_in_size(spark, monkeypatch):
    from larder.plans import stream_keys as K
    sizes = {}
    for size in (1, 1 << 30, 6 << 30):
        monkeypatch.setattr(K, "stored_bytes", lambda *a: size)
        sizes[size] = K._arriving(spark, "/nowhere")
    assert sizes[1] == (4, 2)                                  # a small table arrives as before
    assert all(size / files <= K.FILE_BYTES for size, (files, _) in sizes.items())
    assert sizes[6 << 30][1] == K.TRIGGER_FILES
