"""The ``opN_*`` queries: each operator over its whole table, as a digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import (chat, embedding_dedup, jaccard, language, mixing, packing, pii, prefix_trie, quality,
                        quality_classifier, suffix_dedup, token_counts, whitening)
from larder.llm.common import table

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-target examples of all conversations, read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    examples = chat.format_examples(turns.unionByName(extra))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length"))
    per = examples.groupBy("conv_id").agg(
        F.max("example").alias("last"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars"),
        F.collect_list(F.struct("example", loss.alias("loss"))).alias("losses"),
        F.max_by("formatted", "example").alias("whole"))
    per = per.select("conv_id", "formatted_chars", F.explode(F.array(F.struct(
        chat.parse_turns(F.col("whole")).alias("turns"),
        F.array_join(F.transform(F.sort_array("losses"), lambda x: x["loss"]), "").alias("loss")))).alias("x"))
    rendered = F.array_join(F.transform("x.turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"],
                                                                     F.lit("\n"))), "")
    return per.select("conv_id", F.size("x.turns").cast("long").alias("n_turns"),
                      F.sha2(rendered.cast("binary"), 256).alias("turns_sha256"),
                      F.length("x.loss").cast("long").alias("loss_chars"),
                      F.sha2(F.col("x.loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


@query
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    out = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").alias("source_size"),
                      F.col("m_target").alias("target"), (F.col("m_copies") * F.col("m_size")).alias("taken"))


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, cutoffs certified on ``labels``."""
    out = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.col("q_n_words").alias("n_words"), F.col("q_word_chars").alias("word_chars"),
                      F.col("q_n_symbols").alias("n_symbols"), F.col("q_n_dup_lines").alias("n_dup_lines"),
                      F.col("q_n_repeat_words").alias("n_repeat_words"),
                      F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


@query
def op5_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, boundary tokens to the section with most of them."""
    return token_counts.section_token_counts(table(spark, sf_dir, "documents"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity class of every document."""
    out = jaccard.jaccard_join(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("j_n").alias("n_shingles"), F.col("j_component").alias("component_id"))


@query
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, class and verdict of every vector at cosine 0.9."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    net = language.train_language_id(docs.where(~held_out))
    out = language.predict_language(docs, net)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pii_digest(docs, pii.train_pii(docs))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that are left once repeated 100-byte strings are removed."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie over the rebuilt conversations."""
    turns, ids = prefix_trie.rebuild(prefix_trie.sequence_turns(table(spark, sf_dir, "conversations")))
    nodes, ends = prefix_trie.prefix_trie(turns, ids)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(prefix_trie.ends_digest(ends), ["node", "depth"], "left").select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("saved_bytes").alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable vector on the leading sixteen components."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit_whitening(vectors)
    rows = whitening.whiten(vectors, model)
    explained = F.array(*[F.lit(x).cast("double") for x in model.explained]) if model else F.array().cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n if model else None).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        F.try_element_at(explained, F.col("place") + 1).alias("explained"),
        F.lit(model.identity_error if model else None).cast("double").alias("identity_error"))


@query
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = quality_classifier.held_out(F.col("doc_id"), 5)
    model = quality_classifier.train_quality(docs.where(~held_out), labels.where(~held_out))
    scored = quality_classifier.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))
