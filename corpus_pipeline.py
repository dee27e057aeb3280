"""A training corpus from ``documents``: filter, de-duplicate, mask, mix, pack.

``STAGES`` are applied in order; each stage's rows are written as Parquet below
the shared folder and read again by the next.  All stages but the last return
the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm.common import renamed, staged, table
from larder.llm.jaccard import jaccard_join
from larder.llm.mixing import mix
from larder.llm.packing import pack_documents
from larder.llm.pii import mask_pii, train_pii
from larder.llm.quality import quality_rules

SHINGLE, PERCENT = 5, 80      # near-duplicates of the corpus: word 5-grams, similarity 0.8 or more


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, cutoffs certified on ``labels``."""
    plain, name = renamed(docs)
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", name["doc_id"])
    out = quality_rules(plain, labels, id_col=name["doc_id"], text_col=name["text"], stratum_col=name["lang"],
                        keep=plain.columns)
    return out.where("q_kept").select(*plain.columns).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    plain, name = renamed(docs)
    out = jaccard_join(plain, id_col=name["doc_id"], text_col=name["text"], shingle=SHINGLE, percent=PERCENT,
                       keep=plain.columns)
    return out.where("j_first").select(*plain.columns).toDF(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    return mask_pii(docs, train_pii(docs), length_col="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to their source's target weight."""
    return mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality rules", quality_stage), ("near-duplicates", near_duplicate_stage), ("personal data", pii_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]
# The trained field and the packing are no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
