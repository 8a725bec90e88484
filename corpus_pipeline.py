"""The corpus pipeline: from raw documents to packed training sequences in five stages.

Every stage is a function of (spark, docs, sf_dir) and works on all that the stage before it kept. The
models of the first two stages are fitted on the labels of sf_dir and the documents they are given. All
but the last return the columns of documents. Stages bound the session's Arrow batches, which hold whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetsift.llm.common import table
from fleetsift.llm.ngram_join import Settings, similarity_components
from fleetsift.llm.packing import pack_documents
from fleetsift.llm.quality_classifier import keep_good, train_quality
from fleetsift.llm.registered import tokenizer_file
from fleetsift.llm.secrets import redact_secrets
from fleetsift.llm.toxicity import keep_clean, train_toxicity
from fleetsift.session import bound_batches, cut_lineage

#: Near duplicates share 80 percent or more of their five-word shingles.
NEAR = Settings(words=5, percent=80)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    bound_batches(spark)
    return keep_clean(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier calls good."""
    bound_batches(spark)
    return keep_good(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest id; of rows with that
    id, one. Rows with a null id cannot be told apart and stay."""
    bound_batches(spark)
    first = similarity_components(docs, NEAR).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret masked; n_chars follows the text."""
    bound_batches(spark)
    masked = redact_secrets(docs)
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    bound_batches(spark)
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("quality classifier", quality_classifier), ("near duplicates", near_duplicates),
          ("secret scans", secret_scans), ("best-fit packing", best_fit_packing)]

#: Two trained models and a tokenizer decide: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = cut_lineage(docs)
    return docs
