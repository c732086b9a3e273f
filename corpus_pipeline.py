"""A corpus pipeline over ``documents``: drop toxic documents, exact and near copies, mix the
sources to target weights, and pack what is left into training sequences.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over what its predecessor kept.
``run`` writes each stage as Parquet to the folder that all executors share and rereads it
as the next one's input. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import best_fit_packing, exact_dedup, ngram_join, source_mixing, toxicity_chain
from lamella.llm.common import documents
from lamella.llm.tokenise import vocabulary
from lamella.plans.spool import scratch, spool_path

#: Nine tenths of the tokens, each document once; the weights are the operator's.
MIXTURE = source_mixing.Mixture(budget=(9, 10), max_epochs=1)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go."""
    return toxicity_chain.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the smallest doc_id stays."""
    return ngram_join.drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's token-prefix up to its share of the budget stays."""
    return source_mixing.select_documents(docs, MIXTURE)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return best_fit_packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("ngram_join", near), ("source_mixing", mixing), ("best_fit_packing", packing)]

#: The classifier and the tokenizer have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has spooled is deleted once its result is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = spool_path(spark, f"stage-{name}")
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
