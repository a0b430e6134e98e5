"""A corpus pipeline from the training-data operators: each stage's rows are written and read again as the next one's."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import ngram_join, packing, quality, toxicity, winnow
from millrace.llm.common import Scratch, few_rows, table

#: No stage order in SQL: perplexity, compression lengths and token ids have no SQL form.
ORACLE_SQL = None


def bounded(stage):
    """The stage, with Arrow batches of few rows: its rows hold whole texts."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        few_rows(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


@bounded
def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


@bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.remove_leaked(docs, table(spark, sf_dir, "benchmark"))


@bounded
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read back."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir)) if i + 1 < len(STAGES) else stage(spark, docs, sf_dir)
        if before is not None and i + 1 < len(STAGES):
            scratch.free(before)
        before = docs
    return docs
