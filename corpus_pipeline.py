"""The corpus pipeline: five of the training-data operators, one behind the other.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns the columns of documents; the last adds ids and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stagewise.llm.bpe import bpe_encode
from stagewise.llm.common import checkpointed, table
from stagewise.llm.exact_dedup import one_of_each as one_of_equal
from stagewise.llm.mixing import mixed_documents
from stagewise.llm.near_dedup import one_of_each
from stagewise.llm.quality import score_quality, train
from stagewise.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents, rejects go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts stays, of rows that repeat a doc_id, too."""
    return one_of_equal(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix of sources takes."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the ids of every text, and the text decoded from them."""
    return bpe_encode(docs, tokenizer_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mixing), ("bpe", encoding)]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
