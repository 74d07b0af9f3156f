"""A corpus from documents to packed training windows: each stage's result is written and read again as the next one's input.

All stages but the last return rows of ``docs`` as they came, with all their columns, whatever these are called and of whatever
type. No stage fails on an empty table, which it leaves empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetflow.llm.common import write_table
from facetflow.llm.jaccard_join import without_similar
from facetflow.llm.mixing import mixed_documents
from facetflow.llm.packing import packed_digests
from facetflow.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go.

    A null or empty text has no words and is judged by the chain's intercepts, a row without doc_id by its text; repeated rows are
    judged alike.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more, the one with the smallest doc_id stays.

    Rows without doc_id, and null, empty and blank texts, are like nothing and stay; of rows that repeat, one stays.
    """
    return without_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it: rows go or repeat.

    A null source is a source of its own; texts without words, null ones included, have size 0 and are drawn like others of their source
    as far as its target asks for copies, so that such rows may go; repeated rows are documents of their own.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full windows.

    A null or empty text is the end token alone; repeated rows are documents of their own, pieces of rows without doc_id have none.
    """
    return packed_digests(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can train no classifier chain and draws no pivotal rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
