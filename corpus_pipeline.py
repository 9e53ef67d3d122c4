"""The corpus pipeline: quality rules, near duplicates, benchmark passages, mixing, token files.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a table, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents. Every stage takes an
empty table to an empty one and leaves further columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, ngram_join, quality, token_files
from tessera.llm.store import saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules reject go: null and empty texts do, equal rows share their fate, a null source is a host."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Of equal ids one row stays; a row without an id and a text without words are nobody's duplicate.
    """
    return ngram_join.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go, with every row of their id; a null text has no passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or thinned out at the rates that meet the target weights; likely good ones stay at least once.

    A null text has no tokens and the prior's rate; equal ids with equal posteriors are taken equally often.
    """
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_first=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and from them doc_id, start, n_tokens, ids_crc32; a null text has the end id alone, equal ids go by their texts."""
    return token_files.encoded(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality rules", quality_rules), ("n-gram join", near_duplicates), ("decontamination", benchmark_passages), ("mixing", mix), ("token files", tokens)]

#: SQL cannot express the classifier of the mixing stage; tests hold every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, "stage")
    return docs
