"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token files.

Every stage takes what its predecessor kept, written as Parquet and read again, and returns
the columns of documents; the last one returns a row for each document of the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, mixing, quality, setjoin, token_files
from lectern.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text passes the base rules and lies in its compression bands.

    Null, empty and short texts go; keys play no part, so rows without one or with a repeated one
    are judged like any other; equal rows are judged alike; very long texts are measured whole; an
    empty table gives an empty one; all columns of docs are returned, whatever their names.
    """
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five words and 0.8: that with the smallest id.

    Null and empty texts and rows without an id are in no group and stay.  Equal rows become one;
    texts that share an id are told apart, and where both would stand for one group, one stays.
    Texts are taken whole; an empty table gives an empty one; all columns are returned.
    """
    return setjoin.one_of_each(docs, link=setjoin.Link(width=5, per_100=80)).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds no benchmark item.

    Null and empty texts stay; rows are told apart by id and text, so missing and repeated ids do
    no harm; equal rows go or stay together; very long texts are searched whole; an empty table on
    either side changes nothing else; all columns are returned.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their fitted rate says.

    Null and empty texts have no tokens and are rated as the empty text; rows without an id have
    no label but a rate; texts that share an id are rated each by itself, equal rows alike; very
    long texts are classified whole; an empty table gives an empty one; all columns are returned.
    """
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; rows without an id come first; rows of one id come
    in the order of their texts, repeated ones as often as they stand; very long texts are encoded
    whole; an empty table gives no rows; other columns are ignored.
    """
    path = token_files.write_files(docs)
    return token_files.read_files(spark, path).withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("target_mixture", target_mixture),
    ("token_output", token_output),
]

#: The set join, the fitted mixture and the range coder can't be written in SQL; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
