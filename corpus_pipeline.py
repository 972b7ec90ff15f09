"""The corpus pipeline: each stage gets what the one before it kept, written as Parquet and read again."""

from pyspark.sql import DataFrame, SparkSession

from quern.llm.best_fit_packing import packed_sequences
from quern.llm.exact_dedup import exact_dedup
from quern.llm.language_id import accepted
from quern.llm.queries import tokenizer_path
from quern.llm.simhash_dedup import simhash_dedup
from quern.llm.source_mixing import mix
from quern.plans.staging import settle
from quern.sources.tables import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null texts, texts without a letter, and those scored below the threshold.

    Each row is judged by its own text, whatever its id; very long texts count
    whole; an empty table stays empty; other columns pass through.
    """
    return accepted(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the largest id, of equal ids any one; null ids go last.

    Null and empty texts are equal; an empty table stays empty; other columns pass through.
    """
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id, of equal ids any one; null ids go last.

    Texts without words link like others; an empty table stays empty; other columns pass through.
    """
    return simhash_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each source as much as the target weights allow.

    Null languages and sources are leaves of their own; rows of a leaf that
    share an id are taken or left together; an empty table stays empty; other
    columns pass through.
    """
    return mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document.

    Null texts are empty documents; very long ones are cut, not shortened;
    rows that repeat and null ids are documents of their own; an empty table
    gives no sequence.
    """
    return packed_sequences(docs, tokenizer_path(), added_tokens=True)


STAGES = [("language ID", language), ("exact dedup", copies), ("SimHash near-dedup", near_copies), ("mixing sources", mixture), ("best-fit packing", sequences)]

#: Neither the language network, nor XXH64, nor the tokenizer is SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of all documents that every stage kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
