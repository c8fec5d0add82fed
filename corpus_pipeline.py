"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefork.llm.decontamination import decontaminate
from tracefork.llm.ngram_join import one_of_each
from tracefork.llm.packing import pack
from tracefork.llm.quality import good_documents
from tracefork.llm.suffix_dedup import remove_repeats
from tracefork.llm.tables import settle, table


def recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; where it counts characters, the count is of the text as it is now."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return good_documents(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the smallest id stays."""
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated bytes go from the texts; a document of which nothing but white space is left goes."""
    left = remove_repeats(docs)
    removed = left.columns[-3]  # bytes removed
    return recounted(left.where((F.col(removed) == 0) | F.col("text").rlike(r"\S")), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts; a document that is mostly such passages goes."""
    return recounted(decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return pack(docs, added=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what is between two stages is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the groups of similar documents nor the packing can be said in SQL; tests compare with plain versions.
ORACLE_SQL = None
