"""From raw documents to packed training sequences, in five stages.

Language ID drops documents of no known language, exact dedup keeps one of equal texts, the
n-gram Jaccard join (five words, similarity 0.8) keeps one document of each component, mixing
repeats or leaves out documents until every source is near its share, and packing cuts what is
left into sequences. All stages but the last return the columns of documents. Each copy that the
mix takes is a row of its own; the document at which a source's budget ends is taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import exact_dedup, language_id, mixing, ngram_join, packing
from ferrule.llm.common import ROW, keep_rows, table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.confident(docs)


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_rows(docs, exact_dedup.exact_dedup(docs).select(*ROW, "kept"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, k=5, least=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", one_of_equal_texts),
    ("near_duplicates", one_of_near_copies),
    ("source_mix", source_mix),
    ("packing", packed),
]

#: Language ID, the mix's cuts and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
