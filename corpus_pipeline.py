"""From raw documents to packed training bins: every stage works on what the one before kept.

MinHash similarity and best-fit packing have no SQL form, so ORACLE_SQL is None and the tests hold
the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vakanz.llm import best_fit, exact_dedup, mixing, near_dup, quality_rules
from vakanz.llm.common import stage, table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.keep_good(docs, trusted)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once per pass of the mix; every source near its target."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2,048 words: bin, doc_ids, n_words, text. Copies the mix made never share a bin."""
    return best_fit.pack_texts(docs)


STAGES = [
    ("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("source mix", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
