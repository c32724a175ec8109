"""From raw documents to token ids: each stage works on all that the one before it kept.

All stages take null values in any column, empty and very long texts, ties, repeated rows, further columns of any name and
empty tables; what they do with them is said below. Without rows in, there are none out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from utterlake.llm import bpe, exact_dedup, mixing, quality, simhash
from utterlake.runtime import discard, materialize, prepare, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It is fitted on the labelled rows among docs.

    Each row's own text decides, null as an empty one; repeated rows share a fate. Without labels all scores are equal.
    """
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, that of the largest doc_id, a null one last; null texts are empty ones, repeated rows come once."""
    prepare(spark)
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id, a null one last; null and empty texts are one group."""
    prepare(spark)
    return simhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that the tokens of sources, languages and topics follow their targets; those of cells that must grow come several times.

    Null sources and languages count as values of their own, a null doc_id draws by its text.
    """
    prepare(spark)
    return mixing.sample_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token digests of every document that is left, once for each time that it comes; null texts are empty."""
    prepare(spark)
    return bpe.encode_decode(docs, outputs=bpe.DIGESTS)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("bpe", token_stage)]

#: SQL cannot state the trees and the 64-bit hashes; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again for the next one."""
    docs = before = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
            discard(before)
        before = docs
    return docs
