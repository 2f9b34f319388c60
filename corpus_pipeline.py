"""Documents to packed training sequences: quality rules, exact dedup, near-dedup, source mixing, packing.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents; the last returns
packed pieces, with the token ids digested to a CRC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperstrata.llm import common, exact_dedup, mixing, near_dedup, packing, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified cutoffs reject go."""
    return quality.keep_good(docs, common.labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id stays."""
    return near_dedup.near_dedup(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's rate says."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048, a row per piece."""
    return packing.digest(packing.pack(docs))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("packing", pack)]

#: SQL can't express tokenisation and packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again by the next."""
    docs = common.documents(spark, sf_dir)
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stage(docs)
    return docs
