"""From raw documents to packed training sequences: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the last return
the columns of documents. Its result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import common, ngram_join, packing, quality, toxicity
from quillmark.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither their own rules nor their host's verdict reject."""
    return quality.keep_good(docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold; learned from the labels of those that came here."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"), vocabulary=vocabulary("word_bpe_49k.json"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group."""
    return ngram_join.dedup_near(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 0, 2048)


STAGES = [("quality rules", quality_rules), ("toxicity", without_toxic), ("n-gram Jaccard join", one_of_each_group), ("best-fit packing", packed)]

#: Learned scores and packing can't be said in SQL; the test runs a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
