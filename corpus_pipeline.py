"""Corpus pipeline: filter, deduplicate, decontaminate and encode the documents.

Each stage takes all rows its predecessor kept, works by one operator of
``tallyloom.llm`` and returns the rows it keeps; the last adds the token ids. All
columns of ``documents`` are carried through, whatever else they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from tallyloom.llm.common import Scratch
from tallyloom.llm.queries import table


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the longest stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts one stays."""
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited or not, go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``token_ids``."""
    import public_tokenizers
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", filter_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("decontaminate", drop_benchmark), ("encode", encode)]

# The classifier and the sampled join have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to shared storage and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.write(docs, name)
    return docs
