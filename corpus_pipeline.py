"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage works on all rows that its predecessor kept, and all but the last return the columns of
``documents``.  Classifier and rules learn from the ``labels`` table of the same folder.

Where a stage meets nulls, empty or very long texts, repeated rows, empty tables or extra columns,
the operator it calls defines the result; columns of the input are carried unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from starledger.llm import exact_dedup, near_dedup, packing, quality_rules, toxicity
from starledger.llm.common import table
from starledger.session import scratch_path, tune

CAPACITY = 2048
END_ID = 0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))  # the held-out fold teaches nothing here either
    return toxicity.clean_rows(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base limits or a learned rule reject go."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.passing(docs, rules)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.unique_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates, five-word shingles that overlap by 0.8 or more, one document stays.

    That with the smallest id.
    """
    return near_dedup.unique_rows(docs, n_words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in as few sequences as found: one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), CAPACITY, END_ID)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_low_quality), ("exact dedup", drop_copies),
          ("near dedup", drop_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole of ``documents``."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = scratch_path(spark, name.replace(" ", "-"))
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs


#: Learned verdicts and scores are not SQL: the tests check the stages against brute force.
ORACLE_SQL = None
