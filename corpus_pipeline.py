"""From raw documents to token ids, in stages; each is written as Parquet and read again by the next.

STAGES: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. An empty table passes through every stage; rows with null texts fail the first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetmill.llm import byte_bpe, decontaminate, jaccard_join, quality_rules, substring_dedup
from fleetmill.llm.common import shared_dir, table
from fleetmill.llm.queries import SUBSTRING_SIZES, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles link at a similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, k=5, num=4, den=5)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier one has."""
    return substring_dedup.removed(docs, **SUBSTRING_SIZES)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with the byte offset of each, and whether they decode to the text."""
    ids = byte_bpe.round_trip(docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)), vocabulary())
    return ids.withColumn("round_trip", F.sha2("decoded", 256) == F.col("text_sha256")).withColumn(
        "n_tokens", F.size("ids").cast("long")).drop("decoded", "text_sha256")


STAGES = [
    ("quality_rules", quality), ("jaccard_join", near_duplicates), ("substring_dedup", substrings),
    ("decontaminate", benchmark_free), ("byte_bpe", encoded),
]

#: The last stage's merges are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
