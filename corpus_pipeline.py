"""Cleaning of a corpus for training, stage by stage: ``run(spark, sf_dir)`` applies STAGES to documents.

Each stage takes what the stage before kept, as a Parquet table. The stages before the last
return the columns of documents; the last returns the packed pieces of every document left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import line_dedup, minhash, packing, quality, toxicity
from tallyspark.llm.common import SPACES, table
from tallyspark.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects (null and empty texts go)."""
    return quality.keep_good(docs)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows of documents, doesn't call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir), table(spark, sf_dir, "labels"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut out; a document of which
    no word is left goes."""
    return line_dedup.line_dedup(docs).where(F.btrim(F.col("text"), F.lit(SPACES)) != "")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return minhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, packed into sequences."""
    return packing.pack_documents(docs).drop("row")


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_filter),
    ("line_dedup", repeated_passages),
    ("minhash_near_dedup", near_duplicates),
    ("best_fit_packing", packed),
]

#: Training a classifier, aligning lines, signatures and tokenising aren't SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
