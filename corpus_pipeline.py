"""A training-data pipeline over ``documents``: quality classifier, quality
rules, SimHash near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept and returns the columns of ``documents``; the last returns
one row per packed piece. ``run`` writes each stage's rows as Parquet to the
shared scratch folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridcast.llm import line_clean, line_quality, packing, pii, simhash
from gridcast.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_quality.filter_documents(docs, line_quality.train(docs, labels))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep."""
    return line_clean.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: three-word shingles, at
    most two bits apart."""
    return simhash.drop_near_duplicates(docs, radius=2, width=3)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans give way to their kind; n_chars follows."""
    return pii.mask_pii(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules),
          ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("pack", pack)]

#: SQL cannot express the models; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
