"""A corpus made ready for training: stages over ``documents``, each one of the operators of ``mediaplan.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediaplan.llm import decontaminate, digests, langid, minhash, packing
from mediaplan.sources.tables import keep


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (none, or no letter) go."""
    return langid.drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return digests.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with 0.8 of their five-word shingles in common one stays."""
    return minhash.drop_near_copies(docs, percent=80, size=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in sequences that no document shares."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("pack", packed)]

#: Language models and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = keep(docs, f"stage-{name}")
    return docs
