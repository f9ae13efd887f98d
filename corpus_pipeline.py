"""Corpus pipeline over ``documents``: each stage takes (spark, docs, sf_dir), its result is written and read back.

Quality classification (rejected documents go), exact deduplication, near-deduplication (texts are linked if their SimHash
fingerprints differ in 2 bits or less or if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more, the
smallest doc_id of a group stays), benchmark decontamination (contaminated documents go), best-fit packing. All stages but
the last return the columns of their input. SimHash alone, at a distance that can be searched, misses nearly all copies of
that similarity (README), so both kinds of links count. ``ORACLE_SQL`` is None: the trained classifier and the tokenizer are not SQL; tests compare the
pipeline with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.llm import decontaminate, exact_dedup, near_copies, packing, quality_mil
from segue.llm.common import forget, quoted, stored


def _rows(found: DataFrame, columns: list[str]) -> DataFrame:
    return found.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _rows(quality_mil.classify(docs, labels).where("predicted = 1"), docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.representatives(docs, 5, 4, 5)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _rows(decontaminate.decontaminate(docs, benchmark).where("NOT found.contaminated"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near-dedup", near),
          ("benchmark decontamination", clean), ("best-fit packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        forget(*written)
        written = [docs]
    return docs
