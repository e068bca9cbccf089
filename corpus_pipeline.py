"""Corpus pipeline: quality, near duplicates, secrets, packing. Each stage reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradus.llm import importance, jaccard, packing, secret_scan
from gradus.llm.common import Scratch, few
from gradus.llm.queries import WORDS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go."""
    return importance.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_columns=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by 0.8 of their five-word shingles, the one with the smallest doc_id.

    Documents without words, and rows without doc_id, are linked with nothing and stay; rows that repeat a doc_id stay together.
    """
    classes = jaccard.jaccard_components(docs, n=5, num=80, den=100)
    gone = Scratch(spark, "gone").save(classes.where("component_id <> doc_id").select("doc_id").distinct(), "ids")
    return docs.join(few(gone), "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked."""
    return secret_scan.scrub(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packing.pack(docs, WORDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", sequences)]
#: Learned decisions, components and packing aren't expressible in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and reread as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        df = scratch.save(stage(spark, df, sf_dir), name)
    return STAGES[-1][1](spark, df, sf_dir)
