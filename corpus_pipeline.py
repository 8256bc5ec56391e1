"""A training corpus from the documents table: select by quality, drop repeated lines, keep one of near copies, remove
what holds benchmark passages, pack the rest.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
A stage's output is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonmill.llm import decontaminate, jaccard, line_dedup, packing, quality
from reasonmill.llm.blocks import bound_batches
from reasonmill.llm.tables import written
from reasonmill.session import ship_package
from reasonmill.sources.tables import table


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    bound_batches(spark)


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects."""
    _ready(spark)
    return quality.select(docs, table(spark, sf_dir, "labels")).select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of three-line windows. A document that loses all its lines is a copy and goes."""
    _ready(spark)
    out = line_dedup.dedup_lines(docs).where("n_removed < n_lines or n_removed = 0")
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id; rows that repeat an id count as well."""
    _ready(spark)
    return jaccard.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    _ready(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    _ready(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", select_quality), ("line_dedup", drop_lines), ("near_duplicates", keep_one_copy),
    ("decontamination", remove_benchmark), ("packing", pack),
]
ORACLE_SQL = None  # a trained classifier and a tokenizer are not SQL; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
