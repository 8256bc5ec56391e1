"""Tables of committed runs: a run's rows are seen when its manifest is there, and not before.

Layout below a table's path: ``data/run=…/attempt=…`` holds rows, ``manifests/run=…`` one small record per committed run,
written last. A job that dies leaves an attempt without a manifest, which no reader sees; the next attempt of the run
has a folder of its own. A run is committed once: a second manifest of it is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonmill import schema
from reasonmill.operators import corpus
from reasonmill.plans.prepare import corpus_rows
from reasonmill.sources.documents import path_exists

_MANIFEST = "attempt string, n_rows bigint, format string"
CORPUS = f"{schema.TRAINING_EXAMPLE}, split string"


class CountMismatch(ValueError):
    """An attempt holds another number of rows than was expected; it stays uncommitted."""


def write_attempt(rows: DataFrame, path: str, run: str, by: Sequence[str] = ("split",), kind: str = "json") -> str:
    """Writes the rows of a run to a new attempt, one folder per value of ``by``, and returns the attempt."""
    attempt = uuid.uuid4().hex
    folder = f"{path.rstrip('/')}/data/run={run}/attempt={attempt}"
    rows.write.format(kind).partitionBy(*by).options(ignoreNullFields="false").save(folder)
    return attempt


def commit(spark: SparkSession, path: str, run: str, attempt: str, expected: int | None = None, kind: str = "json") -> int:
    """Makes an attempt the content of its run, if it holds the expected number of rows."""
    folder = f"{path.rstrip('/')}/data/run={run}/attempt={attempt}"
    # Without a schema of its own a text format would be inferred; only the number of rows counts here.
    reader = spark.read.format(kind)
    n = (reader.schema(CORPUS) if kind == "json" else reader).load(folder).count()
    if expected is not None and n != expected:
        raise CountMismatch(f"run {run}: {n} rows written, {expected} expected")
    manifest = spark.createDataFrame([(attempt, n, kind)], _MANIFEST).coalesce(1)
    manifest.write.mode("error").json(f"{path.rstrip('/')}/manifests/run={run}")
    return n


def write_run(
    rows: DataFrame, path: str, run: str, expected: int | None = None, by: Sequence[str] = ("split",), kind: str = "json"
) -> int:
    """An attempt and its commit; returns the number of rows."""
    return commit(rows.sparkSession, path, run, write_attempt(rows, path, run, by, kind), expected, kind)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """(run, attempt, n_rows, format) of the committed runs."""
    ddl = f"{_MANIFEST}, run string"
    folder = f"{path.rstrip('/')}/manifests"
    return spark.read.schema(ddl).json(folder) if path_exists(spark, folder) else spark.createDataFrame([], ddl)


def committed(spark: SparkSession, path: str, ddl: str = CORPUS, kind: str = "json") -> DataFrame:
    """The rows of all committed runs, with their ``run``. Runs are partitions, so a semi join with the manifests prunes
    the files of attempts that were not committed."""
    whole = f"{ddl}, run string, attempt string"
    folder = f"{path.rstrip('/')}/data"
    if not path_exists(spark, folder):
        return spark.createDataFrame([], whole).drop("attempt")
    rows = spark.read.schema(whole).format(kind).load(folder)
    return rows.join(manifests(spark, path).select("run", "attempt"), ["run", "attempt"], "left_semi").drop("attempt")


def append_answers(answers: DataFrame, path: str, run: str, model: str, order: str = "seq") -> int:
    """One run of the training corpus: examples of the answers whose key no committed run holds, the first of each key."""
    spark = answers.sparkSession
    existing = committed(spark, path).select("split", F.col("metadata.sample_id").alias("sample_id")).select(*corpus.KEY)
    return write_run(corpus_rows(answers, existing, model, order).drop("sample_id"), path, run)


def append_records(records: DataFrame, path: str, run: str, expected: int | None = None) -> int:
    """One run of reasoning records, by split."""
    return write_run(records, path, run, expected, kind="parquet")
