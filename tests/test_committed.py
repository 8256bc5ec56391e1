"""Committed runs: half-written ones stay unseen, counts are checked, a run is committed once."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reasonmill.sources import committed

DDL = "sample_id string, n bigint, split string"


def rows(spark, low, high):
    return spark.range(low, high, 1, 4).select(
        F.col("id").cast("string").alias("sample_id"), F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split")
    )


def seen(spark, path):
    return sorted((r.run, r.n, r.split) for r in committed.committed(spark, path, DDL, "parquet").collect())


def test_a_job_that_dies_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "table")
    assert seen(spark, path) == []
    assert committed.write_run(rows(spark, 0, 10), path, "one", 10, kind="parquet") == 10
    before = seen(spark, path)
    assert len(before) == 10
    broken = rows(spark, 10, 30).withColumn("n", F.when(F.col("n") == 27, F.raise_error(F.lit("dies"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="dies"):
        committed.write_run(broken, path, "two", kind="parquet")
    assert seen(spark, path) == before
    with pytest.raises(committed.CountMismatch):
        committed.write_run(rows(spark, 10, 20), path, "two", 11, kind="parquet")
    assert seen(spark, path) == before
    committed.write_run(rows(spark, 10, 20), path, "two", 10, kind="parquet")
    assert len(seen(spark, path)) == 20
    with pytest.raises(AnalysisException):
        committed.write_run(rows(spark, 40, 50), path, "two", kind="parquet")
    assert [n for _, n, _ in seen(spark, path)] == list(range(20))
    assert sorted((r.run, r.n_rows) for r in committed.manifests(spark, path).collect()) == [("one", 10), ("two", 10)]


def test_answers_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "corpus")
    answers = spark.createDataFrame(
        [(n, "train", str(n // 2), "Standing", 0.5, None, f"answer {n}") for n in range(6)],
        "seq int, split string, sample_id string, activity string, confidence double, mantis_embedding string, answer string",
    )
    assert committed.append_answers(answers.where("seq in (1, 4)"), path, "a", "m") == 2
    assert committed.append_answers(answers, path, "b", "m") == 1
    assert committed.append_answers(answers, path, "c", "m") == 0
    got = {(r.run, r.metadata.sample_id): r.output.split("\n")[1] for r in committed.committed(spark, path).collect()}
    assert got == {("a", "0"): "answer 1", ("a", "2"): "answer 4", ("b", "1"): "answer 2"}
