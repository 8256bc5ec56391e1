"""Semantic node matching from end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonmill.functions.text import longest_first, predicted_activity
from reasonmill.operators import matching, vocabulary
from reasonmill.registry import Dataset


def requests(
    rows: DataFrame, dataset: Dataset, keys: Sequence[str] = ("sample_id",), relaxed: bool = False,
    tolerance: int = 1,
) -> DataFrame:
    """What a judge has to answer, one row per pair."""
    return matching.judge_requests(
        matching.prepare(rows, dataset.sensors, keys), keys, relaxed, tolerance
    )


def scores(
    rows: DataFrame, dataset: Dataset, verdicts: DataFrame | None = None, keys: Sequence[str] = ("sample_id",),
    relaxed: bool = False, tolerance: int = 1,
) -> DataFrame:
    """Scored samples with their matches; without a verdict table the lexical rule decides."""
    prepared = matching.prepare(rows, dataset.sensors, keys)
    if verdicts is None:
        return matching.score(matching.with_lexical_verdicts(prepared, tolerance=tolerance))
    slim = matching.without_text(prepared, keys)
    return matching.score(matching.with_verdict_table(slim, verdicts, keys, relaxed, tolerance))


def scores_of_datasets(
    rows: DataFrame, verdicts: DataFrame | None = None, keys: Sequence[str] = ("dataset", "sample_id"),
    datasets: Sequence[Dataset] | None = None, relaxed: bool = False, tolerance: int = 1,
) -> DataFrame:
    """``scores`` for rows of several datasets at once, each with the classes and sensors of its own ``dataset``."""
    tagged = vocabulary.with_vocabulary(rows, datasets)
    labelled = tagged.withColumn("predicted_activity", predicted_activity("generated", vocabulary.field("longest")))
    prepared = matching.prepare(labelled, vocabulary.field("names"), keys)
    if verdicts is None:
        return matching.score(matching.with_lexical_verdicts(prepared, tolerance=tolerance))
    slim = matching.without_text(prepared, keys)
    return matching.score(matching.with_verdict_table(slim, verdicts, keys, relaxed, tolerance))


def coded_samples(
    rows: DataFrame, dataset: Dataset, keys: Sequence[str] = ("sample_id",), open_sensors: Sequence[str] | None = None
) -> DataFrame:
    """Samples read once, as integers, for ``sample_scores``; their class is read off the generated text."""
    ordered = longest_first(dataset.classes)
    read = matching.coded(rows, {"": (dataset.sensors, ordered)}, keys, open_sensors=open_sensors)
    return _with_label(read, predicted_activity("rest", ordered))


def coded_samples_of_datasets(
    rows: DataFrame, keys: Sequence[str] = ("dataset", "sample_id"), datasets: Sequence[Dataset] | None = None
) -> DataFrame:
    """``coded_samples`` for rows of several datasets at once, each with the classes and sensors of its own ``dataset``."""
    read = matching.coded(rows, vocabulary.by_name(datasets), keys, F.lower("dataset"))
    tagged = vocabulary.with_vocabulary(read, datasets, ("longest",))
    return _with_label(tagged, predicted_activity("rest", vocabulary.field("longest"))).drop(vocabulary.COLUMN)


def _with_label(read: DataFrame, of_rest: Column) -> DataFrame:
    return read.withColumn("predicted_activity", F.coalesce("label", of_rest)).drop("label", "rest")


def sample_scores(
    coded: DataFrame, verdicts: DataFrame, keys: Sequence[str] = ("sample_id",), relaxed: bool = False, tolerance: int = 1
) -> DataFrame:
    """``scores`` of coded samples: the same scores, without the matches."""
    return matching.with_scores(matching.counted(coded, verdicts, keys, relaxed, tolerance))
