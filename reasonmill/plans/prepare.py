"""Corpus preparation from end to end: attribution files to prompts, answers to corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame

from reasonmill.operators import corpus
from reasonmill.registry import Dataset
from reasonmill.sources.documents import readable


def requests(
    documents: DataFrame, processed: DataFrame | None, dataset: Dataset, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Prompts of the documents without output, and the rejected oversized ones."""
    usable = readable(documents).where("has_id")
    todo = usable if processed is None else corpus.without_processed(usable, processed)
    prompts = corpus.prompts(corpus.smallest_first(todo, limit), dataset.sensors)
    return corpus.split_oversized(prompts)


def corpus_rows(answers: DataFrame, existing: DataFrame | None, model: str, order: str = "seq") -> DataFrame:
    """Training examples of the answers whose key the corpus does not hold yet. Of several answers of a key the first
    in run order counts; ``order`` names the column of ``answers`` that holds it, unique within a key."""
    first = corpus.new_rows(answers, existing, order)
    return corpus.training_examples(corpus.reasoning_records(first.drop(order), model))
