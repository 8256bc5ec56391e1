"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonmill.llm import (
    conversations, decontaminate, fim, jaccard, langid, licenses, line_dedup, lm_score, neighbours, oracles, packing, pii,
    quality, repeats,
)
from reasonmill.llm.blocks import bound_batches
from reasonmill.llm.tables import written
from reasonmill.session import ship_package
from reasonmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scans(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents"))


def op2_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the classifier selects, with their expected grade and tail probability."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return quality.select(docs, table(spark, d, "labels")).drop("text")


def op3_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = langid.fit(docs)
    texts = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.identify(texts, model).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")


def op4_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def op5_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return lm_score.score(docs, lm_score.fit(docs, table(spark, d, "labels")))


def op6_approximate_nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.search(table(spark, d, "embeddings"))


def op7_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op8_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.join(table(spark, d, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, d: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, d, "documents"))


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, d, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op11_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, d, "documents")))


def op12_personal_data(spark: SparkSession, d: str) -> DataFrame:
    return pii.digests(pii.detect(table(spark, d, "documents")))


def op13_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    rows = conversations.damaged(turns)
    return conversations.audited(turns, rows, written(conversations.plan(rows), "repairs"))


ALL: tuple[Query, ...] = (
    op1_license_scans, op2_quality_classifier, op3_language_id, op4_best_fit_packing,
    op5_lm_scoring, op6_approximate_nearest_neighbours, op7_benchmark_decontamination,
    op8_ngram_jaccard_join, op9_suffix_array_dedup, op10_line_dedup,
    op11_fill_in_middle, op12_personal_data, op13_conversation_repair,
)


def _ready(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {query.__name__: _ready(query) for query in ALL} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
