"""Evaluation of generated traces from end to end: one staged parse, then independent aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonmill.functions.text import predicted_activity
from reasonmill.operators import classification, graph, ordering, reports, textquality
from reasonmill.plans.stage import staged
from reasonmill.registry import Dataset

SECTIONS = ("classification", "text", "grounding", "chain", "coverage", "parse", "nodes")


def parsed_rows(rows: DataFrame, dataset: Dataset) -> DataFrame:
    """Evaluation rows with predicted class, graphs and text scores."""
    classes = [c.lower().strip() for c in dataset.classes]
    labelled = rows.withColumn("predicted_activity", predicted_activity("generated", classes))
    return graph.parse_eval_rows(labelled)


def scored_rows(
    rows: DataFrame, dataset: Dataset, keys: Sequence[str], scores: Sequence[str] = textquality.SCORES
) -> DataFrame:
    """What the metrics read of a row: classes, the generated graph, two facts of the reference, and text scores (of rows
    without a reference they mean nothing). Texts and reference graphs are used in this pass and not written."""
    parsed = parsed_rows(rows, dataset).withColumn("ref", F.struct("ref.n_observations", "ref.parse_failed"))
    kept = [c for c in dict.fromkeys((*keys, "sample_id")) if c in rows.columns]
    return textquality.text_scores(
        parsed, [*kept, "gt_activity", "predicted_activity", "has_reference", "gen", "ref"], dataset.terms, columns=scores)


def evaluate(
    rows: DataFrame,
    dataset: Dataset,
    attributions: DataFrame | None = None,
    keys: Sequence[str] = ("sample_id",),
    by: Sequence[str] = (),
    top_k: int = 3,
) -> DataFrame:
    """All metrics as one long table ``(by…, section, metric, value, is_count, ordinal)``.

    Classification uses every row; text and graph metrics use the rows with a reference text. ``by`` splits all of
    it, for example by run, in the same passes.
    """
    parsed = staged(scored_rows(rows, dataset, [*keys, *by]), "parsed")
    labels = classification.with_unknown(dataset.classes)
    referenced = graph.with_reference(parsed)
    parts = [
        reports.long_metrics(classification.summary(parsed, labels, by=by), "classification", by),
        reports.long_metrics(textquality.means(referenced, by=by), "text", by),
        reports.long_metrics(graph.chain_validity(referenced, keys, by), "chain", by),
        reports.long_metrics(graph.coverage(referenced, by=by), "coverage", by),
        reports.long_metrics(graph.parse_success(referenced, by), "parse", by),
        reports.long_metrics(
            graph.node_rates(referenced, dataset.classes, dataset.sensors, by), "nodes", by
        ),
    ]
    if attributions is not None:
        samples = graph.grounding_samples(referenced, attributions, [*keys, *by], top_k)
        parts.append(reports.long_metrics(graph.grounding(samples, by), "grounding", by))
    return reduce(DataFrame.unionByName, parts)


REPORT = ("config", "classification", "text", "conditioned", "graph", "classes")


def report(
    rows: DataFrame,
    dataset: Dataset,
    config: Mapping[str, str],
    attributions: DataFrame | None = None,
    keys: Sequence[str] = ("sample_id",),
    top_k: int = 3,
    scores: Sequence[str] = textquality.SCORES,
) -> DataFrame:
    """The whole report of a run as lines ``(section_ordinal, section, ordinal, cells)``: its configuration and sizes,
    classification, text scores, those of correct and incorrect samples, graph metrics, and classes, ``unknown`` last.

    ``cells`` are texts with four decimals, N/A for what is undefined. Text scores of all, of correct and of incorrect
    samples come from one pass; ``scores`` may leave out the costly ones.
    """
    parsed = staged(scored_rows(rows, dataset, keys, scores), "parsed")
    referenced = graph.with_reference(parsed)
    labels = classification.with_unknown(dataset.classes)
    sizes = textquality.condition_counts(parsed).select(
        F.col("n_total_cls").alias("n_cls_samples"), F.col("n_total_text_gt").alias("n_text_samples")
    )
    scoped = staged(textquality.scoped_means(referenced, scores, classes=False), "scoped")
    graphs = [
        graph.parse_success(referenced).select("ref_psr"), graph.chain_validity(referenced, keys), graph.coverage(referenced),
    ]
    if attributions is not None:
        samples = graph.grounding_samples(referenced, attributions, keys, top_k)
        graphs.insert(1, graph.grounding(samples).select("gs_f1", "gs_precision", "gs_recall", F.col("n_scored").alias("gs_n_scored")))
    whole = scoped.where("scope = 'all'").select(*scores)
    if_any = rows.sparkSession.range(1).select(F.lit(0).alias("_"))
    sections = {
        "config": [sizes.select(*[F.lit(v).alias(k) for k, v in config.items()], "n_cls_samples", "n_text_samples")],
        "classification": [classification.summary(parsed, labels).select("accuracy", "macro_precision", "macro_recall", "macro_f1")],
        "text": [if_any.join(whole, F.lit(True), "left").select(*scores)],  # one row each
        "graph": graphs,
    }
    lines = []
    for name, tables in sections.items():
        for part, wide in enumerate(tables):
            found = reports.value_lines(wide, wide.columns).withColumn("ordinal", F.col("ordinal") + 100 * part)
            lines.append(found.withColumn("section", F.lit(name)))
    lines.append(reports.condition_lines(scoped, scores).withColumn("section", F.lit("conditioned")))
    lines.append(reports.class_lines(classification.class_report(parsed, labels)).withColumn("section", F.lit("classes")))
    order = F.array_position(F.array(*[F.lit(s) for s in REPORT]), F.col("section"))
    return reduce(DataFrame.unionByName, [x.select("section", F.col("ordinal").cast("int").alias("ordinal"), "cells") for x in lines]).select(
        order.cast("int").alias("section_ordinal"), "section", "ordinal", "cells"
    )


def qualitative_table(rows: DataFrame, dataset: Dataset, order: Sequence[str], n: int = 50) -> DataFrame:
    """Every n-th row in order and the last one, as ``sample_table`` shows them. Rows are placed by their keys before any
    text is parsed."""
    placed = ordering.with_position(rows.select(*order), order, "pos", "_total")
    chosen = ordering.every_nth(placed, n, "pos", "_total").drop("_total")
    return sample_table(parsed_rows(rows.join(chosen, list(order)), dataset), positioned=True)


def sample_table(parsed: DataFrame, positioned: bool = False) -> DataFrame:
    """Rows of the qualitative table: ids, classes, node counts and the beginning of the text."""
    ok = lambda c: F.when(c, "Y").otherwise("N")
    return parsed.select(
        *(["pos"] if positioned else []),
        "sample_id", "gt_activity", "predicted_activity",
        ok(textquality.is_correct()).alias("ok"),
        F.col("gen.n_observations").alias("n_obs"),
        F.col("gen.n_inferences").alias("n_inf"),
        ok(~F.col("gen.parse_failed")).alias("parsed"),
        F.substring("generated", 1, 400).alias("snippet"),
    )
