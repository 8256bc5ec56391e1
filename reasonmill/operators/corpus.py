"""Trace-corpus preparation: file names, evidence, prompts, quality flags, records, dedup, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonmill.functions.expr import defined, share
from reasonmill.functions.parse import corpus_graph
from reasonmill.functions.text import (
    ANSWER_TOKEN_LIMIT, PROMPT_TOKEN_LIMIT, SHORT_TOKENS, blank_token_count, clean_answer, is_blank,
    is_refusal, leaks_number,
)
from reasonmill.functions.vocab import importance_tier, vocabulary_sensor, window_label
from reasonmill.operators import ordering
from reasonmill.registry import CORPUS_SENSOR_ALIASES
from reasonmill.schema import as_column

MAX_REGIONS = 10
KEY = ("split", "sample_id")


# ---- identity ----------------------------------------------------------------------------------------------


def file_identity(name: Column | str) -> Column:
    """``struct<split, sample_id, has_id>`` from a file name; the id loses its leading zeros."""
    stem = F.regexp_replace(as_column(name), r"(?:\A.*/)|(?:(?<=[^/])\.[^./]*\z)", "")
    digits = F.regexp_extract(stem, r"_s(\p{Nd}+)\z", 1)
    split = F.regexp_extract(stem, r"\A(train|test)_", 1)
    plain = F.regexp_replace(digits, r"\A0+(?=\p{Nd})", "")
    return F.struct(
        F.when(split != "", split).otherwise("unknown").alias("split"),
        F.when(digits != "", plain).otherwise("0").alias("sample_id"),
        (digits != "").alias("has_id"),
    )


def with_identity(files: DataFrame, name: str = "file_name") -> DataFrame:
    return files.withColumn("_i", file_identity(name)).select("*", "_i.*").drop("_i")


def without_processed(sources: DataFrame, processed: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Sources whose key has no output yet."""
    return sources.join(processed.select(*keys).distinct(), list(keys), "left_anti")


def smallest_first(files: DataFrame, limit: int | None) -> DataFrame:
    """The ``limit`` smallest files, which mixes the classes of a trial run; all files without a limit."""
    return files if not limit else files.orderBy("file_size", "file_name").limit(limit)


# ---- evidence and prompts ----------------------------------------------------------------------------------


def ranked_evidence(regions: Column | str, limit: int = MAX_REGIONS) -> Column:
    """First regions in list order with vocabulary sensor, window label and tier by rank."""
    return F.transform(
        F.slice(as_column(regions), 1, limit),
        lambda r, rank: F.struct(
            (rank + 1).alias("rank"),
            r["sensor"].alias("raw_sensor"),
            vocabulary_sensor(r["sensor"], CORPUS_SENSOR_ALIASES).alias("sensor"),
            r["start_t"].alias("start_t"),
            r["end_t"].alias("end_t"),
            r["length"].alias("length"),
            r["mean_importance"].alias("mean_importance"),
            r["max_importance"].alias("max_importance"),
            r["peak_timestep"].alias("peak_timestep"),
            window_label(r["start_t"], r["end_t"]).alias("window"),
            importance_tier(rank).alias("tier"),
        ),
    )


def evidence_text(evidence: Column) -> Column:
    lines = F.transform(
        evidence,
        lambda e: F.format_string(
            "%d. %s (raw name %s), steps %d to %d, length %d: mean %.4f, max %.4f, peak at %d, "
            "window %s, tier %s",
            e["rank"], e["sensor"], e["raw_sensor"], e["start_t"], e["end_t"], e["length"],
            e["mean_importance"], e["max_importance"], e["peak_timestep"], e["window"], e["tier"],
        ),
    )
    none = F.lit("(No region lies above the threshold.)")
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(none)


def phase_text(phases: Column) -> Column:
    return F.array_join(
        F.transform(phases, lambda p: F.format_string("Phase %s: %.4f", p["phase"], p["importance"])), "\n"
    )


PROMPT = """Write a structured reasoning trace for a window of wearable sensor data.

Sample %s, predicted activity %s, confidence %.4f, attribution threshold %.4f

Evidence, most important first:
%s

Mean importance per phase:
%s

Write %d observations, one per line of evidence, then two to four inferences that cite them, then one synthesis
that cites the inferences, then the activity. Use these blocks and nothing else:

[OBSERVATION | id: O1]
sensor: one of %s
temporal: one of early, early_to_mid, mid, mid_to_late, late, full_window
pattern: what the signal does, in plain words and without numbers
confidence: the tier given in the evidence

[INFERENCE | id: I1]
based_on: O1, O2
inference: what these observations imply
confidence: high, moderate or low

[SYNTHESIS]
based_on: I1, I2
a short paragraph without numbers

[ACTIVITY]: %s
"""


def prompts(documents: DataFrame, sensors: Sequence[str], template: str = PROMPT) -> DataFrame:
    """One prompt per attribution document; the template takes the nine values in this order."""
    prepared = documents.withColumn("evidence", ranked_evidence("high_attribution_regions"))
    return prepared.withColumn(
        "prompt",
        F.format_string(
            template,
            F.col("sample_idx"),
            F.col("activity"),
            F.col("confidence"),
            F.coalesce("attribution_threshold_p90", F.lit(0.0)),
            evidence_text(F.col("evidence")),
            phase_text(F.col("temporal_phase_importance")),
            F.size("evidence"),
            F.lit(", ".join(sorted(sensors))),
            F.col("activity"),
        ),
    )


def split_oversized(
    requests: DataFrame, tokens: Column | None = None, limit: int = PROMPT_TOKEN_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """Prompts that fit, and the reject log of the others."""
    counted = requests.withColumn(
        "prompt_tokens", blank_token_count("prompt") if tokens is None else tokens
    )
    rejects = counted.where(F.col("prompt_tokens") > limit).select(*KEY, "prompt_tokens")
    return counted.where(F.col("prompt_tokens") <= limit), rejects


# ---- answers -----------------------------------------------------------------------------------------------


def quality_flags(answers: DataFrame, text: str = "answer", tokens: Column | None = None) -> DataFrame:
    """Flags of each answer. Token counts come from the generator; blank-separated words stand in for them."""
    count = blank_token_count(text) if tokens is None else tokens
    flagged = answers.withColumns(
        {
            "n_tokens": count.cast("bigint"),
            "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("bigint"),
            "leak": leaks_number(text),
            "is_empty": is_blank(text),
            "refusal": is_refusal(text),
        }
    )
    short = F.col("n_tokens") < SHORT_TOKENS
    return flagged.withColumns(
        {
            "is_short": short,
            "truncated": F.col("n_tokens") >= ANSWER_TOKEN_LIMIT,
            "anomaly": F.col("leak") | F.col("is_empty") | short | F.col("refusal"),
        }
    )


def class_summary(flagged: DataFrame, activity: str = "activity", by: Sequence[str] = ()) -> DataFrame:
    return flagged.groupBy(*by, F.col(activity).alias("activity")).agg(
        F.avg("n_tokens").alias("avg_output_tokens"),
        F.avg(defined("confidence")).alias("avg_confidence"),
        share(F.count(F.when(F.col("anomaly"), 1)), F.count("*")).alias("anomaly_rate"),
        F.count("*").alias("sample_count"),
    )


def reasoning_records(answers: DataFrame, model: str, text: str = "answer") -> DataFrame:
    """Parsed records; needs split, sample_id, activity, confidence, mantis_embedding and the answer."""
    return answers.select(
        "sample_id",
        "split",
        F.col("activity").alias("predicted_activity"),
        "confidence",
        clean_answer(text).alias("overall_reasoning"),
        corpus_graph(text).alias("reasoning_graph"),
        F.current_timestamp().alias("generation_timestamp"),
        F.lit(model).alias("model_used"),
        "mantis_embedding",
    )


# --- fixed values: wording of a training example
EXAMPLE_INPUT = (
    "Activity Recognition Task:\nAnalyze the following sensor data and predict the activity.\n\n"
    "Sample ID: %s\nModel Confidence: %.4f\n"
)
EXAMPLE_OUTPUT = "Conclusion:\n%s\n\nPredicted Activity: %s\n"
# --- end of fixed values


def training_examples(records: DataFrame) -> DataFrame:
    """Input, output and metadata of each record; the embedding stays behind."""
    kept = [c for c in records.columns if c != "mantis_embedding"]
    return records.select(
        *KEY,
        F.format_string(EXAMPLE_INPUT, "sample_id", "confidence").alias("input"),
        F.format_string(EXAMPLE_OUTPUT, "overall_reasoning", "predicted_activity").alias("output"),
        F.struct(*kept).alias("metadata"),
    )


# ---- dedup, splits, counts ---------------------------------------------------------------------------------


def first_per_key(rows: DataFrame, order: str | Column, keys: Sequence[str] = KEY) -> DataFrame:
    """First row of each key. Copies collapse before the shuffle, so a key that repeats endlessly stays cheap."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), as_column(order)).alias("r"))
        .select(*keys, "r.*")
        .select(*rows.columns)
    )


def new_rows(
    rows: DataFrame, existing: DataFrame | None, order: str | Column, keys: Sequence[str] = KEY
) -> DataFrame:
    """First row of each key that the corpus does not hold yet."""
    fresh = first_per_key(rows, order, keys)
    return fresh if existing is None else without_processed(fresh, existing, keys)


def split_train_validation(
    rows: DataFrame, label: str, fraction: float, order: Sequence[str | Column]
) -> DataFrame:
    """Adds ``fold``: per label the first ``round(fraction * n)`` rows in ``order`` go to validation.

    ``order`` decides reproducibly who they are: a hash of the id and the seed, then the id.
    """
    placed = ordering.with_group_position(rows, label, order, "_place")
    size = F.round(F.col("group_size") * fraction)
    return placed.withColumn(
        "fold", F.when(F.col("_place") < size, "validation").otherwise("train")
    ).drop("_place", "group_size")


def split_counts(sources: DataFrame, processed: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Per split: sources, those already processed, and what remains. Both sides are unique on the keys."""
    done = processed.select(*keys).distinct().withColumn("_done", F.lit(1))
    return (
        sources.select(*keys)
        .join(done, list(keys), "left")
        .groupBy("split")
        .agg(
            F.count("*").alias("n_sources"),
            F.count("_done").alias("n_processed"),
            (F.count("*") - F.count("_done")).alias("n_remaining"),
        )
    )
