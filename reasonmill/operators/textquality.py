"""Text-overlap scores per sample, their means, and the means split by correctness of the predicted class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonmill.functions import similarity
from reasonmill.functions.expr import harmonic_mean

SCORES = ("rouge_l", "meteor", "sensor_term_recall")
VECTORS_PER_BLOCK = 256
BLOCKS_PER_CELL = 64


def text_scores(
    rows: DataFrame,
    keys: Sequence[str],
    terms: Sequence[str],
    reference: str = "ground_truth_reasoning",
    generated: str = "generated",
    stem: bool = True,
    columns: Sequence[str] = SCORES,
) -> DataFrame:
    """The wanted scores of every row with a reference text; texts are compared whole."""
    scores = {
        "rouge_l": lambda: similarity.rouge_l(reference, generated, stem),
        "meteor": lambda: similarity.meteor(reference, generated),
        "sensor_term_recall": lambda: similarity.term_recall(reference, generated, terms),
    }
    return rows.select(*keys, *[scores[c]().alias(c) for c in columns])


def means(scores: DataFrame, columns: Sequence[str] = SCORES, by: Sequence[str] = ()) -> DataFrame:
    """Undefined scores are NULL and stay out of the means."""
    return scores.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def is_correct(gt: str = "gt_activity", pred: str = "predicted_activity") -> Column:
    return F.col(gt).eqNullSafe(F.col(pred))


def scoped_means(
    scores: DataFrame,
    columns: Sequence[str] = SCORES,
    gt: str = "gt_activity",
    pred: str = "predicted_activity",
    by: Sequence[str] = (),
    classes: bool = True,
) -> DataFrame:
    """``(by…, scope, value, n, columns…)``: means over all samples, by correctness and, on request, by true class.

    One aggregate over grouping sets: every row is read and scored once, and each scope has its own partial sums.
    """
    tagged = scores.select(
        *by, F.when(is_correct(gt, pred), "correct").otherwise("incorrect").alias("_condition"),
        F.col(gt).alias("_class"), *columns,
    )
    sets = [[*by], [*by, "_condition"], *([[*by, "_class"]] if classes else [])]
    grouped = tagged.groupingSets(sets, *by, "_condition", "_class").agg(
        F.grouping("_condition").alias("_no_condition"), F.grouping("_class").alias("_no_class"),
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns],
    )
    scope = F.when(F.col("_no_condition") == 0, "condition").when(F.col("_no_class") == 0, "class").otherwise("all")
    value = F.when(scope == "all", "all").otherwise(F.coalesce("_condition", "_class"))
    return grouped.select(*by, scope.alias("scope"), value.alias("value"), "n", *columns)


def conditioned_means(
    scores: DataFrame,
    columns: Sequence[str] = SCORES,
    gt: str = "gt_activity",
    pred: str = "predicted_activity",
    by: Sequence[str] = (),
) -> DataFrame:
    """Means for all, correct and incorrect samples in one pass."""
    return scoped_means(scores, columns, gt, pred, by, classes=False).select(
        *by, F.col("value").alias("condition"), "n", *columns
    )


def condition_counts(rows: DataFrame, reference_flag: str = "has_reference") -> DataFrame:
    """The six counts that go with the conditioned means."""
    right, has = is_correct(), F.col(reference_flag)
    count_if = lambda c: F.count(F.when(c, 1))
    return rows.agg(
        F.count("*").alias("n_total_cls"),
        count_if(has).alias("n_total_text_gt"),
        count_if(right).alias("n_correct_activity"),
        count_if(~right).alias("n_incorrect_activity"),
        count_if(right & has).alias("n_correct_activity_gt"),
        count_if(~right & has).alias("n_incorrect_activity_gt"),
    )


def vector_f1(
    vectors: DataFrame,
    left: str = "reference",
    right: str = "generated",
    block_size: int = VECTORS_PER_BLOCK,
    blocks_per_cell: int = BLOCKS_PER_CELL,
) -> DataFrame:
    """Greedy cosine F1 from token vectors ``(sample_id, side, pos, vec)``; ``pos`` is unique per sample and side.

    Vectors are packed into blocks of bounded size. Two blocks give one cosine matrix inside a task, of which only
    the maxima leave it: no pair of vectors is ever a row. The blocks of a very long sample are dealt out over
    a grid of cells, so that their matrices are spread over many tasks. A sample with vectors on one side only keeps its
    row, with NULL scores.
    """
    per_cell = block_size * blocks_per_cell
    cells = lambda name: F.greatest(
        F.ceil(F.count(F.when(F.col("side") == name, 1)) / per_cell).cast("int"), F.lit(1)
    )
    grid = vectors.groupBy("sample_id").agg(
        cells(left).alias("n_rows"), cells(right).alias("n_cols")
    )
    blocks = (
        vectors.groupBy("sample_id", "side", F.floor(F.col("pos") / block_size).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "vec"))).alias("items"))
        .join(grid, "sample_id")
    )
    own = lambda n: F.pmod(F.xxhash64("block"), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = blocks.where(F.col("side") == left).select(
        "sample_id", own("n_rows").alias("row"), every("n_cols").alias("col"), F.col("items").alias("l")
    )
    b = blocks.where(F.col("side") == right).select(
        "sample_id", every("n_rows").alias("row"), own("n_cols").alias("col"), F.col("items").alias("r")
    )
    best = a.join(b, ["sample_id", "row", "col"]).select(
        "sample_id", "l.pos", F.col("r.pos").alias("r_pos"),
        similarity.best_cosines(F.col("l.vec"), F.col("r.vec")).alias("best"),
    )
    tagged = lambda name, pos, score: F.transform(
        F.arrays_zip(F.col(pos).alias("pos"), F.col(score).alias("score")),
        lambda z: F.struct(F.lit(name).alias("side"), z["pos"].alias("pos"), z["score"].alias("score")),
    )
    per_vector = (
        best.select("sample_id", "pos", "r_pos", F.col("best.left").alias("bl"), F.col("best.right").alias("br"))
        .select(
            "sample_id", F.explode(F.concat(tagged("l", "pos", "bl"), tagged("r", "r_pos", "br"))).alias("t")
        )
        .groupBy("sample_id", "t.side", "t.pos")
        .agg(F.max("t.score").alias("score"))
    )
    scored = per_vector.groupBy("sample_id").agg(
        F.avg(F.when(F.col("side") == "r", F.col("score"))).alias("vector_precision"),
        F.avg(F.when(F.col("side") == "l", F.col("score"))).alias("vector_recall"),
    )
    return grid.select("sample_id").join(scored, "sample_id", "left").withColumn(
        "vector_f1", harmonic_mean(F.col("vector_precision"), F.col("vector_recall"))
    )
