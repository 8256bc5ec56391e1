"""Classification metrics from one small count table.

Rows are counted once per (truth, prediction) pair of listed classes, with everything off the list folded into
NULL; all metrics come from that table, whose size is the square of the number of classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonmill.functions.expr import harmonic_mean, share, strings

UNKNOWN = "unknown"


def with_unknown(classes: Sequence[str]) -> list[str]:
    return [c.lower().strip() for c in classes] + [UNKNOWN]


def pair_counts(
    rows: DataFrame, labels: Sequence[str], gt: str = "gt_activity", pred: str = "predicted_activity",
    by: Sequence[str] = (),
) -> DataFrame:
    listed = lambda c: F.when(F.col(c).isin(*labels), F.col(c))
    return rows.groupBy(*by, listed(gt).alias("gt"), listed(pred).alias("pred")).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col(gt).eqNullSafe(F.col(pred)), 1)).alias("n_equal"),
    )


def _per_class(counts: DataFrame, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Spread each pair over the label list: rows stay few, as the pair table is already aggregated."""
    label = F.col("label")
    if not by:  # an empty input has its labels too
        nothing = counts.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("gt"), F.lit(None).cast("string").alias("pred"),
            F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_equal"),
        )
        counts = counts.unionByName(nothing)
    n_where = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    spread = counts.select(
        "*", F.posexplode(strings(labels)).alias("ordinal", "label")
    )
    hit = (F.col("gt") == label) & (F.col("pred") == label)
    sums = spread.groupBy(*by, "ordinal", "label").agg(
        n_where(hit).alias("tp"),
        n_where(F.col("pred") == label).alias("predicted"),
        n_where(F.col("gt") == label).alias("support"),
        F.sum("n").alias("total"),
        F.sum("n_equal").alias("equal"),
    )
    zero = F.lit(0.0)
    return sums.select(
        *by,
        "ordinal",
        "label",
        F.coalesce(share(F.col("tp"), F.col("predicted")), zero).alias("precision"),
        F.coalesce(share(F.col("tp"), F.col("support")), zero).alias("recall"),
        "support",
        "total",
        "equal",
    ).withColumn("f1", harmonic_mean(F.col("precision"), F.col("recall")))


def class_report(
    rows: DataFrame, labels: Sequence[str], gt: str = "gt_activity", pred: str = "predicted_activity",
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, F1 and support per label; a label that never occurs has a row of zeros."""
    return _per_class(pair_counts(rows, labels, gt, pred, by), labels, by).select(
        *by, "ordinal", "label", "precision", "recall", "f1", "support"
    )


def summary(
    rows: DataFrame, labels: Sequence[str], gt: str = "gt_activity", pred: str = "predicted_activity",
    by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy over all rows and macro scores over the real classes, without ``unknown``."""
    real = [c for c in labels if c != UNKNOWN]
    per_class = _per_class(pair_counts(rows, labels, gt, pred, by), real, by)
    # Every label row has seen all pairs, so the overall counts are the same on each of them.
    return per_class.groupBy(*by).agg(
        F.max("total").alias("n"),
        share(F.max("equal"), F.max("total")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )


def confusion(
    rows: DataFrame, labels: Sequence[str], gt: str = "gt_activity", pred: str = "predicted_activity"
) -> DataFrame:
    """Long confusion matrix with all label pairs; rows with an off-list side are left out."""
    counts = pair_counts(rows, labels, gt, pred)
    one = rows.sparkSession.range(1)
    cells = one.select(F.explode(strings(labels)).alias("gt")).select(
        "gt", F.explode(strings(labels)).alias("pred")
    )
    return cells.join(counts.drop("n_equal"), ["gt", "pred"], "left").select(
        "gt", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def confusion_matrix(
    rows: DataFrame, labels: Sequence[str], gt: str = "gt_activity", pred: str = "predicted_activity"
) -> DataFrame:
    """Wide form for reports: one row per true class, one column per predicted class."""
    cells = confusion(rows, labels, gt, pred)
    return cells.groupBy("gt").pivot("pred", list(labels)).agg(F.first("n"))
