"""Metrics as one long table, and the reports made from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonmill.functions.expr import fixed4, strings

UNDEFINED = "N/A"


def long_metrics(
    wide: DataFrame, section: str, by: Sequence[str] = (), skip: Sequence[str] = ()
) -> DataFrame:
    """``(by…, section, metric, value, is_count)`` from a table with one metric per column."""
    columns = [(f.name, f.dataType.typeName()) for f in wide.schema if f.name not in (*by, *skip)]
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(name).cast("double").alias("value"),
                F.lit(kind != "double").alias("is_count"),
                F.lit(n).alias("ordinal"),
            )
            for n, (name, kind) in enumerate(columns)
        ]
    )
    return wide.select(*by, F.lit(section).alias("section"), F.explode(cells).alias("m")).select(
        *by, "section", "m.*"
    )


def run_statistics(metrics: DataFrame, keys: Sequence[str] = ("section", "metric")) -> DataFrame:
    """Mean and sample deviation of each metric over the runs. Counts have no mean; one value deviates by 0."""
    usable = F.when(~F.col("is_count"), F.col("value"))
    return metrics.groupBy(*keys).agg(
        F.avg(usable).alias("mean"),
        F.coalesce(F.stddev_samp(usable), F.lit(0.0)).alias("std"),
        F.count("*").alias("n_runs"),
    )


def combined_report(metrics: DataFrame, runs: Sequence[int]) -> DataFrame:
    """Metric by run with mean and deviation, as text with four decimals; metrics of the first run only."""
    shown = F.when(F.col("is_count"), F.format_string("%d", F.col("value").cast("bigint"))).otherwise(
        fixed4(F.col("value"))
    )
    usable = F.when(~F.col("is_count"), F.col("value"))
    per_run = [
        F.coalesce(F.max(F.when(F.col("run") == run, shown)), F.lit(UNDEFINED)).alias(f"run_{run}")
        for run in runs
    ]
    grouped = metrics.groupBy("section", "metric").agg(
        F.min("ordinal").alias("ordinal"),
        F.count(F.when(F.col("run") == runs[0], 1)).alias("_in_first"),
        *per_run,
        fixed4(F.avg(usable)).alias("mean"),
        fixed4(F.coalesce(F.stddev_samp(usable), F.lit(0.0))).alias("std"),
    )
    return grouped.where("_in_first > 0").drop("_in_first")


def sectioned_report(metrics: DataFrame, sections: Sequence[str]) -> DataFrame:
    """Lines of the metrics report in the order of ``sections``; undefined values read N/A."""
    shown = F.when(F.col("is_count"), F.format_string("%d", F.col("value").cast("bigint"))).otherwise(
        fixed4(F.col("value"))
    )
    return metrics.select(
        F.array_position(strings(list(sections)), F.col("section")).alias("section_ordinal"),
        "section",
        "ordinal",
        "metric",
        F.coalesce(shown, F.lit(UNDEFINED)).alias("value"),
    )


def class_lines(report: DataFrame) -> DataFrame:
    """Per-class lines in label order, so ``unknown`` comes last: (ordinal, cells)."""
    numbers = [fixed4(F.col(c)) for c in ("precision", "recall", "f1")]
    return report.select("ordinal", F.array("label", *numbers, F.col("support").cast("string")).alias("cells"))


def value_lines(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """(ordinal, cells) of name and value for columns of a one-row table; counts are whole numbers."""
    kinds = dict(wide.dtypes)
    shown = lambda c: fixed4(F.col(c)) if kinds[c] == "double" else F.coalesce(F.col(c).cast("string"), F.lit(UNDEFINED))
    lines = F.array(*[F.array(F.lit(c), shown(c)) for c in names])
    return wide.select(F.posexplode(lines).alias("ordinal", "cells"))


def condition_lines(scoped: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ordinal, cells) of the means of correct and incorrect samples; both have a line, whether or not there are any."""
    rows = scoped.where("scope = 'condition'").agg(F.collect_list(F.struct("value", "n", *columns)).alias("rows"))  # two at most

    def line(name: str) -> Column:
        row = F.get(F.filter("rows", lambda r: r["value"] == name), F.lit(0))
        return F.array(F.lit(name), F.coalesce(row["n"], F.lit(0)).cast("string"), *[fixed4(row[c]) for c in columns])

    return rows.select(F.posexplode(F.array(line("correct"), line("incorrect"))).alias("ordinal", "cells"))
