"""Writers. Rows go into files by partition, never one file per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def public_columns(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Without private columns (leading underscore) and the listed ones."""
    return df.select(*[c for c in df.columns if not c.startswith("_") and c not in drop])


def write_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Reasoning records under one folder per split."""
    records.write.mode(mode).partitionBy("split").option("ignoreNullFields", "false").json(path)


def append_examples(examples: DataFrame, path: str) -> None:
    """Training lines under one folder per split; the caller has already left out known ids."""
    examples.write.mode("append").partitionBy("split").json(path)


def write_rejects(rejects: DataFrame, path: str) -> None:
    rejects.write.mode("append").option("sep", "\t").csv(path)


def write_results(rows: DataFrame, path: str, drop: Sequence[str] = ()) -> None:
    """Evaluation or matching rows; undefined values stay visible as null."""
    public_columns(rows, drop).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    """A report of a few lines as one CSV file in order."""
    shown = [c for c in lines.columns if c not in order or c not in ("ordinal", "section_ordinal")]
    ordered = lines.orderBy(*order).select(*[F.col(c) for c in shown])
    ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_lines(report: DataFrame, path: str, width: int = 8) -> None:
    """The few lines of a sectioned report as one CSV file, cell by cell, each section under its name."""
    heads = report.select("section_ordinal", "section").distinct().select(
        "section_ordinal", F.lit(-1).alias("ordinal"), F.array(F.concat(F.lit("## "), F.upper("section"))).alias("cells")
    )
    lines = heads.unionByName(report.select("section_ordinal", "ordinal", "cells")).orderBy("section_ordinal", "ordinal")
    cells = [F.coalesce(F.get("cells", F.lit(n)), F.lit("")).alias(f"c{n}") for n in range(width)]
    lines.select(*cells).coalesce(1).write.mode("overwrite").option("emptyValue", "").csv(path)
