"""Vocabularies by row: rows of several datasets in one table, each with the lists of its own dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonmill import registry
from reasonmill.functions.text import longest_first
from reasonmill.functions.vocab import sensor_maps

COLUMN = "vocabulary"
#: A registry of up to so many datasets is broadcast.
BROADCAST_DATASETS = 1_000
_FIELDS = (
    "classes array<string>, longest array<string>, sensors array<string>, terms array<string>, "
    "names struct<exact:map<string,string>,known:map<string,string>>"
)
_NAMES = ("classes", "longest", "sensors", "terms", "names")


def _entry(d: registry.Dataset) -> tuple:
    classes = [c.lower().strip() for c in d.classes]
    return classes, longest_first(classes), list(d.sensors), list(d.terms), sensor_maps(d.sensors)


def dimension(spark: SparkSession, datasets: Sequence[registry.Dataset] | None = None) -> DataFrame:
    """One row per dataset: its lists, the classes also longest first, and its sensors by name and by key."""
    entries = registry.DATASETS.values() if datasets is None else datasets
    return spark.createDataFrame([(d.name.lower(), *_entry(d)) for d in entries], f"dataset string, {_FIELDS}")


def with_vocabulary(
    rows: DataFrame, datasets: Sequence[registry.Dataset] | None = None, fields: Sequence[str] = ("*",)
) -> DataFrame:
    """Adds the struct ``vocabulary`` of each row's ``dataset``, whatever its case; what ``datasets`` gives stands in for the
    registry, and unknown or missing names have the defaults. With ``fields`` only these lists."""
    spark = rows.sparkSession
    known = dimension(spark, datasets).select(F.col("dataset").alias("_dataset"), *fields if "*" not in fields else _NAMES)
    defaults = spark.createDataFrame([_entry(registry.Dataset(""))], _FIELDS).select(F.struct(*fields).alias("_default"))
    entries = known.select("_dataset", F.struct(*[f"`{c}`" for c in known.columns[1:]]).alias(COLUMN))
    small = (len(registry.DATASETS) if datasets is None else len(datasets)) <= BROADCAST_DATASETS
    joined = rows.join(F.broadcast(entries) if small else entries, F.lower("dataset") == F.col("_dataset"), "left")
    filled = joined.join(F.broadcast(defaults), F.col("_dataset").isNull(), "left")  # one row
    return filled.withColumn(COLUMN, F.coalesce(COLUMN, "_default")).drop("_dataset", "_default")


def by_name(datasets: Sequence[registry.Dataset] | None = None) -> dict[str, tuple[Sequence[str], Sequence[str]]]:
    """Sensors, and classes with the longest first, by lower-cased name of the dataset, and the defaults by ""."""
    entries = registry.DATASETS.values() if datasets is None else datasets
    lists = lambda d: (tuple(d.sensors), _entry(d)[1])
    return {"": lists(registry.Dataset(""))} | {d.name.lower(): lists(d) for d in entries}


def field(name: str) -> Column:
    return F.col(f"{COLUMN}.{name}")
