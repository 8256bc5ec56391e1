"""Stage tables: results that several steps read, written once to the shared folder of the cluster."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reasonmill.session import ensure_checkpoint_dir


def stage_folder(spark: SparkSession, name: str) -> str:
    """A new folder of its own below the shared one."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: parsed once, pruned by column later, and safe when executors are lost."""
    folder = stage_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


_INPUTS: dict[tuple[str, str, str], DataFrame] = {}


def staged_once(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived input table, written the first time an application asks for it and read from then on."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _INPUTS:
        _INPUTS[key] = staged(build(), name)
    return _INPUTS[key]
