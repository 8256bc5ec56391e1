"""Monitoring tables of a generation run: rolling quality, throughput, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonmill.functions.expr import share
from reasonmill.operators import ordering

ROLLING_ROWS = 100
ROLLING_BATCHES = 10
ROLLING = {
    "avg_tokens": "tokens", "avg_chars": "chars", "leak_rate": "leak", "refusal_rate": "refusal",
    "parse_fail_rate": "parse_fail", "avg_observations": "n_obs", "avg_inferences": "n_inf",
}


def rolling_quality(
    log: DataFrame, by: Sequence[str] = ("dataset",), rows: int = ROLLING_ROWS, block: int = ordering.BLOCK
) -> DataFrame:
    return ordering.rolling_means(log, ROLLING, rows, "seq", by, block)


def at_batch_ends(rolled: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """The last row of every batch, where the run reports."""
    names = [c for c in rolled.columns if c not in (*by, "batch")]
    return (
        rolled.groupBy(*by, "batch")
        .agg(F.max_by(F.struct(*names), "seq").alias("r"))
        .select(*by, "batch", "r.*")
    )


def batch_table(log: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """One row per batch; generation and wall seconds are inputs that repeat on its rows or sum over them."""
    return log.groupBy(*by, "batch").agg(
        F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"),
    )


def throughput(
    batches: DataFrame,
    batch_size: int,
    by: Sequence[str] = ("dataset",),
    rows: int = ROLLING_BATCHES,
    block: int = ordering.BLOCK,
) -> DataFrame:
    """Tokens per second, samples per hour, share done, and the time left at the pace of the last batches."""
    totals = batches.groupBy(*by).agg(F.sum("n").alias("n_total"))
    done = ordering.running_totals(batches, {"n_done": "n"}, "batch", by, block)
    paced = ordering.rolling_means(done, {"mean_latency": "seconds"}, rows, "batch", by, block)
    joined = paced.join(totals, list(by))
    remaining = (F.col("n_total") - F.col("n_done")).cast("double")
    return joined.select(
        *by,
        "batch",
        "n_done",
        share(F.col("tokens"), F.col("seconds")).alias("tokens_per_sec"),
        share(F.col("n") * 3600.0, F.col("seconds")).alias("samples_per_hour"),
        (F.col("n_done") * 100.0 / F.col("n_total")).alias("pct_complete"),
        "mean_latency",
        (remaining / max(batch_size, 1) * F.col("mean_latency") / 60.0).alias("eta_minutes"),
    )


def qualitative_samples(
    positioned: DataFrame, batch_size: int, columns: Sequence[str], text: str, every: int = 50,
    per_batch: int = 2, chars: int = 500, pos: str = "pos",
) -> DataFrame:
    """The first rows of every 50th batch with the beginning of their text, for reading."""
    batch = F.floor(F.col(pos) / batch_size)
    return positioned.where(
        (batch % every == 0) & (F.col(pos) % batch_size < per_batch)
    ).select(*columns, F.substring(text, 1, chars).alias("snippet"))
