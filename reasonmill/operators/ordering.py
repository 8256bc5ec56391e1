"""Positions, rolling and running values over one long order, without a task that sees the whole order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reasonmill.session import checkpointed

BLOCK = 1 << 17
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the lower 33 bits


def _sorted_rows(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """One range-partitioned sort, checkpointed with the partition and the row number in it. So whatever is counted
    afterwards belongs to exactly these partitions, also when executors are lost."""
    numbered = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    return checkpointed(
        numbered.withColumn("_part", F.shiftrightunsigned("_id", _ROW_BITS)).withColumn(
            "_row", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        ).drop("_id")
    )


def with_position(
    df: DataFrame, order: Sequence[str | Column], name: str = "pos", total: str | None = None
) -> DataFrame:
    """0-based position in a total order, and on request the number of rows; ``order`` must be unique."""
    ordered = _sorted_rows(df, order)
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    # As many rows as partitions of one shuffle: one window task and a broadcast are safe whatever the data.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("_n").over(everything).alias(total)] if total else []),
    )
    joined = ordered.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_offset") + F.col("_row")).drop("_part", "_row", "_offset")


def with_group_position(
    df: DataFrame, group: str, order: Sequence[str | Column], name: str = "pos", total: str = "group_size"
) -> DataFrame:
    """0-based position inside each group plus the group size, however uneven the groups are.

    One global order by (group, order) instead of a window per group: a hot group spreads over many partitions,
    and rows meet the counts of their own (partition, group), so no join key is hot either.
    """
    ordered = _sorted_rows(df, [group, *order])
    pieces = ordered.groupBy("_part", group).agg(
        F.count("*").alias("_n"), F.min("_row").alias("_first")
    )
    of_group = Window.partitionBy(group)
    before = of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        F.col("_part").alias("_p"),
        F.col(group).alias("_g"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(of_group).alias(total),
    )
    joined = ordered.join(
        offsets, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))
    )
    return joined.withColumn(name, F.col("_shift") + F.col("_row")).drop(
        "_part", "_row", "_p", "_g", "_shift"
    )


def every_nth(positioned: DataFrame, n: int, pos: str = "pos", total: str | None = None) -> DataFrame:
    """Rows at positions 0, n, 2n, …; with the column ``total`` of the row count also the last one."""
    keep = F.col(pos) % n == 0
    return positioned.where(keep | (F.col(pos) == F.col(total) - 1) if total else keep)


def rolling_means(
    df: DataFrame,
    columns: Mapping[str, str],
    rows: int,
    seq: str = "seq",
    by: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Mean of the last ``rows`` rows, for a dense ``seq`` per group.

    The order is cut into blocks, and each block also receives the last rows of the one before it. So a window
    task sees ``block + rows`` rows, even if one group holds everything.
    """
    if rows > block:
        raise ValueError("a block must hold at least one whole window")
    own = F.floor(F.col(seq) / block).cast("bigint")
    near_end = F.col(seq) % block >= block - (rows - 1)
    copies = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_block", F.explode(copies)).withColumn("_own", own)
    window = Window.partitionBy(*by, "_block").orderBy(seq).rowsBetween(-(rows - 1), 0)
    rolled = spread.withColumns(
        {name: F.avg(F.col(c).cast("double")).over(window) for name, c in columns.items()}
    )
    return rolled.where("_block = _own").drop("_block", "_own")


def running_totals(
    df: DataFrame,
    columns: Mapping[str, str],
    seq: str = "seq",
    by: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Sum of all rows up to this one: block sums first, then running sums inside each block."""
    cut = df.withColumn("_block", F.floor(F.col(seq) / block).cast("bigint"))
    sums = cut.groupBy(*by, "_block").agg(
        *[F.sum(c).alias(f"_sum_{name}") for name, c in columns.items()]
    )
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by,
        "_block",
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in columns],
    )
    inside = (
        Window.partitionBy(*by, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = cut.join(offsets, [*by, "_block"])
    return joined.withColumns(
        {name: F.col(f"_off_{name}") + F.sum(c).over(inside) for name, c in columns.items()}
    ).drop("_block", *[f"_off_{n}" for n in columns])



def runs(rows: DataFrame, index: str) -> DataFrame:
    """(first, last) of every unbroken range of the values of ``index``, which are whole numbers without repeats.

    A value less its position is the same for a whole run, so runs are an aggregate with partial sums: a run of any
    length, over any number of partitions, ends as one row.
    """
    placed = with_position(rows.select(index), [index], "_pos")
    return placed.groupBy((F.col(index) - F.col("_pos")).alias("_run")).agg(
        F.min(index).alias("first"), F.max(index).alias("last")
    ).drop("_run")


def index_report(rows: DataFrame, index: str, expected: int | None = None) -> DataFrame:
    """(kind, first, last, n) of the ranges of whole numbers from 0 that are missing, or there more than once (``n`` rows).

    With ``expected`` the numbers below it are wanted, else those up to the greatest. Rows without index are left out.
    """
    counted = rows.where(F.col(index).isNotNull()).groupBy(index).agg(F.count("*").alias("_n"))
    # The borders stand for what comes before and after all rows.
    present = runs(counted, index)
    placed = with_position(present, ["first"], "_pos", "_total")
    before = placed.select((F.col("_pos") + 1).alias("_pos"), (F.col("last") + 1).alias("_from"))
    inner = placed.join(before, "_pos", "left").select(F.coalesce("_from", F.lit(0)).alias("first"), (F.col("first") - 1).alias("last"))
    gaps = inner
    if expected is not None:
        ends = present.agg(F.coalesce(F.max("last") + 1, F.lit(0)).alias("first")).select("first", F.lit(expected - 1).alias("last"))
        gaps = inner.unionByName(ends)
    missing = gaps.where("first <= last").select(
        F.lit("missing").alias("kind"), F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"),
        F.lit(0).cast("bigint").alias("n"),
    )
    many = counted.where("_n > 1")
    doubled = with_position(many, [index], "_pos").groupBy((F.col(index) - F.col("_pos")).alias("_run")).agg(
        F.min(index).cast("bigint").alias("first"), F.max(index).cast("bigint").alias("last"), F.sum("_n").alias("n")
    )
    return missing.unionByName(doubled.select(F.lit("doubled").alias("kind"), "first", "last", "n"))
