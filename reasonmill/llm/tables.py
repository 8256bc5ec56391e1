"""Written tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonmill.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """The folder of the cluster's setting spark.checkpoint.dir; without one, a scratch folder in local mode."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of ``df`` in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps start from files that outlive any executor."""
    folder = f"{shared_folder(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that links reach.

    Alternates large-star and small-star steps: in the first, the larger neighbours of a node link to its smallest
    one, in the second the smaller ones. Both need one aggregate with partial sums per step, and the number of steps
    grows with the logarithm of the longest chain. A hub is split by the skew join, never held in one task.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, name)
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small.where("u <> v").distinct(), name)
        before_sum, after_sum = (
            d.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first() for d in (edges, after)
        )
        edges = after
        if before_sum == after_sum:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


BUCKETS = 1 << 18


def only_near(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` may be among ``keys``: a semi join on hash buckets, of which there are at most BUCKETS, so
    the broadcast is bounded. It only spares wide rows a shuffle; the exact join follows."""
    bucket = F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")
    some = keys.select(bucket.alias("_bucket")).distinct()
    return df.withColumn("_bucket", bucket).join(F.broadcast(some), "_bucket", "left_semi").drop("_bucket")
