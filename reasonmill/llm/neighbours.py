"""Approximate nearest neighbours by adaptive scans of column blocks within probed lists.

A random rotation spreads the variance evenly, so the first k of d rotated dimensions estimate a distance: partial * d / k.
Vectors are dealt to the lists of their nearest centroids (k-means on a bounded sample). A query probes its nearest lists;
in each, candidates are scanned a block of columns at a time, and a candidate is given up as soon as its estimate is above
the tenth best distance so far by more than chance allows (factor 1 + EPSILON / sqrt(k)). What is left is measured exactly,
in double precision, on the original vectors. The number of probed lists is the least that finds 99 of 100 neighbours
within the sample.

Every vector is in the index. A list is cut into blocks of about ``BLOCK`` vectors, and its queries likewise, so neither a
vector that a third of the rows share nor many queries make a large task.

Defined results: vectors that are NULL, zero, of another length than most of the sample's, or hold a NULL or non-finite
component take no part, neither as query nor as candidate; so do rows without vec_id. A query's own id is no candidate of
it; rows that repeat an id are candidates each, but one query. Ties go to the smaller vec_id. With no more than ten
candidates in all, every list is probed. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reasonmill.llm.tables import written

K = 10
SAMPLE = 16_000
COLUMNS = 16
EPSILON = 2.1
BLOCK = 4096
FOUND = 0.99


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray  # rotated
    probes: int

    @property
    def length(self) -> int:
        return len(self.rotation)


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def train(vectors: np.ndarray, rows: int, seed: int = 11) -> Index:
    """Rotation, centroids and number of probes from a sample; ``rows`` is the size of the whole table."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((vectors.shape[1],) * 2))[0]
    x = vectors @ rotation
    lists = int(max(1, min(np.sqrt(rows), len(np.unique(x, axis=0)) // 16, 1024)))
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(8):
        owner = np.concatenate([_nearest(part, centroids).argmin(1) for part in np.array_split(x, len(x) // 4096 + 1)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, x)
        counts = np.bincount(owner, minlength=lists)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    owner = np.concatenate([_nearest(part, centroids).argmin(1) for part in np.array_split(x, len(x) // 4096 + 1)])
    some = rng.choice(len(x), min(200, len(x)), replace=False)
    best = np.argsort(_nearest(x[some], x), axis=1, kind="stable")[:, 1:K + 1]
    order = np.argsort(_nearest(x[some], centroids), axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(lists)[None, :], axis=1)
    needed = np.take_along_axis(rank, owner[best], axis=1) + 1 if best.size else np.ones(1)
    return Index(rotation, centroids, int(np.quantile(needed, FOUND)))


def _valid(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their vectors."""
    keep, rows = [], []
    for n, value in enumerate(column.to_pylist()):
        if value is None or len(value) != length or None in value:
            continue
        keep.append(n)
        rows.append(value)
    x = np.array(rows, np.float64).reshape(-1, length)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return np.array(keep, np.int64)[good], x[good]


def fit(vectors: DataFrame, sample: int = SAMPLE) -> Index | None:
    """Index from about ``sample`` vectors, chosen by hash of the id."""
    rows = vectors.where("vec_id is not null and embedding is not null")
    total = rows.count()
    if not total:
        return None
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / total) + 1)
    column = rows.where(part).select("embedding").orderBy(F.xxhash64("embedding")).toArrow().column(0).combine_chunks()
    lengths = Counter(len(v) for v in column.to_pylist() if v)
    if not lengths:
        column = rows.select("embedding").limit(sample).toArrow().column(0).combine_chunks()
        lengths = Counter(len(v) for v in column.to_pylist() if v)
    if not lengths:
        return None
    _, x = _valid(column, max(lengths, key=lambda n: (lengths[n], n)))
    return train(x, total) if len(x) else None


def _assign(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, x = _valid(batch.column("embedding"), index.length)
        owner = _nearest(x @ index.rotation, index.centroids).argmin(1) if len(x) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(keep)), pa.array(owner.astype(np.int32)),
             pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "list", "vector"])


def _probe(batches: Iterator[pa.RecordBatch], index: Index, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Lists that a query scans: the nearest ones, and more while they hold too few candidates."""
    for batch in batches:
        raw = batch.column("vector").to_pylist()
        x = np.array([np.frombuffer(v) for v in raw]).reshape(-1, index.length)
        rows, lists = [], []
        if len(x):
            order = np.argsort(_nearest(x @ index.rotation, index.centroids), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) <= K).sum(axis=1) + 1  # one of them may be the query itself
            for n, line in enumerate(order):
                near = line[:max(index.probes, int(enough[n]))]
                near = near[sizes[near] > 0]
                rows += [n] * len(near)
                lists += near.tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(rows, pa.int64())), pa.array(lists, pa.int32()),
             pa.array([raw[n] for n in rows], pa.binary())], names=["query_id", "list", "query"])


def scan(query: np.ndarray, ids: np.ndarray, rotated: np.ndarray, vectors: np.ndarray, own: np.ndarray, index: Index,
         k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the k nearest candidates, as far as the tests let them through."""
    free = np.flatnonzero(~own)
    turned = query @ index.rotation
    first = free[:max(4 * k, 64)]
    if len(free) > len(first):
        exact = ((rotated[first] - turned) ** 2).sum(axis=1)
        limit = np.sqrt(np.partition(exact, k - 1)[k - 1]) if len(first) >= k else np.inf
        alive, partial, d = free, np.zeros(len(free)), index.length
        for start in range(0, d, COLUMNS):
            end = min(start + COLUMNS, d)
            partial = partial + ((rotated[alive, start:end] - turned[start:end]) ** 2).sum(axis=1)
            slack = 1 + EPSILON / np.sqrt(end) if end < d else 1 + 1e-9
            passed = np.sqrt(partial * (d / end)) <= limit * slack
            alive, partial = alive[passed], partial[passed]
        free = alive
    distance = np.sqrt(((vectors[free] - query) ** 2).sum(axis=1))
    best = np.lexsort((ids[free], distance))[:k]
    return free[best], distance[best]


def _search(left: pa.Table, right: pa.Table, index: Index) -> pa.Table:
    ids = left.column("vec_id").to_numpy()
    vectors = np.frombuffer(b"".join(left.column("vector").to_pylist())).reshape(-1, index.length)
    rotated = vectors @ index.rotation
    out: list[tuple[int, int, float]] = []
    if len(ids):
        for query_id, raw in zip(right.column("query_id").to_pylist(), right.column("query").to_pylist(), strict=True):
            at, distance = scan(np.frombuffer(raw), ids, rotated, vectors, ids == query_id, index)
            out += [(query_id, int(i), float(x)) for i, x in zip(ids[at], distance, strict=True)]
    return pa.table({
        "query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()),
        "score": pa.array([r[2] for r in out], pa.float64())})


def search(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest ten of each query by Euclidean distance."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    index = fit(rows, sample)
    if index is None:
        return spark.range(0).selectExpr("id query_id", "int(id) rank", "id vec_id", "double(id) score")
    shared = spark.sparkContext.broadcast(index)
    dealt = written(rows.where("vec_id is not null").mapInArrow(
        lambda b: _assign(b, shared.value), "vec_id long, list int, vector binary"), "lists")
    sizes = np.zeros(len(index.centroids), np.int64)
    for row in dealt.groupBy("list").count().collect():  # a row a list
        sizes[row["list"]] = row["count"]
    queries = written(dealt.where(is_query).dropDuplicates(["vec_id"]).mapInArrow(
        lambda b: _probe(b, shared.value, sizes), "query_id long, list int, query binary"), "probes")
    asked = np.zeros(len(sizes), np.int64)
    for row in queries.groupBy("list").count().collect():
        asked[row["list"]] = row["count"]

    def parts(counts: np.ndarray):
        return F.get(F.array(*[F.lit(int(-(-n // BLOCK)) or 1) for n in counts]), F.col("list"))

    candidates = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), parts(sizes)).cast("int")).withColumn(
        "queries", F.explode(F.sequence(F.lit(0), parts(asked) - 1)))
    questions = queries.withColumn("queries", F.pmod(F.xxhash64("query_id"), parts(asked)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), parts(sizes) - 1)))
    keys = ["list", "block", "queries"]
    found = candidates.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInArrow(
        lambda a, b: _search(a, b, shared.value), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K).select(
        "query_id", "rank", "vec_id", "score")
