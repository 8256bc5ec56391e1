"""What the language models of op5 put on disk, and how texts find their ratings and their sums."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reasonmill.llm import lm_score
from reasonmill.llm.blocks import bound_batches
from reasonmill.llm.tables import shared_folder

FOLDER = "/root/testdata/sf0.01"


def shuffled(spark) -> dict[str, int]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {p: os.path.getsize(p) for p in files.split("\n") if "shuffle_" in p and os.path.exists(p)}


def tables(spark) -> int:
    folder = shared_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(f"{folder}/llm") for f in files)


def test_lm_scores_deal_each_token_once(spark):
    """Bigrams are neither written nor joined: some bytes a token for all shuffles and written tables together."""
    bound_batches(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    before, wrote = shuffled(spark), tables(spark)
    rows = lm_score.score(docs, lm_score.fit(docs, labels)).select("doc_id", "n_tokens", "score").collect()
    tokens = sum(r.n_tokens for r in rows)
    disk = sum(n for p, n in shuffled(spark).items() if p not in before) + tables(spark) - wrote
    assert len(rows) == docs.count() and tokens > 300_000
    assert disk < 15 * tokens


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_ratings_are_exact_when_ids_share_bits(spark, bits, monkeypatch):
    monkeypatch.setattr(lm_score, "_BITS", bits)
    docs = spark.range(5000).select(F.when(F.col("id") < 4990, F.col("id")).alias("doc_id"), F.lit("a b").alias("text"))
    labels = spark.range(0, 9000, 2).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    rated = lm_score._rated(docs.unionAll(docs.limit(10)), labels.unionAll(labels.limit(100)))
    assert rated.count() == 5010
    assert rated.where(F.col("good") != F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))).count() == 0
    assert rated.where("good is null").count() == 0


def test_equal_blocks_get_equal_sums(spark):
    """Blocks of the same rows have one name; each row is still scored by itself."""
    bound_batches(spark)
    rows = [(7, "one two three two one"), (8, None), (7, "one two three two one")]
    once = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = once.unionAll(once).unionAll(spark.createDataFrame([(9, "two one four")], once.schema))
    labels = spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int")
    got = []
    for size in (1000, 2, 0):
        scored = lm_score.score(docs, lm_score.fit(docs, labels, size=size)).collect()
        assert len(scored) == 7 and sum(r.score is None for r in scored) == 2
        same = {(r.n_tokens, round(r.target_loss, 5), round(r.background_loss, 5)) for r in scored if r.doc_id == 7}
        assert len(same) == 1
        got.append(same)
    assert got[0] == got[1] == got[2]


def test_numbers_come_back_from_their_packed_forms():
    rng = np.random.default_rng(5)
    for n in (0, 1, 9, 5000):
        bounds = np.concatenate(([0], np.sort(rng.integers(0, n + 1, 7)), [n]))
        values = np.concatenate([np.sort(rng.integers(0, 1 << 16, b - a)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        data, ends = lm_score._steps_up(values, bounds)
        assert ends[-1] == len(data) and (lm_score._from_steps_up(data, bounds) == values).all()
        for high in (1, 2, 1 << 33):
            values = rng.integers(0, high, n) * rng.integers(0, 2, n)
            assert (lm_score._from_planes(lm_score._planes(values), n) == values).all()


def test_the_head_is_bounded_and_has_all_pairs_of_the_most_frequent_words():
    for n in (0, 1, 8, 1000, 1 << 15):
        for bits in (0, 1, 10, 20):
            widths = lm_score._widths(n, 1 << bits)
            assert len(widths) == n + 2 and widths.sum() <= 1 << bits and widths.max() <= n and widths[-1] == 0
            side = min(int((1 << bits >> 1) ** 0.5), n)
            assert (widths[:side] >= side).all() and (np.diff(widths) <= 0).all()
    assert (lm_score._widths(8, 1 << 20)[:9] == 8).all()
