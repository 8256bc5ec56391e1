from __future__ import annotations

import random

from pyspark.sql import functions as F

from reasonmill.operators import corpus, ordering, runlog


def test_positions(spark):
    values = random.Random(2).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = ordering.with_position(df, ["v"], "pos", "n").collect()
    assert sorted((r.pos, r.v) for r in got) == list(enumerate(sorted(values)))
    assert {r.n for r in got} == {500}
    kept = ordering.every_nth(ordering.with_position(df, ["v"], "pos", "n"), 50, "pos", "n")
    assert sorted(r.pos for r in kept.collect()) == [*range(0, 500, 50), 499]


def test_positions_in_uneven_groups(spark):
    rows = [("hot", v) for v in range(400)] + [("b", 3), ("b", 1), (None, 9)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(5)
    got = ordering.with_group_position(df, "g", ["v"]).collect()
    assert len(got) == 403
    assert all(r.pos == r.v and r.group_size == 400 for r in got if r.g == "hot")
    assert {(r.v, r.pos, r.group_size) for r in got if r.g == "b"} == {(1, 0, 2), (3, 1, 2)}


def test_rolling_and_running_over_block_borders(spark):
    rng = random.Random(4)
    data = [rng.randint(0, 9) for _ in range(333)]
    df = spark.createDataFrame([("a", n, v) for n, v in enumerate(data)], "g string, seq bigint, v int")
    rolled = ordering.rolling_means(df, {"m": "v"}, 10, by=["g"], block=16)
    got = {r.seq: r.m for r in rolled.collect()}
    assert len(got) == 333
    for n in range(333):
        window = data[max(0, n - 9): n + 1]
        assert abs(got[n] - sum(window) / len(window)) < 1e-9
    totals = {r.seq: r.t for r in ordering.running_totals(df, {"t": "v"}, by=["g"], block=16).collect()}
    assert totals == {n: sum(data[: n + 1]) for n in range(333)}


def test_qualitative_samples(spark):
    df = spark.range(400).select(F.col("id").alias("pos"), F.repeat(F.lit("x"), 600).alias("t"))
    got = runlog.qualitative_samples(df, 4, ["pos"], "t").collect()
    assert sorted(r.pos for r in got) == [0, 1, 200, 201] and {len(r.snippet) for r in got} == {500}


def test_split_takes_rounded_share_of_each_label(spark):
    df = spark.range(110).select("id", F.when(F.col("id") < 10, "rare").otherwise("hot").alias("label"))
    order = [F.xxhash64("id", F.lit(42)), "id"]
    folds = corpus.split_train_validation(df, "label", 0.2, order)
    got = {(r.label, r.fold): r["count"] for r in folds.groupBy("label", "fold").count().collect()}
    assert got == {("rare", "validation"): 2, ("rare", "train"): 8, ("hot", "validation"): 20, ("hot", "train"): 80}


def test_first_per_key_and_new_rows(spark):
    rows = spark.createDataFrame(
        [("train", "1", 5, "b"), ("train", "1", 2, "a"), ("test", "1", 9, "c"), ("test", "2", 1, "d")],
        "split string, sample_id string, seq int, v string",
    )
    existing = spark.createDataFrame([("test", "2")], "split string, sample_id string")
    got = corpus.new_rows(rows, existing, "seq").collect()
    assert {(r.split, r.sample_id, r.v) for r in got} == {("train", "1", "a"), ("test", "1", "c")}
