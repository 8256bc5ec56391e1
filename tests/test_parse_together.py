"""Plain traces are cut together, sensor names are told in Python; both as the patterns and expressions do."""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import functions as F

from reasonmill import registry
from reasonmill.functions import parse, vocab
from reasonmill.operators import matching
from reasonmill.sources import derived

SF = "/root/testdata/sf0.001"


def test_plain_and_damaged_traces_give_the_graphs_of_the_patterns(spark):
    rows = derived.eval_rows(spark, SF).select("generated", "ground_truth_reasoning").toArrow()
    texts = [t or "" for c in rows.columns for t in c.to_pylist()]
    plain = pa.array(texts)
    assert parse._together(plain, False)[1].all()
    assert parse._parse(plain, False).equals(parse._one_by_one(plain, False))
    rng = random.Random(4)
    bits = ("[", "]", "\n", "\r\n", " ", "[ACTIVITY]", "[SYNTHESIS]\nbased_on: I1", "[observation | id: O1]\n", "é", "ſ", "O٣", "\x1c", "")
    for n in range(len(texts)):
        i = rng.randrange(len(texts[n]) + 1)
        texts[n] = texts[n][:i] + rng.choice(bits) + texts[n][i + rng.choice((0, 0, 1, 5)):]
    damaged = pa.array([*texts, None, "", "["])
    assert not parse._together(damaged.fill_null(""), False)[1].all()
    for case in (False, True):
        assert parse._parse(damaged, case).equals(parse._one_by_one(damaged, case))


def test_sensor_names_in_python_equal_the_expression(spark):
    names = [*derived.RAW_SENSORS, "", " ", "Left Ankle acc-x", "left_pocket^gyr", "a²b", "Ⓐ-x", "naïve__y", "hand‿acc", "^", "İ x", "GYROSCOPE Z"]
    for dataset in ("ucihar", "pamap2"):
        sensors = registry.lookup(dataset).sensors
        df = spark.createDataFrame([(n,) for n in [*names, *sensors]], "raw string")
        got = df.select("raw", vocab.canonical_sensor("raw", sensors).alias("c")).select("raw", "c.*").collect()
        of = vocab.sensor_names(sensors)
        assert [(r.name, r.resolved) for r in got] == [of(r.raw) for r in got]


def test_orders_of_any_sign_and_without_numbers_are_rendered(spark, tmp_path):
    rows = [(5, 23, 100.0), (6, 24, 1.5), (-7, 8, 3.0), (8, -40, 9.99), (None, 3, 1.0), (4, None, 2.0), (9, 41, None), (41, 7, 88.25)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    by_expression = derived._eval_rows(derived.orders_relation(spark, str(tmp_path)))
    both = [sorted(map(tuple, df.collect()), key=repr) for df in (derived.eval_rows(spark, str(tmp_path)), by_expression)]
    assert both[0] == both[1] and len(both[0]) == len(rows)
    whole = [df.select(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first() for df in (
        derived.eval_rows(spark, SF), derived._eval_rows(derived.orders_relation(spark, SF)))]
    assert whole[0] == whole[1]


def test_open_names_alone_equal_those_of_the_prepared_rows(spark):
    rows = derived.eval_rows(spark, SF)
    sensors = registry.lookup("pamap2").sensors
    prepared = matching.prepare(rows.withColumn("predicted_activity", F.lit("x")), sensors, ["sample_id"])
    assert sorted(matching.unresolved_sensors(prepared).collect()) == sorted(matching.unresolved_sensors_of(rows, sensors).collect())
