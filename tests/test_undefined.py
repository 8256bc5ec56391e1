"""Undefined values, missing texts and empty inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from reasonmill.functions import similarity
from reasonmill.operators import classification, corpus, matching, textquality
from reasonmill.sources import documents


def test_sample_with_vectors_on_one_side_keeps_its_row(spark):
    rows = [(1, "reference", 0, [1.0, 0.0]), (1, "generated", 0, [1.0, 0.0]), (2, "reference", 0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "sample_id long, side string, pos long, vec array<double>")
    got = {r.sample_id: r for r in textquality.vector_f1(df).collect()}
    assert got[1].vector_f1 == 1.0 and got[2].vector_f1 is None and got[2].vector_recall is None


def test_missing_text_scores_like_a_blank_one(spark):
    df = spark.createDataFrame([("a b", None), ("a b", ""), (None, "a b"), (None, None)], "r string, g string")
    assert [tuple(r) for r in df.select(similarity.rouge_l("r", "g"), similarity.meteor("r", "g")).collect()] == [(0.0, 0.0)] * 4


def test_empty_input_has_a_zero_row_for_each_label(spark):
    none = spark.createDataFrame([], "gt_activity string, predicted_activity string")
    got = classification.class_report(none, ["walk", "sit", "unknown"]).collect()
    assert sorted(r.label for r in got) == ["sit", "unknown", "walk"]
    assert all((r.precision, r.recall, r.f1, r.support) == (0.0, 0.0, 0.0, 0) for r in got)
    total = classification.summary(none, ["walk", "sit", "unknown"]).first()
    assert (total.n, total.accuracy, total.macro_f1) == (0, None, 0.0)
    one = spark.createDataFrame([("walk", "walk")], none.schema)
    assert classification.summary(one, ["walk", "sit"]).first().n == 1


def test_three_strata_whatever_the_samples(spark):
    ddl = "gt_activity string, predicted_activity string, snm_skipped boolean, skip_reason string, " + ", ".join(
        f"{c} double" for c in matching.SCORES)
    scores = (0.5,) * len(matching.SCORES)
    rows = [("a", "a", False, None, *scores), ("a", "b", True, "pred_parse_fail", *[None] * len(scores))]
    for some, counts in ((rows, {"all": 2, "correct": 1, "incorrect": 0}), ([], {"all": 0, "correct": 0, "incorrect": 0})):
        got = {r.stratum: r for r in matching.summary(spark.createDataFrame(some, ddl)).collect()}
        assert {k: r.n_total for k, r in got.items()} == counts
        assert got["incorrect"].snm_of1 is None and got["all"].snm_of1 == (0.5 if some else None)
    by = spark.createDataFrame(rows, ddl).withColumn("run", F.lit("x"))
    assert matching.summary(by, ["run"]).count() == 3


def test_nan_confidence_is_undefined(spark):
    rows = [("walk", 10, 0.5, False), ("walk", 10, float("nan"), False)]
    df = spark.createDataFrame(rows, "activity string, n_tokens int, confidence double, anomaly boolean")
    assert corpus.class_summary(df).first().avg_confidence == 0.5


def test_file_numbers_of_any_length(spark):
    names = ["a_10.json", "a_9.json", "none.json", "a_" + "1" * 60 + ".json", "a_007.json"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = [r.t for r in df.orderBy(documents.numeric_order("t"), "t").collect()]
    assert got == ["none.json", "a_007.json", "a_9.json", "a_10.json", "a_" + "1" * 60 + ".json"]
    texts = spark.createDataFrame([("s", "old", names[0]), ("s", "new", names[3])], "sample_id string, reference string, file_name string")
    assert documents.latest_reference(texts).first().reference == "new"
