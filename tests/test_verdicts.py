"""Resumable verdicts: every different request is asked once, in bounded batches, until nothing is open."""

from __future__ import annotations

from pyspark.sql import functions as F

from reasonmill import registry
from reasonmill.operators import matching, verdicts
from reasonmill.plans import match
from reasonmill.sources import derived

FOLDER = "/root/testdata/sf0.001"


def test_calls_end_and_feed_the_matching(spark):
    rows = derived.eval_rows(spark, FOLDER).withColumn("predicted_activity", F.col("gt_activity")).checkpoint()
    dataset = registry.lookup("ucihar")
    requests = match.requests(rows, dataset).checkpoint()
    different = requests.select("kind", "request").distinct().count()
    answers, asked = None, 0
    while True:
        todo = verdicts.batches(requests, answers, size=50)
        per_batch = {r.batch: r["count"] for r in todo.groupBy("batch").count().collect()}
        if not per_batch:
            break
        assert set(per_batch) == set(range(len(per_batch))) and all(n == 50 for b, n in per_batch.items() if b + 1 < len(per_batch))
        # The judge stops after two thirds of the batches of a call.
        done = todo.where(F.col("batch") <= len(per_batch) * 2 // 3).select(
            "request_id", F.when(F.length("request") % 3 == 0, "YES").otherwise("NO").alias("response")
        ).checkpoint()
        asked += done.count()
        answers = done if answers is None else answers.unionByName(done)
    assert asked == different
    given = verdicts.responses(requests, answers, ["sample_id"])
    assert given.count() == requests.count()
    direct = requests.select("sample_id", "kind", "i", "j", F.when(F.length("request") % 3 == 0, "YES").otherwise("NO").alias("response"))
    one, two = (matching.summary(match.scores(rows, dataset, v)).orderBy("stratum").collect() for v in (given, direct))
    assert [r.n_scored for r in one] == [r.n_scored for r in two] and one[0].snm_of1 is not None
    assert all(a == b or abs(a - b) < 1e-9 for x, y in zip(one, two) for a, b in zip(tuple(x)[6:], tuple(y)[6:]) if a is not None)


def test_automatic_verdicts_are_not_asked_and_the_least_answer_counts(spark):
    requests = spark.createDataFrame(
        [("a", "observation", 0, 0, "text", None), ("b", "observation", 1, 0, "text", None), ("b", "inference", 0, 0, "text", None),
         ("c", "observation", 0, 0, None, "NO")], "sample_id string, kind string, i int, j int, request string, auto_verdict string",
    )
    todo = {(r.kind, r.n_pairs): r.request_id for r in verdicts.open_requests(requests).collect()}
    assert sorted(todo) == [("inference", 1), ("observation", 2)]
    answers = spark.createDataFrame([(todo["observation", 2], "YES"), (todo["observation", 2], "NO")], "request_id string, response string")
    got = sorted(tuple(r) for r in verdicts.responses(requests, answers, ["sample_id"]).collect())
    assert got == [("a", "observation", 0, 0, "NO"), ("b", "observation", 1, 0, "NO")]
    assert [r.kind for r in verdicts.batches(requests, answers).collect()] == ["inference"]
