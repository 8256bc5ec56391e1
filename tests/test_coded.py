"""Samples scored as integers have the scores, requests and open names that they have by name."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reasonmill import registry
from reasonmill.functions import coded, matches, text
from reasonmill.operators import matching
from reasonmill.plans import match
from reasonmill.sources import derived

FOLDER = "/root/testdata/sf0.001"
ROWS = "sample_id string, gt_activity string, ground_truth_reasoning string, generated string"
VERDICTS = "sample_id string, kind string, i int, j int, response string"
SENSORS = ("gyro_z", "GYRO-Z", "Body Acceleration X", "body_acc_x", "heart_rate", "knee", " ", "é-x", "hand_acc_16g_x")
WINDOWS = ("early", "mid", "late", "throughout", "full_window", "dusk", "Mid ")
RESPONSES = ("YES", "yes\nno", "No.", "I say no", "maybe yes", "ſtill yeſ", " \x1cno", "hm", "", None, "\nYES", "ja")


def rounded(df, *by):
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def odd_samples(seed, n):
    """Traces with nodes that share ids, sensors and windows, some broken, and verdicts that repeat or have no pair."""
    rng = random.Random(seed)
    head = lambda word: rng.choice((f"[{word} | id: ", f"[{word.lower()}|id:"))
    cited = lambda: ", ".join(rng.choice(("O1", "O2", "O3", "o2", "O9", "")) for _ in range(rng.randint(1, 4)))

    def trace():
        parts = [
            f"{head('OBSERVATION')}O{rng.randint(1, 4)}]\nsensor: {rng.choice(SENSORS)}\ntemporal: {rng.choice(WINDOWS)}\npattern: p\nconfidence: high\n"
            for _ in range(rng.randint(0, 5))
        ]
        parts += [f"{head('INFERENCE')}I{i}]\nbased_on: {cited() or 'O1'}\ninference: t\nconfidence: low\n" for i in range(rng.randint(0, 4))]
        if rng.random() < 0.7:
            parts.append("[SYNTHESIS]\nbased_on: I1\nwalks\n")
        parts.append(rng.choice((
            "[ACTIVITY]: Walking", "[activity] : sitting_down \r\nmore", "walking", "[ACTIVITY]:", "[ACTIVITY]:\n standing", "[ACTİVITY]: Laying",
            "[ACTIVITY]: Ärger\n[ACTIVITY]: walking", "the body is LAYING", "[ACTIVITY]:  Lying down", "")))
        whole = "".join(parts)
        return rng.choice((whole, whole, whole, whole, None, " \n", whole.replace("]", "", 1), whole.replace("\n", "\r\n")))

    rows, verdicts = [], []
    for k in range(n):
        key = rng.choice((str(k), str(k), str(k // 3), None))
        rows.append((key, rng.choice(("walking", "sitting", None)), trace(), trace()))
        verdicts += [
            (key, rng.choice(("observation", "inference", "inference", "synthesis", "other", None)), rng.choice((-1, 0, 0, 1, 2, 3, 4)), rng.choice((0, 0, 1, 2, 3, None)),
             rng.choice(RESPONSES)) for _ in range(rng.randint(0, 30))
        ]
    rng.shuffle(rows)
    if seed % 2:
        rng.shuffle(verdicts)
    return rows, verdicts


def same_scores(rows, verdicts, dataset, relaxed):
    labelled = rows.withColumn("predicted_activity", text.predicted_activity("generated", dataset.classes))
    named = match.scores(labelled, dataset, verdicts, relaxed=relaxed).checkpoint()
    opened = registry.lookup("pamap2").sensors
    samples = match.coded_samples(rows, dataset, open_sensors=opened).checkpoint()
    scored = match.sample_scores(samples, verdicts, relaxed=relaxed).checkpoint()
    assert rounded(matching.sample_table(scored, ["sample_id"])) == rounded(matching.sample_table(named, ["sample_id"]))
    for column, way in (("n_requests", False), ("n_relaxed_requests", True)):
        asked = match.requests(labelled, dataset, relaxed=way).where("request is not null").count()
        assert matching.summary(scored, sums=[column]).where("stratum = 'all'").first()[column] == asked
    assert rounded(matching.open_counts(samples)) == rounded(matching.unresolved_sensors_of(rows, opened))


def test_scores_equal_those_by_name_on_derived_rows(spark):
    same_scores(derived.eval_rows(spark, FOLDER).checkpoint(), derived.verdict_rows(spark, FOLDER).checkpoint(), registry.lookup("ucihar"), False)


@pytest.mark.parametrize("seed, relaxed", [(1, False), (2, True)])
def test_scores_equal_those_by_name_on_odd_rows(spark, seed, relaxed):
    rows, verdicts = odd_samples(seed, 250)
    same_scores(spark.createDataFrame(rows, ROWS).checkpoint(), spark.createDataFrame(verdicts, VERDICTS).checkpoint(), registry.lookup("ucihar"), relaxed)


def test_several_datasets_equal_those_by_name(spark):
    rows, verdicts = odd_samples(3, 250)
    k = F.crc32(F.coalesce("sample_id", F.lit("")))
    tagged = lambda df: df.withColumn("dataset", F.when(k % 4 == 0, "PAMAP2").when(k % 4 == 1, "elsewhere").when(k % 4 == 2, "ucihar")).checkpoint()
    rows, verdicts = tagged(spark.createDataFrame(rows, ROWS)), tagged(spark.createDataFrame(verdicts, VERDICTS))
    own = [registry.Dataset("Pamap2", ("walking up", "walking"), ("knee", "gyro_z"), ("x",))]
    keys = ("dataset", "sample_id")
    for datasets in (None, own):
        named = match.scores_of_datasets(rows, verdicts, datasets=datasets)
        scored = match.sample_scores(match.coded_samples_of_datasets(rows, datasets=datasets), verdicts, keys)
        assert rounded(matching.sample_table(scored, keys)) == rounded(matching.sample_table(named, keys))


def test_hits_equal_the_assignment_pair_by_pair():
    rng = random.Random(9)
    for _ in range(300):
        edges, group = [], 0
        for group in range(rng.randint(1, 4)):
            rows, columns = rng.randint(1, 4), rng.randint(1, 4)
            costs = rng.choice([(0, 1, 2), (0, 2, 2), (1, 2), (2, 2, 2, 0)])
            edges.append([(group, i, j, rng.choice(costs), rng.randint(0, 1), None) for i in range(rows) for j in range(columns)])
        flat = [e for g in edges for e in g]
        fields = [np.array([e[n] for e in flat]) for n in range(5)]
        got = [e for e, hit in zip(flat, coded._hits(*fields[:4], fields[4] == 1), strict=True) if hit]
        assert got == [e for g in edges for e in matches.assigned(g) if e[3] == 0]


def test_a_key_goes_on_over_batches_and_keeps_one_verdict_of_each_pair():
    names = ["sample_id", "skip_reason", "nodes", "_codes", "_answer"]
    schema = pa.schema(list(zip(names, [pa.string(), pa.string(), pa.binary(), pa.binary(), pa.bool_()], strict=True)))
    side = lambda n: [x for i in range(n) for x in (0, 2, i)]
    sample = lambda key, n: (key, None, np.array([n, 1, 0, 0, 0, *side(n), *side(1)], np.int32).tobytes(), None, False)
    code = lambda i, j, rank: ((matches.PAIR_BASE + i) * matches.PAIR_BASE + j) * coded.RANKS + rank
    answer = lambda key, *codes: (key, None, None, np.array(codes, np.int64).tobytes(), True)
    rows = [sample(None, 1), sample(None, 2), sample(None, 1), sample("a", 2), answer("a", code(0, 0, 1), code(7, 7, 2)), answer("a", code(1, 0, 0)), answer("a", code(0, 0, 2)),
            answer("a", code(1, 0, 1)), answer("b", code(0, 0, 2)), answer("b"), sample("c", 1), sample("c", 1), sample("d", 1), answer("d", code(0, 0, 2))]
    for size in (1, 2, 3, 5, 100):
        batches = [
            pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[n : n + size]], schema) for n in range(0, len(rows), size)
        ]
        got = [r for b in coded.counted_batches(batches, ("sample_id",), ("sample_id",), False, 1) for r in b.to_pylist()]
        assert [(r["sample_id"], r["n_gt_obs"], r["obs_hits"]) for r in got] == [(None, 1, 0), (None, 2, 0), (None, 1, 0), ("a", 2, 1), ("c", 1, 0), ("c", 1, 0), ("d", 1, 1)]


def test_work_in_parts_gives_the_same(monkeypatch, spark):
    rows, verdicts = odd_samples(5, 60)
    rows, verdicts = spark.createDataFrame(rows, ROWS), spark.createDataFrame(verdicts, VERDICTS)
    samples = match.coded_samples(rows, registry.lookup("ucihar")).checkpoint()
    plan = matching.counted(samples, verdicts, ["sample_id"])
    table = samples.withColumns({"_codes": F.lit(None).cast("binary"), "_answer": F.lit(False)}).toArrow().combine_chunks().sort_by("sample_id")
    run = lambda: [r for b in coded.counted_batches(table.to_batches(), ("sample_id",), ("sample_id", "skip_reason"), False, 1) for r in b.to_pylist()]
    whole = run()
    monkeypatch.setattr(coded, "_MOST", 3)
    assert run() == whole and len(whole) == 60 and plan.count() == 60


def test_ranks_equal_the_expression(spark):
    texts = [*RESPONSES, "no\u2028YES", "\u3000yes", "NÖ", "the Knot", "\n", "Yes\x00no"]
    got = spark.createDataFrame([(x,) for x in texts], "response string").select(text.verdict_of("response").alias("v")).collect()
    assert [r.v for r in got] == [matches.VERDICTS[coded._rank((x or "").encode())] for x in texts]


def test_verdict_rows_equal_the_expressions(spark, tmp_path):
    rows = [(5, 23, 100.0), (6, 24, 1.5), (-7, 8, 3.0), (8, -40, 9.99), (None, 3, 1.0), (4, None, 2.0), (9, 41, None), (41, 7, 88.25), (9, 41, 5.5)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    for folder in (str(tmp_path), FOLDER):
        got, want = derived.verdict_rows(spark, folder), derived._verdict_rows(derived.orders_relation(spark, folder))
        assert got.schema == want.schema and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_the_summary_of_datasets_reads_each_text_once_and_shuffles_packed_verdicts(spark):
    plan = entry.dataset_match_summary(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow ") == 3 and "ArrowEvalPython" not in plan


def test_the_document_reads_each_text_once(spark, monkeypatch):
    read = []
    build = matching.coded
    monkeypatch.setattr(matching, "coded", lambda *a, **k: read.append(1) or build(*a, **k))
    for name in ("prepare", "unresolved_sensors_of", "judge_requests"):
        monkeypatch.setattr(matching, name, lambda *a, **k: pytest.fail("the texts are read again"))
    assert {r.stratum for r in entry.match_document(spark, FOLDER).collect()} == {"all", "correct", "incorrect"} and read == [1]
