"""The matching over Arrow batches: one shuffle of verdicts, whatever their number."""

from __future__ import annotations

import random

import pyarrow as pa

from reasonmill import registry
from reasonmill.functions import matches
from reasonmill.functions.assign import best_assignment
from reasonmill.plans import match

ROWS = "sample_id string, gt_activity string, predicted_activity string, ground_truth_reasoning string, generated string"


def test_chosen_pairs_equal_the_solver():
    rng = random.Random(5)
    for _ in range(400):
        n, m, verdicts = rng.randint(1, 4), rng.randint(1, 4), rng.choice([(0, 1, 2), (0, 2, 2)])
        edges = [(0, i, j, rng.choice(verdicts), rng.randint(0, 1), None) for i in range(n) for j in range(m)]
        got = [(e[1], e[2]) for e in matches.assigned(edges)]
        solved = best_assignment({(e[1], e[2]): (e[3], e[4]) for e in edges})
        facts = lambda chosen: sorted(e[3] for e in edges if (e[1], e[2]) in chosen)  # noqa: B023, E731
        assert facts(got) == facts(solved)
        if any(e[3] == 1 for e in edges):
            assert got == sorted(solved)


def test_a_key_goes_on_over_batches_and_keeps_one_verdict_of_each_pair():
    side = lambda n: {
        "obs": {"id": [f"O{i}" for i in range(n)], "sensor": ["s"] * n, "temporal": ["mid"] * n},
        "inf": {"id": [], "based_on": []}, "syn": None,
    }
    names = pa.list_(pa.string())
    graph = pa.struct([
        ("obs", pa.struct([("id", names), ("sensor", names), ("temporal", names)])),
        ("inf", pa.struct([("id", names), ("based_on", pa.list_(names))])), ("syn", pa.struct([("present", pa.bool_())])),
    ])
    schema = pa.schema([
        ("sample_id", pa.string()), ("skip_reason", pa.string()), ("gt", graph), ("pred", graph), ("_answer", pa.bool_()),
        ("_place", pa.int64()), ("_rank", pa.int32()),
    ])
    base = matches.PAIR_BASE
    sample = lambda key, n: (key, None, side(n), side(1), False, None, None)
    answer = lambda key, i, j, rank: (key, None, None, None, True, (base + i) * base + j, rank)
    rows = [sample(None, 1), sample("a", 2), answer("a", 0, 0, 1), answer("a", 7, 7, 2), answer("a", 1, 0, 0), answer("a", 0, 0, 2),
            answer("a", 1, 0, 1), answer("b", 0, 0, 2), answer("b", 0, 0, 2), sample("c", 1), sample("d", 1), answer("d", 0, 0, 2)]
    for size in (1, 2, 3, 5, 100):
        batches = [
            pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[n : n + size]], schema)
            for n in range(0, len(rows), size)
        ]
        got = [r for b in matches.judged_batches(batches, ("sample_id",), False, 1) for r in b.to_pylist()]
        assert [(r["sample_id"], [(p["i"], p["j"], p["verdict"]) for p in r["pairs"]]) for r in got] == [
            (None, [(0, 0, None)]), ("a", [(0, 0, "YES"), (1, 0, "NO")]), ("c", [(0, 0, None)]), ("d", [(0, 0, "YES")]),
        ]


def test_pairs_and_verdicts_are_shuffled_once(spark):
    rows = spark.createDataFrame([("a", "x", "x", "", "")], ROWS)
    verdicts = spark.createDataFrame([("a", "observation", 0, 0, "YES")], "sample_id string, kind string, i int, j int, response string")
    plan = match.scores(rows, registry.lookup("ucihar"), verdicts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Aggregate" not in plan and "Join" not in plan
