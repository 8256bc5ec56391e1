from __future__ import annotations

import random
from itertools import permutations

from pyspark.sql import functions as F

from reasonmill import registry
from reasonmill.functions.assign import best_assignment
from reasonmill.operators import matching
from reasonmill.plans import match


def brute(pairs):
    rows, cols = sorted({i for i, _ in pairs}), sorted({j for _, j in pairs})
    slots = cols + [None] * max(0, len(rows) - len(cols))
    best = None
    for chosen in set(permutations(slots, len(rows))):
        taken = [(i, j) for i, j in zip(rows, chosen, strict=True) if j is not None]
        if len(taken) != min(len(rows), len(cols)):
            continue
        hits = [pairs[t] for t in taken if pairs[t][0] == 0]
        order = tuple(len(cols) if j is None else cols.index(j) for j in chosen)
        key = (sum(pairs[t][0] for t in taken), -len(hits), -sum(b for _, b in hits), order)
        if best is None or key < best[0]:
            best = (key, taken)
    return best[1]


def test_assignment_equals_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        pairs = {(i, j + 3): (rng.choice([0, 1, 2, 2]), rng.randint(0, 1)) for i in range(n) for j in range(m)}
        assert sorted(best_assignment(pairs)) == sorted(brute(pairs))


def trace(observations, inferences=(), synthesis=None):
    parts = [
        f"[OBSERVATION | id: {i}]\nsensor: {s}\ntemporal: {w}\npattern: {p}\nconfidence: high\n"
        for i, s, w, p in observations
    ]
    parts += [f"[INFERENCE | id: {i}]\nbased_on: {b}\ninference: {t}\nconfidence: low\n" for i, b, t in inferences]
    if synthesis:
        parts.append(f"[SYNTHESIS]\nbased_on: I1\n{synthesis}\n")
    return "".join(parts)


ROWS = "sample_id string, gt_activity string, predicted_activity string, ground_truth_reasoning string, generated string"


def test_scores_of_one_sample(spark):
    gt = trace(
        [("O1", "Body Acceleration X", "early", "rises"), ("O2", "body_acc_x", "late", "falls"),
         ("O3", "gyro_z", "mid", "flat"), ("O4", " ", "mid", "flat")],
        [("I1", "O1, O2", "steps"), ("I2", "O3", "turn")], "walks",
    )
    pred = trace(
        [("O1", "body_acc_x", "late", "falls"), ("O2", "body-acc x", "mid", "rises")],
        [("I1", "O1, O2, O7", "steps")], "walks",
    )
    rows = spark.createDataFrame(
        [("a", "walking", "walking", gt, pred), ("b", "walking", "sitting", "", pred),
         ("c", "walking", "sitting", gt, None), ("d", "walking", "sitting", gt, "x"), ("e", "x", "y", "x", pred)],
        ROWS,
    )
    verdicts = spark.createDataFrame(
        [("a", "observation", 0, 1, "YES"), ("a", "observation", 1, 0, "yes"), ("a", "observation", 0, 0, "no"),
         ("a", "observation", 1, 1, "NO"), ("a", "inference", 0, 0, "YES"), ("a", "inference", 0, 0, "NO"),
         ("a", "synthesis", 0, 0, "NO"), ("z", "observation", 5, 5, "YES")],
        "sample_id string, kind string, i int, j int, response string",
    )
    scored = match.scores(rows, registry.lookup("ucihar"), verdicts).persist()
    got = {r.sample_id: r for r in matching.sample_table(scored, ["sample_id"]).collect()}
    a = got["a"]
    assert (a.n_gt_obs, a.n_pred_obs, a.obs_hits, a.obs_misses, a.obs_hallucinations) == (4, 2, 2, 2, 0)
    assert (a.snm_op, a.snm_or, a.snm_o_temporal, a.snm_o_cover) == (1.0, 0.5, 0.5, 0.5)
    assert (a.inf_hits, a.snm_ip, a.snm_ir) == (1, 1.0, 0.5)
    assert abs(a.snm_iprov_abs - 2 / 3) < 1e-9 and a.snm_iprov_clean == 0.0
    assert abs(a.snm_iprov_penalised - (1 - 1 / 3)) < 1e-9
    assert (a.synthesis_judge, a.snm_sa) == ("NO", 0.0)
    assert {k: r.skip_reason for k, r in got.items()} == {
        "a": None, "b": "no_gt_reasoning", "c": "no_pred_text", "d": "pred_parse_fail", "e": "gt_parse_fail",
    }
    matches = matching.match_table(scored, ["sample_id"]).collect()
    assert {(m.gt_id, m.judge_verdict) for m in matches} == {("O1", "YES"), ("O2", "YES"), ("O3", "NO_PRED_COVERAGE")}
    total = {r.stratum: (r.n_total, r.n_scored) for r in matching.summary(scored).collect()}
    assert total == {"all": (5, 1), "correct": (1, 1), "incorrect": (0, 0)}


def test_requests_and_relaxed_mode(spark):
    gt = trace([("O1", "gyro_z", "early", "rises")], [("I1", "O1", "turn")])
    pred = trace([("O1", "gyro_z", "late", "rises"), ("O2", "gyro_z", "early_to_mid", "falls")])
    rows = spark.createDataFrame([("a", "x", "x", gt, pred)], ROWS)
    relaxed = match.requests(rows, registry.lookup("ucihar"), relaxed=True).collect()
    assert [(r.kind, r.i, r.j, r.auto_verdict, r.request is None) for r in relaxed] == [
        ("observation", 0, 0, "NO", True), ("observation", 0, 1, None, False),
    ]
    strict = match.requests(rows, registry.lookup("ucihar")).collect()
    assert all(r.request and r.auto_verdict is None for r in strict)


def test_contested_and_settled_samples_agree_with_the_solver(spark):
    rng = random.Random(3)
    rows, verdicts = [], []
    for n in range(60):
        sid = str(n)
        gt = [(f"O{i}", rng.choice(["gyro_x", "gyro_y"]), "mid", "p") for i in range(1, rng.randint(2, 6))]
        pred = [(f"O{i}", rng.choice(["gyro_x", "gyro_y"]), "mid", "p") for i in range(1, rng.randint(2, 6))]
        rows.append((sid, "x", "x", trace(gt), trace(pred)))
        for i, g in enumerate(gt):
            for j, p in enumerate(pred):
                if g[1] == p[1]:
                    verdicts.append((sid, "observation", i, j, rng.choice(["YES", "NO", "NO", "NO", "hm"])))
    scored = match.scores(
        spark.createDataFrame(rows, ROWS), registry.lookup("ucihar"),
        spark.createDataFrame(verdicts, "sample_id string, kind string, i int, j int, response string"),
    )
    got = scored.select("sample_id", F.expr("aggregate(obs_matches, 0D, (a, m) -> a + m.cost)").alias("c"),
                        "obs_hits", "n_gt_obs").collect()
    cost = {"YES": 0, "NO": 2, "hm": 1}
    for r in got:
        groups: dict = {}
        for sid, _, i, j, v in verdicts:
            if sid == r.sample_id:
                sensor = [line for line in rows[int(sid)][3].split("\n") if line.startswith("sensor")][i]
                groups.setdefault(sensor, {})[i, j] = (cost[v], 1)
        solved = [(g, t) for g in groups.values() for t in brute(g)]
        hits = sum(g[t][0] == 0 for g, t in solved)
        total = sum(g[t][0] / 2 for g, t in solved) + (r.n_gt_obs - len(solved))
        assert (r.obs_hits, r.c) == (hits, total)
