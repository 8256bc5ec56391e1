from __future__ import annotations

import math
import random

import numpy as np

from reasonmill.functions import similarity, stem
from reasonmill.operators import textquality


def plain_lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for n, y in enumerate(b):
            new.append(line[n] + 1 if x == y else max(new[n], line[n + 1]))
        line = new
    return line[-1]


def test_lcs_equals_table():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        assert similarity.lcs_length(a, b) == plain_lcs(a, b)


def test_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop",
        "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
        "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope",
        "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "rate": "rate",
        "controll": "control", "dying": "die", "flies": "fli", "enjoy": "enjoy", "geology": "geolog",
    }
    assert {w: stem.porter(w) for w in known} == known


def test_meteor_by_hand():
    assert similarity.meteor_score("the cat sat", "dogs run") == 0.0
    # all three words match in one chunk
    assert math.isclose(similarity.meteor_score("the cat sat", "The cat sat"), 1 - 0.5 * (1 / 3) ** 3)
    # stem match, two chunks: precision 2/3, recall 2/2
    mean = (2 / 3) / (0.9 * 2 / 3 + 0.1)
    assert math.isclose(similarity.meteor_score("cats sit", "sitting now cat"), mean * (1 - 0.5 * (2 / 2) ** 3))


def test_pair_scores(spark):
    rows = spark.createDataFrame(
        [(1, "The gyro_x rises, walking", "gyro_x walked"), (2, "plain", "gyro_x"), (3, "", "x"), (4, "a b", "!")],
        "id int, r string, g string",
    )
    got = {r.id: r for r in textquality.text_scores(rows, ["id"], ["gyro_x", "acc_y", "Rises"], "r", "g").collect()}
    # tokens the gyro x rises walk / gyro x walk
    assert math.isclose(got[1].rouge_l, 2 * 1.0 * 0.6 / 1.6)
    assert (got[1].sensor_term_recall, got[2].sensor_term_recall) == (1.0, None)
    assert (got[3].rouge_l, got[4].rouge_l, got[3].meteor) == (0.0, 0.0, 0.0)


def test_vector_f1_equals_brute_force_over_many_cells(spark):
    rng = np.random.default_rng(5)
    vectors = {
        (s, side): rng.normal(size=(n, 4)) for s, a, b in ((1, 23, 17), (2, 1, 3)) for side, n in (("reference", a), ("generated", b))
    }
    rows = [(s, side, p, [float(x) for x in v]) for (s, side), m in vectors.items() for p, v in enumerate(m)]
    df = spark.createDataFrame(rows, "sample_id int, side string, pos int, vec array<double>")
    unit = {k: m / np.linalg.norm(m, axis=1, keepdims=True) for k, m in vectors.items()}
    for r in textquality.vector_f1(df, block_size=3, blocks_per_cell=2).collect():
        cosine = unit[r.sample_id, "generated"] @ unit[r.sample_id, "reference"].T
        p, q = cosine.max(axis=1).mean(), cosine.max(axis=0).mean()
        assert np.allclose([r.vector_precision, r.vector_recall, r.vector_f1], [p, q, 2 * p * q / (p + q)])
