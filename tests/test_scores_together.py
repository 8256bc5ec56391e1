"""Text scores of whole batches equal those of single pairs."""

from __future__ import annotations

import random
import re

import pyarrow as pa

from reasonmill.functions import similarity
from reasonmill.functions.stem import porter
from reasonmill.functions.similarity import STEM_FROM


def pairs(n=300):
    rng = random.Random(7)
    words = ["walk", "Walking", "walks", "the", "a", "signal", "signals", "GYRO_z", "x,y", "İx", "Kelvin", "naïve", "日本", "", "--", "acc-x"]
    text = lambda: rng.choice((" ", "\n", "  ")).join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 60, 64, 65, 150, 700))))
    return [(text(), text()) for _ in range(n)] + [(None, "a"), ("a", None), (None, None), ("", ""), (" - ", "a")]


def test_overlap_of_a_batch_equals_single_pairs():
    texts = pairs()
    a, b = (pa.array(side) for side in zip(*texts, strict=True))
    for stem, form in ((False, str), (True, lambda t: porter(t) if len(t) >= STEM_FROM else t)):
        got = similarity._overlap(a, b, form).to_pylist()
        for (x, y), row in zip(texts, got, strict=True):
            x, y = (re.findall("[a-z0-9]+", (t or "").lower()) for t in (x, y))
            assert (row["n_ref"], row["n_gen"]) == (len(x), len(y))
            assert row["common"] == similarity.lcs_length([form(t) for t in x], [form(t) for t in y]), stem


def test_long_lists_and_large_vocabularies():
    rng = random.Random(1)
    long = [" ".join(f"w{rng.randrange(30_000)}" for _ in range(n)) for n in (513, 900, 200, 200, 40_000, 30)]
    a, b = pa.array(long), pa.array([long[1], long[1][500:], long[3], long[2] + long[0][:90], long[0], long[4]])
    for x, y, row in zip(a.to_pylist(), b.to_pylist(), similarity._overlap(a, b, str).to_pylist(), strict=True):
        assert row["common"] == similarity.lcs_length(x.split(), y.split())


def test_meteor_of_a_batch_equals_single_pairs():
    texts = pairs()
    a, b = (pa.array(side) for side in zip(*texts, strict=True))
    assert similarity.meteor_scores(a, b) == [similarity.meteor_score(x or "", y or "") for x, y in texts]
    assert similarity.meteor_scores(a[:0], b[:0]) == []
    plain = [(x, y) for x, y in texts if (x or "").isascii() and (y or "").isascii()]
    plain += [("a\x1cb\x0bc d", "a b\x1fc\x85d".replace("\x85", " ")), ("", "a"), (" a", "a ")]
    assert similarity.meteor_scores(*(pa.array(side)[1:] for side in zip(*plain, strict=True))) == [
        similarity.meteor_score(x or "", y or "") for x, y in plain[1:]]
