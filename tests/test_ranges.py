"""Missing and doubled ranges of indices against plain Python, over several partitions."""

from __future__ import annotations

import random
from itertools import groupby

import pytest

from reasonmill.operators import matching, ordering


def ranges(values):
    keyed = [(n - i, n) for i, n in enumerate(sorted(values))]
    return [(g[0][1], g[-1][1]) for _, g in ((k, list(g)) for k, g in groupby(keyed, key=lambda x: x[0]))]


@pytest.mark.parametrize("expected", [None, 320, 100])
def test_ranges_equal_plain_python(spark, expected):
    rng = random.Random(1)
    values = [n for n in range(2, 300) if rng.random() < 0.7] + [n for n in range(40, 80)] * 2 + [299]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "i long").repartition(7)
    got = sorted(tuple(r) for r in ordering.index_report(rows, "i", expected).collect())
    end = 300 if expected is None else max(expected, 300)
    gone = [("missing", a, b, 0) for a, b in ranges(set(range(end)) - set(values))]
    counts = {n: values.count(n) for n in values}
    many = [("doubled", a, b, sum(counts[n] for n in range(a, b + 1))) for a, b in ranges(n for n, c in counts.items() if c > 1)]
    assert got == sorted(gone + many)


def test_nothing_is_missing_in_nothing_unless_expected(spark):
    none = spark.createDataFrame([], "i long")
    assert ordering.index_report(none, "i").count() == 0
    assert [tuple(r) for r in ordering.index_report(none, "i", 3).collect()] == [("missing", 0, 2, 0)]


def test_document_without_numbers_for_undefined_values(spark):
    import json

    strata = spark.createDataFrame([("all", 3, float("nan"), 0.5), ("correct", 0, float("inf"), None)], "stratum string, n long, a double, b double")
    names = spark.createDataFrame([(f"s{n}", n % 4) for n in range(8)], "raw string, n long")
    text = matching.result_document(strata, names, spark.range(5), {"k": "v"}, top=3).first().document
    assert json.loads(text) == {
        "config": {"k": "v"}, "n_judge_calls": 5,
        "strata": {"all": {"n": 3, "a": None, "b": 0.5}, "correct": {"n": 0, "a": None, "b": None}},
        "unresolved_sensors": [{"raw": "s3", "n": 3}, {"raw": "s7", "n": 3}, {"raw": "s2", "n": 2}],
    }
