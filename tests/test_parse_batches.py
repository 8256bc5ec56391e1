"""Values that repeat in a batch are worked out once."""

from __future__ import annotations

import pyarrow as pa

from reasonmill.functions import parse


def test_each_different_value_is_worked_out_once():
    seen = []
    form = lambda x: seen.append(x) or x.upper()
    assert parse._each(["a", "b", "a", "a"], form).to_pylist() == ["A", "B", "A", "A"]
    assert sorted(seen) == ["a", "b"]
    assert parse._each([], form).to_pylist() == []


def test_batches_without_any_node():
    graphs = parse._parse(pa.array([None, "", "x"], pa.string()), False).to_pylist()
    assert [(g["observations"], g["inferences"], g["synthesis"], g["parse_failed"]) for g in graphs] == [([], [], None, True)] * 3
