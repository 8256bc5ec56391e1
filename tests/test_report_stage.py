"""What the reports write between parse and metrics."""

from __future__ import annotations

from reasonmill import registry
from reasonmill.plans import evaluate
from reasonmill.sources import derived


def test_texts_and_reference_graphs_are_not_written(spark):
    rows = derived.eval_rows(spark, "/root/testdata/sf0.001")
    scored = evaluate.scored_rows(rows, registry.lookup("ucihar"), ["sample_id"])
    assert not {"generated", "ground_truth_reasoning"} & set(scored.columns)
    assert scored.schema["ref"].dataType.names == ["n_observations", "parse_failed"]
