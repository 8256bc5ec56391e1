"""Several datasets in one table give what a run of each gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from reasonmill import registry
from reasonmill.functions import text
from reasonmill.operators import graph, matching, vocabulary
from reasonmill.plans import match
from reasonmill.sources import derived

FOLDER = "/root/testdata/sf0.001"
NAMES = ("ucihar", "pamap2", "Nowhere")


def tagged(rows):
    index = (F.col("sample_id").cast("bigint") % 3).cast("int")
    return rows.withColumn("dataset", F.get(F.array(*[F.lit(n) for n in NAMES]), index))


def rows_of(df, *order):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*order).collect()), key=repr)


def test_rates_and_summaries_equal_single_runs(spark):
    rows, verdicts = tagged(derived.eval_rows(spark, FOLDER)).checkpoint(), tagged(derived.verdict_rows(spark, FOLDER)).checkpoint()
    graphs = graph.with_reference(graph.parse_eval_rows(vocabulary.with_vocabulary(rows)))
    rates = graph.node_rates(graphs, vocabulary.field("classes"), vocabulary.field("sensors"), ["dataset"]).checkpoint()
    summary = matching.summary(match.scores_of_datasets(rows, verdicts), ["dataset"]).checkpoint()
    for name in NAMES:
        d, own, its = registry.lookup(name), rows.where(F.col("dataset") == name), verdicts.where(F.col("dataset") == name)
        alone = graph.node_rates(graph.with_reference(graph.parse_eval_rows(own)), d.classes, d.sensors)
        assert rows_of(rates.where(F.col("dataset") == name), *alone.columns) == rows_of(alone, *alone.columns)
        labelled = own.withColumn("predicted_activity", text.predicted_activity("generated", [c.lower() for c in d.classes]))
        alone = matching.summary(match.scores(labelled, d, its))
        assert rows_of(summary.where(F.col("dataset") == name), *alone.columns) == rows_of(alone, *alone.columns)


def test_given_entries_win_and_missing_names_have_the_defaults(spark):
    rows = spark.createDataFrame([("MINE",), ("ucihar",), (None,)], "dataset string")
    own = [registry.Dataset("Mine", ("Jumping High", "jump"), ("knee_acc_x",), ("knee",))]
    got = {r.dataset: r.vocabulary for r in vocabulary.with_vocabulary(rows, own).collect()}
    assert got["MINE"].longest == ["jumping high", "jump"] and got["MINE"].names.exact == {"knee_acc_x": "knee_acc_x"}
    assert got["ucihar"].classes == got[None].classes == list(registry.DEFAULT_CLASSES)
    assert len({r.vocabulary.sensors[0] for r in vocabulary.with_vocabulary(rows).collect()}) == 2


def test_sensors_meet_their_own_registry(spark):
    rows = vocabulary.with_vocabulary(spark.createDataFrame([("ucihar",), ("pamap2",)], "dataset string"))
    from reasonmill.functions.vocab import canonical_sensor

    got = {r.dataset: tuple(r.s) for r in rows.select("dataset", canonical_sensor(F.lit("Body Acceleration X"), vocabulary.field("names")).alias("s")).collect()}
    assert got == {"ucihar": ("body_acc_x", True), "pamap2": ("body_acc_x", False)}
