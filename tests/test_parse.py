from __future__ import annotations

from pyspark.sql import functions as F

from reasonmill import registry
from reasonmill.functions import parse, text, vocab
from reasonmill.functions.parse import trace_graph
from reasonmill.operators import corpus
from reasonmill.schema import GRAPH
from reasonmill.sources import documents

SAMPLE = """[OBSERVATION | id: O1]
sensor: Total_Acc_Y
temporal: Early
pattern: sharp peak: then flat
confidence: High

[observation|id:O2]\t
sensor:
  gyro_z\r
temporal: late
pattern: near zero
confidence: low
[INFERENCE | id: I1]
based_on: O1, ,O9
inference: upright
confidence: high
[SYNTHESIS]
based_on: I1
Nothing moves.

 The trunk is still.
[ACTIVITY]: Walking_Upstairs now
[ACTIVITY]: sitting"""


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


def test_all_layers(spark):
    g = one(spark, SAMPLE, parse.trace_graph("t"))
    assert [(o.id, o.sensor, o.temporal, o.pattern, o.confidence) for o in g.observations] == [
        ("O1", "total_acc_y", "early", "sharp peak: then flat", "high"),
        ("O2", "gyro_z", "late", "near zero", "low"),
    ]
    assert g.inferences[0].based_on == ["O1", "", "O9"]
    assert g.synthesis.text == "Nothing moves.\n The trunk is still."
    assert g.activity == "walking upstairs now"
    assert (g.n_observations, g.n_inferences, g.parse_failed) == (2, 1, False)


def test_blank_texts_fail(spark):
    for value in (None, "", " \n  ", "no blocks here"):
        g = one(spark, value, parse.trace_graph("t"))
        assert g.parse_failed and g.synthesis is None and g.activity is None


def test_missing_confidence_line_is_no_block(spark):
    value = "[OBSERVATION | id: O1]\nsensor: a\ntemporal: b\npattern: c\n"
    assert one(spark, value, parse.trace_graph("t")).parse_failed


def test_blank_sensor_becomes_empty(spark):
    value = "[OBSERVATION | id: O1]\nsensor:  \ntemporal: mid\npattern: c\nconfidence: low"
    assert one(spark, value, parse.trace_graph("t")).observations[0].sensor == ""


def test_corpus_graph_drops_thoughts_and_keeps_case(spark):
    value = "<think>[ACTIVITY]: no</think>\n```text\n[ACTIVITY]: Rope_Jumping\n```"
    assert one(spark, value, parse.corpus_graph("t")).activity == "Rope_Jumping"
    assert one(spark, value, text.clean_answer("t")) == "[ACTIVITY]: Rope_Jumping"


def test_predicted_activity(spark):
    cases = {
        SAMPLE: "walking upstairs",
        "[ACTIVITY]: Swimming": "swimming",
        "[ACTIVITY]: ": "unknown",
        "they were Walking_Downstairs": "walking downstairs",
        "nothing": "unknown",
    }
    for value, expected in cases.items():
        assert one(spark, value, text.predicted_activity("t", registry.UCIHAR_CLASSES)) == expected
    assert one(spark, None, text.predicted_activity("t", registry.UCIHAR_CLASSES)) == "unknown"


def test_verdicts(spark):
    cases = {
        "Yes.\nno": "YES", "  NO way": "NO", "I KNOW": "NO", "nothing": "NO", "rather yes": "YES",
        "maybe": "ERROR", "": "ERROR",
    }
    for value, expected in cases.items():
        assert one(spark, value, text.verdict_of("t")) == expected


def test_flags(spark):
    assert one(spark, "peak of 12", text.leaks_number("t"))
    assert one(spark, "about 3.5 g", text.leaks_number("t"))
    assert not one(spark, "1. first, 2. second", text.leaks_number("t"))
    assert one(spark, "Well, AS AN AI model", text.is_refusal("t"))
    assert one(spark, "a b\tc", text.blank_token_count("t")) == 3


def test_windows(spark):
    cases = [(0, 10, "early"), (30, 60, "early_to_mid"), (60, 70, "mid"), (80, 95, "mid_to_late"),
             (100, 120, "late"), (0, 96, "full_window"), (120, 300, "late")]
    rows = spark.createDataFrame([c[:2] for c in cases], "a int, b int").select(vocab.window_label("a", "b"))
    assert [r[0] for r in rows.collect()] == [c[2] for c in cases]
    cases = [("mid", "mid", 0), ("early", "late", 4), ("throughout", "odd", 0), ("full_window", "mid", 999),
             ("odd", "odd", 0), (None, "mid", 999)]
    rows = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(vocab.window_distance("a", "b"))
    assert [r[0] for r in rows.collect()] == [c[2] for c in cases]


def test_canonical_sensors(spark):
    sensors = registry.MHEALTH_SENSORS + registry.OPPORTUNITY_SENSORS
    cases = {
        "Left Ankle Acceleration-X": ("lankle_acc_x", True), "rwrist_GYRO_z": ("rwrist_gyro_z", True),
        "acc_lua^_accx": ("Acc_LUA^_accX", True), "lankle_acc_w": ("lankle_acc_w", False), "": ("", False),
    }
    for value, expected in cases.items():
        got = one(spark, value, vocab.canonical_sensor("t", sensors))
        assert (got.name, got.resolved) == expected


def test_file_names(spark):
    cases = {
        "test_class0_Walking_s0081.json": ("test", "81", True), "train_x_s000.json": ("train", "0", True),
        "other_s7.json": ("unknown", "7", True), "train_s7_x.json": ("train", "0", False),
    }
    for value, expected in cases.items():
        got = one(spark, value, corpus.file_identity("t"))
        assert (got.split, got.sample_id, got.has_id) == expected
    assert one(spark, "run2_part10.json", documents.numeric_key("t")) == 10
    assert one(spark, "none.json", documents.numeric_key("t")) == 0


def test_registry(spark):
    assert registry.lookup("UCIHAR").classes[0] == "walking"
    assert registry.lookup("other").sensors == registry.DEFAULT_SENSORS
    assert registry.lookup("pamap2", classes=["a"]).classes == ["a"]
    dim = registry.dimension(spark).groupBy("dataset").pivot("kind", ["class", "sensor", "term"]).count()
    sizes = {r["dataset"]: tuple(r)[1:] for r in dim.collect()}
    assert sizes["pamap2"] == (12, 52, 60) and sizes["opportunity"] == (17, 79, 82)


def test_graphs_of_odd_texts_and_invalid_bytes(spark):
    """Python reads the texts: bytes that are no UTF-8 must not end the job, and case folds as in the patterns."""
    text = (
        b"\xff[ob\xc5\xbfervat\xc4\xb1on | \xc2\xa0id: o\xd9\xa3]\t\r\nSENSOR:\n GYRO-\xc3\x84 \x1c\r\ntemporal: Mid]\n"
        b"pattern: a \xfe: b\nconfidence:\xe3\x80\x80HIGH"
    )
    rows = spark.createDataFrame([(1, bytearray(text)), (2, None)], "k int, b binary")
    got = rows.select("k", trace_graph(F.col("b").cast("string")).alias("g")).orderBy("k").collect()
    node = got[0].g.observations[0]
    assert (node.id, node.sensor, node.temporal, node.pattern, node.confidence) == (
        "o٣", "gyro-ä", "mid]", "a �: b", "high"
    )
    assert (got[1].g.observations, got[1].g.synthesis, got[1].g.activity, got[1].g.parse_failed) == ([], None, None, True)


def test_graph_type_is_the_schema(spark):
    """The parser is one Arrow function: no interpreted expressions in the plan, which took twice as long."""
    df = spark.createDataFrame([("x",)], "t string").select(trace_graph("t").alias("g"))
    assert df.schema["g"].dataType.simpleString() == spark.createDataFrame([], f"g {GRAPH}").schema["g"].dataType.simpleString()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "transform(" not in plan
