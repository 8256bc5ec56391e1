from __future__ import annotations

import json

import pytest

from reasonmill import registry
from reasonmill.operators import graph, reports
from reasonmill.plans import evaluate, prepare
from reasonmill.sources import documents, sinks
from reasonmill.streaming.ingest import ingest, ingest_rows

DOC = {
    "sample_idx": "7", "activity": "Standing", "confidence": 0.5, "mantis_embedding": {"a": [1, 2]},
    "high_attribution_regions": [
        {"sensor": "Acc_X", "start_t": 0, "end_t": 20, "length": 20, "mean_importance": 0.4, "max_importance": 0.9, "peak_timestep": 3},
        {"sensor": "Gyro_Z", "start_t": 0, "end_t": 128, "length": 128, "mean_importance": 0.6, "max_importance": 0.9, "peak_timestep": 3},
    ],
    "temporal_phase_importance": [{"phase": "start", "importance": 0.25}],
}
ANSWER = "<think>x</think>[OBSERVATION | id: O1]\nsensor: gyro_z\ntemporal: mid\npattern: flat\nconfidence: low\n[ACTIVITY]: Standing"


def put(folder, name, content):
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def test_attribution_files(spark, tmp_path):
    put(tmp_path, "train_class1_Standing_s0007.json", DOC)
    put(tmp_path, "test_class1_Standing_s007.json", {**DOC, "high_attribution_regions": []})
    put(tmp_path, "train_class1_Standing_s0008.json", "{broken")
    put(tmp_path, "notes.json", DOC)
    docs = documents.attribution_documents(spark, str(tmp_path))
    assert [r.file_name for r in documents.broken_files(docs).collect()] == ["train_class1_Standing_s0008.json"]
    index = documents.latest_per_sample(documents.readable(docs)).collect()
    assert [(r.sample_id, len(r.high_attribution_regions)) for r in index] == [("7", 2)]
    done = spark.createDataFrame([("test", "7")], "split string, sample_id string")
    prompts, rejects = prepare.requests(docs, done, registry.lookup("ucihar"))
    row = prompts.first()
    assert prompts.count() == 1 and rejects.count() == 0 and (row.split, row.sample_id) == ("train", "7")
    assert "1. body_acc_x (raw name Acc_X), steps 0 to 20" in row.prompt and "window full_window" in row.prompt
    assert json.loads(row.mantis_embedding) == {"a": [1, 2]}
    listed = documents.list_files(spark, str(tmp_path))
    assert listed.count() == 4


def test_reference_texts(spark, tmp_path):
    put(tmp_path, "a_9.json", {"sample_idx": 3, "overall_reasoning": "old"})
    put(tmp_path, "a_10.json", {"sample_id": "3", "overall_reasoning": "new"})
    put(tmp_path, "a_11.json", {"sample_id": "3", "overall_reasoning": ""})
    got = documents.reference_texts(spark, str(tmp_path)).collect()
    assert [(r.sample_id, r.reference) for r in got] == [("3", "new")]


def test_embeddings_and_fallback(spark, tmp_path):
    one, two = tmp_path / "embed", tmp_path / "reason"
    one.mkdir(), two.mkdir()
    put(one, "s_2.json", {"sample_idx": "2", "activity": "x", "embedding": [0.5, 1.0]})
    put(one, "s_10.json", {"sample_idx": "10", "activity": "y", "embedding": [0.5, 1.0]})
    put(two, "2_reasoning.json", {"sample_id": "2", "predicted_activity": "x", "overall_reasoning": "t"})
    joined = documents.samples_from(spark, str(one), str(two), limit=0)
    assert {(r.sample_id, r.ground_truth_reasoning) for r in joined.collect()} == {("2", "t"), ("10", "")}
    assert [r.width for r in documents.embedding_widths(joined).collect()] == [2]
    assert documents.sensor_embeddings(spark, str(one), limit=1).first().sample_id == "2"
    alone = documents.samples_from(spark, str(tmp_path / "none"), str(two))
    assert [(r.sample_id, r.gt_activity) for r in alone.collect()] == [("2", "x")]


def test_evaluation_files_in_both_shapes(spark, tmp_path):
    row = {"sample_id": "a", "gt_activity": "x", "generated": "t"}
    put(tmp_path, "array.json", [row, {**row, "sample_id": None}])
    put(tmp_path, "object.json", {"run": 1, "config": {"k": "v"}, "per_sample": [{"gt_activity": "y"}, row]})
    files = documents.pair_datasets(["ucihar"], [str(tmp_path / "array.json"), str(tmp_path / "object.json")])
    got = documents.evaluation_rows(spark, files).collect()
    assert sorted((r.pos, r.sample_id, r.gt_activity) for r in got) == [
        (0, "0", "y"), (0, "a", "x"), (1, "1", "x"), (1, "a", "x"),
    ]
    with pytest.raises(ValueError):
        documents.pair_datasets(["a", "b"], ["x", "y", "z"])


def test_files_of_other_shapes_are_told_apart(spark, tmp_path):
    texts = {
        "a": '[{"sample_id": 1, "generated": "x\\ny"}, 5, {"generated": "z"}]', "b": '{"run": 2, "per_sample": [{"gt_activity": "w"}]}',
        "c": '{"rows": []}', "d": '[{"sample_id": 1}', "e": "", "f": "7", "g": "[]", "h": '{"per_sample": null}',
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    report = documents.file_report(documents.evaluation_files(spark, str(tmp_path))).collect()
    got = {r.source_file[-6]: (r.shape, r.reason, r.n_rows, r.n_bad, r.run) for r in report}
    assert got == {
        "a": ("array", None, 2, 1, None), "b": ("object", None, 1, 0, 2), "c": (None, documents.NO_ROWS, 0, 0, None),
        "d": (None, documents.NOT_JSON, 0, 0, None),
        "f": (None, documents.NO_ROWS, 0, 0, None), "g": ("array", None, 0, 0, None), "h": (None, documents.NO_ROWS, 0, 0, None),
    }
    rows = documents.evaluation_rows(spark, [("ucihar", str(tmp_path))]).collect()
    assert sorted((r.source_file[-6], r.pos, r.sample_id, r.generated) for r in rows) == [("a", 0, "1", "x\ny"), ("a", 2, "2", "z"), ("b", 0, "0", None)]
    assert documents.inference_results(spark, str(tmp_path)).count() == 2


def test_large_files_are_streamed_to_the_same_rows(spark, tmp_path):
    for n in range(3):
        rows = [{"sample_id": f"{n}-{k}", "gt_activity": "x", "generated": "t" * k} for k in range(40 * n + 3)]
        put(tmp_path, f"{n}.json", rows if n != 1 else {"run": 1, "per_sample": rows})
    files = [("ucihar", str(tmp_path))]
    read = lambda limit: sorted(tuple(r) for r in documents.evaluation_rows(spark, files, limit=limit).drop("source_file").collect())
    whole = read(documents.VARIANT_BYTES)
    assert len(whole) == 129 and read(0) == whole and read(1000) == whole


def test_newest_run(spark):
    names = ["r_inference_1.json", "r_inference_3_partial.json", "r_inference_2.json", "q_inference_9.json"]
    files = spark.createDataFrame([(n,) for n in names], "file_name string")
    assert documents.newest_run(files, "r_inference_").first().file_name == "r_inference_2.json"
    assert documents.newest_run(files, "zzz").count() == 0


def test_corpus_written_read_and_resumed(spark, tmp_path):
    answers = spark.createDataFrame(
        [(2, "train", "1", "Standing", 0.12345, None, "later"), (1, "train", "1", "Standing", 0.5, None, ANSWER)],
        "seq int, split string, sample_id string, activity string, confidence double, mantis_embedding string, "
        "answer string",
    )
    rows = prepare.corpus_rows(answers, None, "m")
    path = str(tmp_path / "corpus")
    sinks.append_examples(rows, path)
    (tmp_path / "corpus" / "split=train" / "bad.json").write_text("{broken\n")
    lines = documents.training_lines(spark, path).collect()
    assert len(lines) == 1 and lines[0].metadata.sample_id == "1"
    assert "<think>" not in lines[0].output and "Model Confidence: 0.5" in lines[0].input
    existing = documents.training_lines(spark, path).select("metadata.split", "metadata.sample_id")
    assert prepare.corpus_rows(answers, existing, "m").count() == 0


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    source, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    answer = {"activity": "Standing", "confidence": 0.5, "answer": ANSWER}
    counts = []
    for batch in (("train_a_s1", "train_a_s2", "test_a_s1", "misc"), ("train_b_s2", "test_b_s3"), ()):
        for name in batch:
            put(source, f"{name}.json", answer)
        ingest(spark, str(source), target, state).awaitTermination()
        counts.append(spark.read.parquet(target).count())
    assert counts == [3, 4, 4]
    keys = spark.read.parquet(target).select("split", "sample_id").collect()
    assert len(set(keys)) == 4
    row = spark.read.parquet(target).first()
    assert row.reasoning_graph.n_observations == 1 and row.is_short and not row.leak


def test_ingest_gives_the_same_keys_for_all_batch_sizes_and_restarts(spark, tmp_path):
    answers = [("train", str(n % 40), f"{n:04d}", f"text {n}") for n in range(100)]
    got = []
    for size, waves in ((1, 1), (3, 2), (1000, 4)):
        folder = tmp_path / f"size{size}"
        for wave in range(waves):
            part = answers[wave * len(answers) // waves:(wave + 1) * len(answers) // waves]
            rows = spark.createDataFrame(
                [(s, k, True, f, "x", 0.5, None, t) for s, k, f, t in part], "split string, sample_id string, has_id boolean, "
                "file_name string, activity string, confidence double, mantis_embedding string, answer string",
            ).repartition(4, "sample_id")
            rows.write.mode("append").json(str(folder / "in"))
            stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", size).json(str(folder / "in"))
            ingest_rows(stream, str(folder / "out"), str(folder / "state")).awaitTermination()
        rows = spark.read.parquet(str(folder / "out")).collect()
        got.append(sorted((r.sample_id, r.file_name) for r in rows))
    assert got[0] == got[1] == got[2] == sorted((k, f) for _, k, f, _ in answers[:40])


def test_ingest_under_another_checkpoint_keeps_what_is_there(spark, tmp_path):
    target = str(tmp_path / "out")
    for n, names in enumerate((("train_a_s1", "train_a_s2"), ("train_b_s2", "train_b_s3"))):
        source = tmp_path / f"in{n}"
        source.mkdir()
        for name in names:
            put(source, f"{name}.json", {"activity": "Standing", "confidence": n / 2, "answer": ANSWER})
        ingest(spark, str(source), target, str(tmp_path / f"state{n}")).awaitTermination()
    rows = {r.sample_id: r.confidence for r in spark.read.parquet(target).collect()}
    assert rows == {"s1": 0.0, "s2": 0.0, "s3": 0.5} or rows == {"1": 0.0, "2": 0.0, "3": 0.5}


def test_evaluation_report(spark, tmp_path):
    text = ANSWER.replace("<think>x</think>", "")
    rows = spark.createDataFrame(
        [(1, "a", "standing", text, text), (1, "b", "sitting", text, "none"), (2, "a", "standing", "", text)],
        "run int, sample_id string, gt_activity string, ground_truth_reasoning string, generated string",
    )
    metrics = evaluate.evaluate(rows, registry.lookup("ucihar"), by=["run"]).persist()
    got = {(r.run, r.section, r.metric): r.value for r in metrics.collect()}
    assert got[1, "classification", "accuracy"] == 0.5 and got[1, "parse", "psr"] == 0.5
    assert got[1, "text", "rouge_l"] == 0.5 and got[1, "nodes", "obs_sensor_valid_rate"] == 1.0
    assert (2, "parse", "psr") not in got
    combined = {r.metric: r for r in reports.combined_report(metrics, [1, 2]).collect()}
    assert (combined["accuracy"].run_1, combined["accuracy"].run_2, combined["accuracy"].mean) == ("0.5000", "1.0000", "0.7500")
    lines = reports.sectioned_report(metrics.where("run = 1"), evaluate.SECTIONS)
    sinks.write_report(lines, str(tmp_path / "report"), ["section_ordinal", "ordinal"])
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == lines.count()


def test_whole_report_is_written_in_sections(spark, tmp_path):
    text = ANSWER.replace("<think>x</think>", "")
    ddl = "sample_id string, gt_activity string, ground_truth_reasoning string, generated string"
    rows = spark.createDataFrame([("a", "standing", text, text), ("b", "sitting", text, "none"), ("c", "standing", "", text)], ddl)
    lines = evaluate.report(rows, registry.lookup("ucihar"), {"dataset": "ucihar"}).persist()
    got = {r.cells[0]: r.cells[1:] for r in lines.where("section <> 'classes'").collect()}
    assert got["n_cls_samples"] == ["3"] and got["n_text_samples"] == ["2"] and got["accuracy"] == ["0.6667"]
    assert got["correct"] == ["1", "1.0000", got["correct"][2], "1.0000"] and got["incorrect"][:2] == ["1", "0.0000"]
    assert got["rouge_l"] == ["0.5000"] and got["ref_psr"] == ["1.0000"]
    classes = [r.cells[0] for r in lines.where("section = 'classes'").orderBy("ordinal").collect()]
    assert classes[-1] == "unknown" and len(classes) == 7
    sinks.write_lines(lines, str(tmp_path / "report"))
    written = [r.value for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert "## CONFIG" in written[0] and sum("## " in line for line in written) == len(evaluate.REPORT)
    assert len(written) == lines.count() + len(evaluate.REPORT)
    bare = {r.cells[0]: r.cells[1:] for r in evaluate.report(rows.where("sample_id = 'c'"), registry.lookup("ucihar"), {}).collect()}
    assert bare["rouge_l"] == ["N/A"] and bare["correct"] == ["0", "N/A", "N/A", "N/A"] and bare["gc_mean"] == ["N/A"]


def test_chain_and_duplicate_ids(spark):
    base = "[OBSERVATION | id: O1]\nsensor: {}\ntemporal: mid\npattern: p\nconfidence: low\n"
    inf = "[INFERENCE | id: I1]\nbased_on: O1{}\ninference: {}\nconfidence: low\n"
    rows = spark.createDataFrame(
        [("a", base.format("gyro_z") + base.format("body_acc_x") + inf.format("", "body acc x moves")),
         ("b", base.format("gyro_z") + inf.format(", O9", "gyro_z moves")), ("c", base.format("gyro_z"))],
        "sample_id string, generated string",
    ).selectExpr("*", "'r' as ground_truth_reasoning")
    graphs = graph.parse_eval_rows(rows)
    got = {r.sample_id: r for r in graph.chain_validity_samples(graphs, ["sample_id"]).collect()}
    assert (got["a"].rcv_structural, got["a"].rcv_semantic) == (1.0, 1.0)
    assert (got["b"].rcv_structural, got["b"].rcv_semantic) == (0.0, 0.0)
    assert got["c"].rcv_structural is None
    rates = graph.node_rates(graphs, ["walking"], ["gyro_z"]).first()
    assert rates.inf_semantic_rate == 1.0 and rates.inf_structural_rate == 0.5 and rates.obs_coverage_rate == 2 / 3
