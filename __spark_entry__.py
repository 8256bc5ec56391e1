
from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle_queries import ORACLES
from reasonmill import registry
from reasonmill.functions import similarity, text, vocab
from reasonmill.operators import (
    classification, corpus, graph, matching, ordering, reports, runlog, textquality, verdicts, vocabulary,
)
from reasonmill.plans import evaluate, match
from reasonmill.plans.stage import stage_folder, staged, staged_once
from reasonmill.session import ship_package
from reasonmill.sources import committed, derived, documents, sinks
from reasonmill.sources.tables import table
from reasonmill.streaming import ingest

# The subpackage for training data and its pipeline may be left out; nothing else needs them.
_found = importlib.util.find_spec("reasonmill.llm")
if _found is not None and _found.origin is not None and importlib.util.find_spec("corpus_pipeline") is not None:
    from reasonmill.llm import queries as llm
else:
    llm = None

SET = registry.lookup("ucihar")
LABELS = classification.with_unknown(SET.classes)
KEY = ("sample_id",)
EVENT_TYPES = ("view", "click", "error", "signup", "purchase")
WORDS = ("the", "and", "tion", "der", "une", "ing ", "zzz")
Query = Callable[[SparkSession, str], DataFrame]


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals and integers to one width, so that two engines can be compared."""
    shapes = {
        "double": lambda c: F.round(c, 6), "float": lambda c: F.round(c.cast("double"), 6),
        "integer": lambda c: c.cast("bigint"),
    }
    return df.select(
        *[
            shapes.get(f.dataType.typeName(), lambda c: c)(F.col(f.name)).alias(f.name)
            for f in df.schema
        ]
    )


# ---- inputs ------------------------------------------------------------------------------------------------


def _eval_rows(spark: SparkSession, d: str) -> DataFrame:
    """The table of reference and generated texts, as a user would have it: written once, then read."""
    return staged_once(spark, d, "eval_rows", lambda: derived.eval_rows(spark, d))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return staged_once(spark, d, "verdicts", lambda: derived.verdict_rows(spark, d))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _eval_rows(spark, d)
    return rows.withColumn("predicted_activity", text.predicted_activity("generated", SET.classes))


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    return graph.parse_eval_rows(_eval_rows(spark, d))


def _referenced(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_reference(_graphs(spark, d))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return corpus.with_identity(derived.attribution_rows(spark, d))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return match.scores(_rows(spark, d), SET, _verdicts(spark, d))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select(
        F.col("quality").cast("string").alias("gt_activity"),
        F.col("toxic").cast("string").alias("predicted_activity"),
    )


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """The same samples in three runs that differ in their guesses."""
    rel = derived.orders_relation(spark, d)
    name = lambda i: F.get(F.array(*[F.lit(c) for c in SET.classes]), i.cast("int"))
    return rel.select("k", "c", "cls", F.explode(F.array(*[F.lit(r) for r in (1, 2, 3)])).alias("run")).select(
        "run",
        name(F.col("cls")).alias("gt_activity"),
        F.when((F.col("k") + F.col("c")) % 11 == 0, "off the list")
        .otherwise(name((F.col("cls") + F.when((F.col("c") + F.col("run") * F.col("k")) % 4 == 0, 1).otherwise(0)) % 6))
        .alias("predicted_activity"),
    )


def _run_metrics(spark: SparkSession, d: str) -> DataFrame:
    wide = classification.summary(_runs(spark, d), LABELS, by=["run"])
    return reports.long_metrics(wide, "classification", ["run"])


# ---- queries -----------------------------------------------------------------------------------------------


def trace_observations(spark: SparkSession, d: str) -> DataFrame:
    graphs = _graphs(spark, d)
    tag = lambda g, side: F.transform(
        F.col(f"{g}.observations"),
        lambda o, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), o.alias("o")),
    )
    nodes = F.explode(F.concat(tag("ref", "reference"), tag("gen", "generated")))
    return graphs.select("sample_id", nodes.alias("n")).select(
        "sample_id", "n.side", "n.pos", "n.o.id", "n.o.sensor", "n.o.temporal", "n.o.pattern", "n.o.confidence"
    )


def trace_inferences(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph.inference_nodes(_graphs(spark, d), "gen", KEY)
    return nodes.select(
        "sample_id", "pos", "id", F.array_join("based_on", ",").alias("based_on"), "inference", "confidence"
    )


def trace_citations(spark: SparkSession, d: str) -> DataFrame:
    return graph.citation_edges(_graphs(spark, d), "gen", KEY)


def trace_conclusions(spark: SparkSession, d: str) -> DataFrame:
    return _graphs(spark, d).select(
        "sample_id",
        F.array_join("gen.synthesis.based_on", ",").alias("synthesis_cites"),
        F.col("gen.synthesis.text").alias("synthesis"),
        F.col("gen.activity").alias("activity"),
        F.col("gen.n_observations").alias("n_observations"),
        F.col("gen.n_inferences").alias("n_inferences"),
        F.col("gen.parse_failed").alias("parse_failed"),
    )


def parse_success(spark: SparkSession, d: str) -> DataFrame:
    return graph.parse_success(_referenced(spark, d), ["gt_activity"])


def node_rates_by_class(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_rates(_referenced(spark, d), SET.classes, SET.sensors, ["gt_activity"])


def chain_validity_samples(spark: SparkSession, d: str) -> DataFrame:
    return graph.chain_validity_samples(_referenced(spark, d), KEY)


def chain_validity(spark: SparkSession, d: str) -> DataFrame:
    return graph.chain_validity(_referenced(spark, d), KEY, ["gt_activity"])


def coverage_by_class(spark: SparkSession, d: str) -> DataFrame:
    return graph.coverage_by_class(_referenced(spark, d))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return graph.coverage(_referenced(spark, d))


def _grounding(spark: SparkSession, d: str) -> DataFrame:
    index = documents.latest_per_sample(derived.attribution_rows(spark, d))
    return graph.grounding_samples(_referenced(spark, d), index, KEY)


def grounding(spark: SparkSession, d: str) -> DataFrame:
    return graph.grounding(_grounding(spark, d))


def predicted_activities(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("sample_id", "gt_activity", "predicted_activity")


def classification_summary(spark: SparkSession, d: str) -> DataFrame:
    return classification.summary(_rows(spark, d), LABELS)


def class_report(spark: SparkSession, d: str) -> DataFrame:
    return classification.class_report(_rows(spark, d), LABELS)


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return classification.confusion(_rows(spark, d), LABELS)


def label_report(spark: SparkSession, d: str) -> DataFrame:
    return classification.class_report(_labelled(spark, d), ["0", "1", "2"])


def label_confusion(spark: SparkSession, d: str) -> DataFrame:
    wide = classification.confusion_matrix(_labelled(spark, d), ["0", "1", "2"])
    return wide.select("gt", *[F.col(f"`{c}`").alias(f"pred_{c}") for c in "012"])


def turn_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return derived.turn_pairs(spark, d).select(
        "conv_id", "turn",
        similarity.rouge_l("ground_truth_reasoning", "generated", stem=False).alias("rouge_l"),
    )


def turn_text_scores(spark: SparkSession, d: str) -> DataFrame:
    return textquality.text_scores(derived.turn_pairs(spark, d), ["conv_id", "turn"], WORDS)


def document_text_scores(spark: SparkSession, d: str) -> DataFrame:
    pairs = derived.document_pairs(spark, d)
    scores = textquality.text_scores(pairs, ["lang"], WORDS)
    return textquality.means(scores, by=["lang"])


def document_term_recall(spark: SparkSession, d: str) -> DataFrame:
    return derived.document_pairs(spark, d).select(
        "doc_id",
        similarity.term_recall("ground_truth_reasoning", "generated", WORDS).alias("sensor_term_recall"),
    )


def conditioned_term_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.with_reference(_rows(spark, d).withColumn("has_reference", ~text.is_blank("ground_truth_reasoning")))
    scores = rows.withColumn(
        "sensor_term_recall", similarity.term_recall("ground_truth_reasoning", "generated", SET.terms)
    )
    return textquality.conditioned_means(scores, ["sensor_term_recall"])


def condition_counts(spark: SparkSession, d: str) -> DataFrame:
    return textquality.condition_counts(
        _rows(spark, d).withColumn("has_reference", ~text.is_blank("ground_truth_reasoning"))
    )


def vector_f1(spark: SparkSession, d: str) -> DataFrame:
    return textquality.vector_f1(derived.token_vectors(spark, d))


def judge_requests(spark: SparkSession, d: str) -> DataFrame:
    return match.requests(_rows(spark, d), SET, relaxed=True).select(
        "sample_id", "kind", "i", "j", F.col("request").isNotNull().alias("asked"), "auto_verdict"
    )


def parsed_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d).select(
        "sample_id", "kind", "i", "j", text.verdict_of("response").alias("verdict")
    )


def unresolved_sensors(spark: SparkSession, d: str) -> DataFrame:
    return matching.unresolved_sensors_of(_eval_rows(spark, d), SET.sensors)


def observation_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_table(_scored(spark, d), KEY)


def inference_matches(spark: SparkSession, d: str) -> DataFrame:
    listed = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return matching.match_table(_scored(spark, d), KEY, matching.INF).select(
        "sample_id", "gt_id", "pred_id", "judge_verdict", "hit", "cost", listed("gt_based_on"),
        listed("pred_based_on"), listed("mapped_gt_obs"), listed("hallucinated_basis"),
        "n_hallucinated_basis", "iprov_abs", "iprov_clean", "iprov_penalised",
    )


def match_scores(spark: SparkSession, d: str) -> DataFrame:
    return matching.sample_table(_scored(spark, d), KEY)


def match_summary(spark: SparkSession, d: str) -> DataFrame:
    return matching.summary(_scored(spark, d))


def lexical_match_summary(spark: SparkSession, d: str) -> DataFrame:
    return matching.summary(match.scores(_rows(spark, d), SET))


def file_identities(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("file_name", "split", "sample_id", "has_id")


def ranked_evidence(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).select(
        "file_name", F.explode(corpus.ranked_evidence("high_attribution_regions")).alias("e")
    )
    return docs.select("file_name", "e.*")


def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.prompts(_documents(spark, d), SET.sensors).select(
        "file_name", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("n_chars")
    )


def document_flags(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d).select(
        "doc_id",
        F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("I Cannot say. "), "text"))
        .otherwise(F.col("text"))
        .alias("answer"),
    )
    return corpus.quality_flags(docs).drop("answer")


def turn_flags(spark: SparkSession, d: str) -> DataFrame:
    return corpus.quality_flags(table(spark, d, "conversations"), "text").drop("text")


def class_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d).select(
        F.col("lang").alias("activity"), (F.col("n_chars") % 100 / 100.0).alias("confidence"),
        F.col("text").alias("answer"),
    )
    return corpus.class_summary(corpus.quality_flags(docs))


def oversized_prompts(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d).select(
        F.col("lang").alias("split"), F.col("doc_id").cast("string").alias("sample_id"),
        F.col("text").alias("prompt"),
    )
    return corpus.split_oversized(docs, limit=1000)[1]


def training_examples(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers, wrapped in a think block and a code fence that have to go."""
    wrapped = F.concat(F.lit("<think>hm</think>\n```text\n"), "text", F.lit("\n```\n"))
    answers = _texts(spark, d).select(
        F.col("source").alias("split"), F.col("doc_id").cast("string").alias("sample_id"),
        F.col("lang").alias("activity"), (F.col("n_chars") % 100 / 100.0).alias("confidence"),
        F.lit(None).cast("string").alias("mantis_embedding"), wrapped.alias("answer"),
    )
    examples = corpus.training_examples(corpus.reasoning_records(answers, "teacher"))
    return examples.select(
        "split", "sample_id", "input", F.md5("output").alias("output_md5"),
        F.col("metadata.reasoning_graph.parse_failed").alias("parse_failed"),
    )


def smallest_sources(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(
        F.concat(F.col("source"), F.lit("_s"), F.col("doc_id").cast("string")).alias("file_name"),
        F.col("n_chars").alias("file_size"),
    )
    return corpus.smallest_first(files, 40)


def merged_shards(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("index"), "event_type", "value")
    shards = [rows.where(F.col("event_type") == t) for t in EVENT_TYPES]
    others = rows.where(F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES))
    return documents.merged_shards([*shards, others])


def frequent_unresolved_sensors(spark: SparkSession, d: str) -> DataFrame:
    """With the sensors of another dataset, so that more names stay unresolved."""
    sensors = registry.lookup("pamap2").sensors
    return matching.unresolved_sensors_of(_eval_rows(spark, d), sensors, top=3)


def remaining_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).where("has_id").select("split", "sample_id", "confidence")
    done = docs.where("confidence < 0.5")
    return corpus.without_processed(docs, done).select("split", "sample_id")


def source_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).where("has_id").select("split", "sample_id", "confidence")
    return corpus.split_counts(docs, docs.where("confidence < 0.5"))


def new_corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(
        F.col("event_type").alias("split"), F.col("user_id").cast("string").alias("sample_id"), "event_id", "value"
    )
    return corpus.new_rows(events, events.where("value > 150"), "event_id")


def train_validation_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    order = [(F.col("doc_id") * 7919) % 10007, F.col("doc_id")]
    return corpus.split_train_validation(docs, "lang", 0.2, order)


def latest_references(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(
        F.col("conv_id").cast("string").alias("sample_id"), F.col("text").alias("reference"),
        F.concat(F.lit("part_"), F.col("turn").cast("string"), F.lit(".json")).alias("file_name"),
    )
    samples = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("sample_id"))
    return documents.with_references(samples, documents.latest_reference(turns))


def attribution_index(spark: SparkSession, d: str) -> DataFrame:
    index = documents.latest_per_sample(derived.attribution_rows(spark, d))
    return index.select(
        "sample_id", F.size("high_attribution_regions").alias("n_regions"),
        F.array_join(F.array_sort(graph.important_sensors(F.col("high_attribution_regions"), 3)), ",").alias("important"),
    )


def rolling_quality(spark: SparkSession, d: str) -> DataFrame:
    rolled = runlog.rolling_quality(derived.run_log(spark, d), block=512)
    return runlog.at_batch_ends(rolled).select("dataset", "batch", "seq", *runlog.ROLLING)


def run_throughput(spark: SparkSession, d: str) -> DataFrame:
    return runlog.throughput(runlog.batch_table(derived.run_log(spark, d)), 128)


def every_50th(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "ts", "event_type")
    placed = ordering.with_position(events, ["ts", "event_id"], "pos", "n_rows")
    return ordering.every_nth(placed, 50, "pos", "n_rows").select("event_id", "event_type", "pos")


def qualitative_samples(spark: SparkSession, d: str) -> DataFrame:
    placed = ordering.with_position(table(spark, d, "documents").select("doc_id", "lang", "text"), ["doc_id"])
    return runlog.qualitative_samples(placed, 4, ["doc_id", "lang"], "text")


def window_distances(spark: SparkSession, d: str) -> DataFrame:
    rel = derived.orders_relation(spark, d)
    label = lambda i: F.get(F.array(*[F.lit(w) for w in (*derived.WINDOWS, "other")]), i.cast("int"))
    return rel.select(
        F.col("k"), label(F.col("p") % 8).alias("a"), label((F.col("p") + F.col("c")) % 8).alias("b")
    ).select("k", vocab.window_distance("a", "b").alias("distance"))


def registry_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Orders that name a dataset, joined to the registry: how many values each kind has."""
    rel = derived.orders_relation(spark, d)
    names = F.array(*[F.lit(n) for n in registry.DATASETS])
    named = rel.select(F.get(names, (F.col("p") % 7).cast("int")).alias("dataset")).groupBy("dataset").agg(
        F.count("*").alias("n_orders")
    )
    entries = registry.dimension(spark).groupBy("dataset", "kind").agg(F.count("*").alias("n_values"))
    return named.join(entries, "dataset")


def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    return reports.run_statistics(_run_metrics(spark, d)).drop("section")


def combined_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.combined_report(_run_metrics(spark, d), [1, 2, 3]).drop("section", "ordinal")


def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    index = documents.latest_per_sample(derived.attribution_rows(spark, d))
    metrics = evaluate.evaluate(_eval_rows(spark, d), SET, index)
    return reports.sectioned_report(metrics, evaluate.SECTIONS)


def _file_folder(spark: SparkSession, d: str) -> str:
    """Evaluation files of all shapes, written to the shared folder."""
    target = stage_folder(spark, "files")
    derived.write_evaluation_files(spark, d, target)
    return target


def _file_number() -> Column:
    return F.regexp_extract("source_file", r"file=(\d+)", 1).cast("bigint").alias("file")


def evaluation_file_report(spark: SparkSession, d: str) -> DataFrame:
    files = documents.evaluation_files(spark, _file_folder(spark, d), glob="*.txt")
    return documents.file_report(files).select(
        _file_number(), "shape", "reason", "run", "n_runs", F.col("config.model").alias("model"), "n_rows", "n_bad"
    )


def evaluation_file_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = documents.evaluation_rows(spark, [("ucihar", _file_folder(spark, d))], glob="*.txt")
    return rows.select(
        "dataset", _file_number(), "pos", "sample_id", "gt_activity", "predicted_activity",
        F.md5("ground_truth_reasoning").alias("text_md5"), "prefix_active",
    )


def ingested_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers, four to a key, that arrive in two waves: even ones first. The second wave is taken in by a
    query that starts anew, in smaller batches."""
    folder = stage_folder(spark, "answers")
    docs = _texts(spark, d).select(
        F.col("lang").alias("split"), F.expr("cast(doc_id div 4 as string)").alias("sample_id"), F.lit(True).alias("has_id"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file_name"), F.lit("x").alias("activity"),
        F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("mantis_embedding"), F.col("text").alias("answer"),
        (F.col("doc_id") % 2).alias("wave"),
    )
    for wave, per_batch in ((0, 100), (1, 2)):
        # A key's rows of one wave share a file, so they come in one batch.
        rows = docs.where(F.col("wave") == wave).drop("wave").repartition(5, "split", "sample_id")
        rows.write.mode("append").json(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).json(f"{folder}/in")
        ingest.ingest_rows(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("split", "sample_id", "file_name", "n_tokens", "leak", "is_short")


def scoped_term_recall(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.with_reference(_rows(spark, d).withColumn("has_reference", ~text.is_blank("ground_truth_reasoning")))
    scores = textquality.text_scores(rows, ["gt_activity", "predicted_activity"], SET.terms, columns=["sensor_term_recall"])
    return textquality.scoped_means(scores, ["sensor_term_recall"])


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """The whole report, with the one text score that SQL can repeat."""
    index = documents.latest_per_sample(derived.attribution_rows(spark, d))
    config = {"dataset": "ucihar", "model_id": "m", "n_tokens": "8"}
    lines = evaluate.report(_eval_rows(spark, d), SET, config, index, scores=["sensor_term_recall"])
    return lines.select("section_ordinal", "section", "ordinal", F.array_join("cells", "|").alias("line"))


def evaluation_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = _eval_rows(spark, d).withColumn("n", F.col("sample_id").cast("bigint"))
    return evaluate.qualitative_table(rows, SET, ["n"]).drop("snippet")


def shard_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Shards that miss some events and hold others twice; five more were expected than there are."""
    events = table(spark, d, "events").select(F.col("event_id").alias("index"))
    kept, again = events.where("index % 10 not in (3, 4)"), events.where("index % 25 in (5, 6, 7, 13)")
    return ordering.index_report(kept.unionAll(again), "index", expected=events.count() + 5)


def match_document(spark: SparkSession, d: str) -> DataFrame:
    """The result document of the matching, written as text and parsed back."""
    samples = staged(match.coded_samples(_eval_rows(spark, d), SET, open_sensors=registry.lookup("pamap2").sensors), "samples")
    calls = "n_relaxed_requests"
    strata = matching.summary(match.sample_scores(samples, _verdicts(spark, d)), sums=[calls])
    path = stage_folder(spark, "document")
    config = {"dataset": "ucihar", "mode": "relaxed"}
    matching.result_document(strata, matching.open_counts(samples), calls, config).write.text(path)
    scores = ", ".join(f"{c}: double" for c in matching.SCORES)
    ddl = (
        "struct<config: map<string,string>, n_judge_calls: bigint, strata: map<string,struct<n_total: bigint, n_scored: bigint, "
        f"n_skipped: bigint, {scores}>>, unresolved_sensors: array<struct<raw: string, n: bigint>>>"
    )
    read = spark.read.text(path, wholetext=False).select(F.from_json("value", ddl).alias("doc"))
    listed = F.transform("doc.unresolved_sensors", lambda x: F.concat_ws(":", x["raw"], x["n"].cast("string")))
    return read.select(
        F.col("doc.config")["dataset"].alias("dataset"), F.col("doc.n_judge_calls").alias("n_judge_calls"),
        F.array_join(listed, ",").alias("unresolved"), F.explode("doc.strata").alias("stratum", "row"),
    ).select("dataset", "n_judge_calls", "unresolved", "stratum", "row.*")


def tolerant_lines(spark: SparkSession, d: str) -> DataFrame:
    """Training lines with broken ones among them, written as text and read back."""
    path = stage_folder(spark, "lines")
    meta = F.struct(F.col("doc_id").cast("string").alias("sample_id"), F.col("source").alias("split"))
    line = F.to_json(F.struct(F.col("lang").alias("input"), F.col("text").alias("output"), meta.alias("metadata")))
    broken = F.when(F.col("doc_id") % 7 == 3, F.substr(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    _texts(spark, d).select(broken.alias("value")).write.text(path)
    return documents.training_lines(spark, path).select("metadata.sample_id", "metadata.split", "input", F.md5("output").alias("output_md5"))


def first_inference_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of inference results in their original order: files by number, rows by place."""
    rows = documents.evaluation_rows(spark, [("ucihar", _file_folder(spark, d))], glob="*.txt").withColumn("file", _file_number())
    return documents.first_rows(rows, 75, "file", "pos").select("file", "pos", "sample_id")


def written_results(spark: SparkSession, d: str) -> DataFrame:
    """Result rows as they stand in the file: private and listed columns gone, undefined values there as null."""
    path = stage_folder(spark, "results")
    rows = _texts(spark, d).select(
        "doc_id", F.col("lang").alias("_gen_graph"), F.col("source").alias("embedding"),
        F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("score"),
    )
    sinks.write_results(rows, path, drop=["embedding"])
    return spark.read.text(path).select(F.col("value").alias("line"))


def _requests(spark: SparkSession, d: str, relaxed: bool) -> DataFrame:
    return match.requests(_rows(spark, d), SET, relaxed=relaxed)


def strict_request_texts(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d, relaxed=False).select("sample_id", "kind", "i", "j", F.md5("request").alias("request_md5"))


def relaxed_request_texts(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d, relaxed=True).select(
        "sample_id", "kind", "i", "j", F.md5("request").alias("request_md5"), "auto_verdict"
    )


def _first_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of every other batch of a first call, as a judge leaves them that was stopped."""
    asked = verdicts.batches(_requests(spark, d, relaxed=True), size=64)
    return staged(asked.where("batch % 2 = 0").select(
        "request_id", F.when(F.col("request_id") < "8", "YES").otherwise("NO, not the same").alias("response")
    ), "answers")


def resumed_request_batches(spark: SparkSession, d: str) -> DataFrame:
    """The second call: what the first left open, in new batches."""
    again = verdicts.batches(_requests(spark, d, relaxed=True), _first_answers(spark, d), size=64)
    return again.select("batch", "request_id", "kind", F.length("request").alias("n_chars"), "n_pairs")


def answered_pairs(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.responses(_requests(spark, d, relaxed=True), _first_answers(spark, d), KEY)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answers of a teacher, two to a key."""
    return _texts(spark, d).select(
        F.col("doc_id").alias("seq"), F.expr("if((doc_id div 2) % 5 = 0, 'test', 'train')").alias("split"),
        F.expr("cast(doc_id div 2 as string)").alias("sample_id"),
        F.col("lang").alias("activity"), (F.col("n_chars") % 100 / 100.0).alias("confidence"),
        F.lit(None).cast("string").alias("mantis_embedding"), F.col("text").alias("answer"),
    )


def committed_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Two committed runs with common keys, and between them one that writes its rows and is not committed."""
    path, answers = stage_folder(spark, "corpus"), _answers(spark, d)
    committed.append_answers(answers.where("seq % 3 = 0"), path, "first", "teacher")
    lost = corpus.training_examples(corpus.reasoning_records(answers.drop("seq"), "teacher")).drop("sample_id")
    committed.write_attempt(lost, path, "second")
    committed.append_answers(answers, path, "second", "teacher")
    return committed.committed(spark, path).select(
        "run", "split", F.col("metadata.sample_id").alias("sample_id"), F.col("metadata.predicted_activity").alias("activity"),
        F.md5("output").alias("output_md5"),
    )


def committed_records(spark: SparkSession, d: str) -> DataFrame:
    """Records per split, counted by the manifests and by what is read back."""
    path, answers = stage_folder(spark, "records"), _answers(spark, d)
    for part in (0, 1):
        records = corpus.reasoning_records(answers.where(F.col("seq") % 2 == part).drop("seq"), "teacher")
        committed.append_records(records, path, f"part{part}")
    rows = committed.committed(spark, path, "sample_id string, confidence double, split string", "parquet")
    per_split = rows.groupBy("run", "split").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"))
    return per_split.join(committed.manifests(spark, path).select("run", F.col("n_rows").alias("n_run")), "run")


def _tagged(rows: DataFrame) -> DataFrame:
    """Rows of three datasets in one table, one of them not in the registry."""
    k = F.col("sample_id").cast("bigint")
    return rows.withColumn("dataset", F.when(k % 3 == 0, "PAMAP2").when(k % 7 == 1, "elsewhere").otherwise("ucihar"))


def dataset_match_summary(spark: SparkSession, d: str) -> DataFrame:
    verdicts = _tagged(_verdicts(spark, d))
    samples = match.coded_samples_of_datasets(_tagged(_eval_rows(spark, d)))
    return matching.summary(match.sample_scores(samples, verdicts, ("dataset", "sample_id")), ["dataset"])


def dataset_node_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = vocabulary.with_vocabulary(_tagged(_eval_rows(spark, d)))
    graphs = graph.with_reference(graph.parse_eval_rows(rows))
    return graph.node_rates(graphs, vocabulary.field("classes"), vocabulary.field("sensors"), ["dataset"])


def dataset_unresolved_sensors(spark: SparkSession, d: str) -> DataFrame:
    rows = vocabulary.with_vocabulary(_tagged(_rows(spark, d)))
    prepared = matching.prepare(rows, vocabulary.field("names"), ["dataset", "sample_id"])
    return matching.unresolved_sensors(prepared, ["dataset"])


ALL: Sequence[Query] = (
    trace_observations, trace_inferences, trace_citations, trace_conclusions, parse_success,
    node_rates_by_class, chain_validity_samples, chain_validity, coverage_by_class, coverage, grounding,
    predicted_activities, classification_summary, class_report, confusion_matrix, label_report,
    label_confusion, turn_rouge_l, turn_text_scores, document_text_scores, document_term_recall,
    conditioned_term_recall, condition_counts, vector_f1, judge_requests, parsed_verdicts,
    unresolved_sensors, observation_matches, inference_matches, match_scores, match_summary,
    lexical_match_summary, file_identities, ranked_evidence, prompt_texts, document_flags, turn_flags,
    class_quality, oversized_prompts, remaining_sources, source_counts, new_corpus_rows,
    train_validation_split, latest_references, attribution_index, rolling_quality, run_throughput,
    every_50th, qualitative_samples, window_distances, registry_sizes, run_statistics, combined_report,
    evaluation_report, training_examples, smallest_sources, merged_shards, frequent_unresolved_sensors,
    evaluation_file_report, evaluation_file_rows, dataset_match_summary, dataset_node_rates,
    dataset_unresolved_sensors, ingested_corpus, committed_corpus, committed_records,
    strict_request_texts, relaxed_request_texts, resumed_request_batches, answered_pairs,
    scoped_term_recall, report_lines, evaluation_samples, shard_gaps, match_document, tolerant_lines,
    first_inference_rows, written_results,
)


def entry(spark: SparkSession) -> DataFrame:
    """Node rates per class: text to graph to rates."""
    return _tidied(node_rates_by_class)(spark, "/root/testdata/sf0.001")


def _tidied(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return tidy(query(spark, sf_dir))

    return run


def queries() -> dict[str, Query]:
    out = {query.__name__: _tidied(query) for query in ALL}
    out["grounding_samples"] = _tidied(_grounding)
    return out | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES) | (llm.oracle_sql() if llm else {})
