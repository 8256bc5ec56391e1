"""Trace inputs derived from general tables, for tests and benchmarks.

Every order gives one sample. Its nodes come from arithmetic on the order's own columns, row by row: nothing is
grouped or joined, so the derivation scales with the table and no key can become hot. The relation is then
rendered to trace text, and the operators only ever see that text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonmill.functions.expr import strings
from reasonmill.operators.ordering import with_group_position
from reasonmill.registry import UCIHAR_CLASSES
from reasonmill.sources import rendered
from reasonmill.sources.tables import table

RAW_SENSORS = ("body_acc_x", "gyro_z", "total_acc_y", "Body Acceleration X", "heart_rate", "GYRO-Z")
WINDOWS = ("early", "early_to_mid", "mid", "mid_to_late", "late", "throughout", "full_window")
PATTERNS = ("sharp peak then drop", "holds near baseline", "slow rise")
CLASSES = tuple(UCIHAR_CLASSES)
SYNTHESES = ("the body keeps still", "the legs swing in rhythm", "the trunk turns")

_OBSERVATION = """named_struct(
    'i', i,
    's', cast((h{shift_s}) % 6 as int),
    'w', cast((h div 6{shift_w}) % 7 as int),
    'q', cast((h div 42{shift_q}) % 3 as int),
    'conf', case when h % 5 = 0 then 'medium' when i <= 3 then 'high' when i <= 6 then 'moderate' else 'low' end,
    'num', {num})"""


def _nodes(count: str, build: str) -> str:
    build = build.replace("(h", "((k * 7 + c * 13 + p + i * 37)").replace("when h ", "when (k * 7 + c * 13 + p + i * 37) ")
    return f"transform(filter(sequence(1, 12), i -> i <= {count}), i -> {build})"


_INFERENCE = """named_struct(
    'i', i, 'a', cast((k + {j}) % 8 + 1 as int), 'b', cast((c + 3 * {j}) % 8 + 1 as int),
    'lost', (k + {j}) % 10 = 0, 't', cast((k + c + {j}) % 4 as int))"""


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("k"),
        F.col("o_custkey").cast("bigint").alias("c"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("p"),
    )


def _dealt(base: DataFrame) -> DataFrame:
    """A small file is one partition, and adaptive execution would keep three numbers a row together: deal them out by
    number before they become texts."""
    return base.repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")


def orders_relation(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with the nodes of its reference and of its generated trace as arrays of integers."""
    return _relation(_dealt(_orders(spark, folder)))


def _relation(base: DataFrame) -> DataFrame:
    counted = base.selectExpr(
        "*",
        "cast((p + k) % 9 as int) as n_gt",
        "cast(greatest((p + k) % 9 - k % 3, 0) + c % 2 as int) as n_pred",
        "cast((k + c) % 4 as int) as m_gt",
        "cast((k + c + if(c % 5 = 0, 1, 0)) % 4 as int) as m_pred",
    )
    swapped = "(case when k % 4 = 0 and i <= 2 then 3 - i else i end)"
    return counted.selectExpr(
        "*",
        _nodes("n_gt", _OBSERVATION.format(shift_s="", shift_w="", shift_q="", num="i")) + " as gt_obs",
        _nodes(
            "n_pred",
            _OBSERVATION.format(
                shift_s=" + if((i + c) % 7 = 0, 1, 0)",
                shift_w=" + if((i + k) % 5 = 0, 1, 0)",
                shift_q=" + if((i + k + c) % 4 = 0, 1, 0)",
                num="if(k % 41 = 0 and i > 1, i - 1, i)",
            ),
        )
        + " as pred_obs",
        _nodes("m_gt", _INFERENCE.format(j="i")) + " as gt_inf",
        _nodes("m_pred", _INFERENCE.format(j=swapped)) + " as pred_inf",
        "if(k % 13 = 0, null, if(k % 11 = 0, 9, 1)) as gt_syn",
        "if((k + c) % 17 = 0, null, if(k % 7 = 0, 9, 1)) as pred_syn",
        "cast(k % 3 as int) as gt_syn_text",
        "cast(c % 3 as int) as pred_syn_text",
        "cast(p % 6 as int) as cls",
        "cast(case when c % 4 = 0 then (p + 1) % 6 else p % 6 end as int) as pred_cls",
    )


def _pick(values: Sequence[str], index: Column) -> Column:
    return F.get(strings(values), index)


def _inference_text(inf: Column, observations: Column) -> Column:
    """Four wordings: sensor name, sensor with blanks, axis letter only, nothing."""
    cited = F.filter(observations, lambda o: o["num"] == inf["a"])
    index = F.coalesce(F.try_element_at(cited, F.lit(-1))["s"], F.lit(len(RAW_SENSORS)))
    names = [s.lower() for s in RAW_SENSORS] + ["nothing"]
    return (
        F.when(inf["t"] == 0, _pick([f"the {s} signal moves" for s in names], index))
        .when(inf["t"] == 1, _pick([f"Motion in {s.replace('_', ' ')} here" for s in names], index))
        .when(inf["t"] == 2, "motion along z")
        .otherwise("calm and still")
    )


def _render(obs: str, inf: str, syn: str, syn_text: str, activity: Column) -> Column:
    """Trace text, with lower-case headers for some samples and carriage returns for others."""
    head = lambda word: F.when(
        F.col("k") % 3 == 0, f"[{word.lower()} | id: {word[0]}"
    ).otherwise(f"[{word} | id: {word[0]}")
    o_text = F.transform(
        F.col(obs),
        lambda o: F.concat(
            head("OBSERVATION"), o["num"].cast("string"),
            _pick([f"]\nsensor: {s}\ntemporal: " for s in RAW_SENSORS], o["s"]),
            _pick([f"{w} \npattern: " for w in WINDOWS], o["w"]),
            _pick([f"{p}\nconfidence: " for p in PATTERNS], o["q"]), o["conf"], F.lit("\n\n"),
        ),
    )
    i_text = F.transform(
        F.col(inf),
        lambda n: F.concat(
            head("INFERENCE"), n["i"].cast("string"),
            F.lit("]\nbased_on: O"), n["a"].cast("string"), F.lit(", O"), n["b"].cast("string"),
            F.when(n["lost"], ", O99\ninference: ").otherwise("\ninference: "),
            _inference_text(n, F.col(obs)), F.lit("\nconfidence: high\n\n"),
        ),
    )
    s_text = F.when(
        F.col(syn).isNotNull(),
        F.concat(
            F.lit("[SYNTHESIS]\nbased_on: I"), F.col(syn).cast("string"),
            _pick([f"\n{t}\n\n" for t in SYNTHESES], F.col(syn_text)),
        ),
    ).otherwise("")
    text = F.concat(
        F.array_join(o_text, ""), F.array_join(i_text, ""), s_text, F.coalesce(activity, F.lit(""))
    )
    return F.replace(text, F.lit("\n"), F.when(F.col("k") % 5 == 0, "\r\n").otherwise("\n"))


def _usual() -> Column:
    """Orders without missing and negative numbers, whose texts and verdicts are made in Arrow batches."""
    return F.coalesce((F.col("k") >= 0) & (F.col("c") >= 0) & (F.col("p") >= 0), F.lit(False))


def eval_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Hub table of the evaluation: reference text, generated text and true class of every order."""
    base, usual = _orders(spark, folder), _usual()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return rendered.batches(batches, RAW_SENSORS, WINDOWS, PATTERNS, SYNTHESES, CLASSES)

    odd = _eval_rows(_relation(_dealt(base.where(~usual))))
    return _dealt(base.where(usual)).mapInArrow(render, odd.schema).unionAll(odd)


def _eval_rows(rel: DataFrame) -> DataFrame:
    """The same as expressions, for orders with missing or negative numbers too."""
    cls = F.initcap(_pick(CLASSES, F.col("cls")))
    guess = F.replace(F.initcap(_pick(CLASSES, F.col("pred_cls"))), F.lit(" "), F.lit("_"))
    gt_line = F.concat(F.lit("[ACTIVITY]: "), cls)
    pred_line = (
        F.when(F.col("k") % 13 == 1, None)
        .when(F.col("c") % 17 == 0, "[ACTIVITY]: Break_Dancing\n[ACTIVITY]: walking")
        .otherwise(F.concat(F.lit("[Activity] : "), guess, F.when(F.col("c") % 2 == 0, " today").otherwise("")))
    )
    reference = _render("gt_obs", "gt_inf", "gt_syn", "gt_syn_text", gt_line)
    generated = _render("pred_obs", "pred_inf", "pred_syn", "pred_syn_text", pred_line)
    return rel.select(
        F.col("k").cast("string").alias("sample_id"),
        _pick(CLASSES, F.col("cls")).alias("gt_activity"),
        F.when(F.col("c") % 19 == 0, None)
        .when(F.col("c") % 19 == 1, "  \n ")
        .otherwise(reference)
        .alias("ground_truth_reasoning"),
        F.when(F.col("c") % 23 == 0, " ").otherwise(generated).alias("generated"),
    )


def verdict_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict texts for the candidate pairs of every order, from the relation and not from the trace text.

    Some pairs have no verdict and some an undecided one, as a failing judge would leave them.
    """
    base, usual = _orders(spark, folder), _usual()
    odd = _verdict_rows(_relation(_dealt(base.where(~usual))))
    return _dealt(base.where(usual)).mapInArrow(rendered.verdicts, odd.schema).unionAll(odd)


def _verdict_rows(rel: DataFrame) -> DataFrame:
    """The same as expressions, for orders with missing or negative numbers too."""
    k = F.col("k")
    channel = F.array(*[F.lit(v) for v in (0, 1, 2, 0, 3, 1)])
    row = lambda kind, i, j, response: F.struct(
        F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"),
        response.alias("response"),
    )

    def pair_up(left: str, right: str, keep, response) -> Column:
        return F.flatten(
            F.transform(
                left,
                lambda a: F.transform(
                    F.filter(right, lambda b: keep(a, b)), lambda b: response(a, b)
                ),
            )
        )

    def obs_response(a: Column, b: Column) -> Column:
        text = (
            F.when((a["q"] == b["q"]) & (F.abs(a["w"] - b["w"]) <= 1), "yes, the same\nboth agree")
            .when((7 * a["i"] + b["i"] + k) % 29 == 0, "hard to tell")
            .when((a["i"] + 2 * b["i"] + k) % 31 == 0, None)
            .otherwise("NO\nthey differ")
        )
        return row("observation", a["i"] - 1, b["i"] - 1, text)

    def inf_response(a: Column, b: Column) -> Column:
        text = (
            F.when((a["t"] == b["t"]) & ((k + a["i"] + b["i"]) % 3 != 0), "I would say YES")
            .when((a["i"] + b["i"] + k) % 7 == 0, "unclear")
            .otherwise("Nothing in common")
        )
        return row("inference", a["i"] - 1, b["i"] - 1, text)

    obs = pair_up(
        "gt_obs", "pred_obs", lambda a, b: F.get(channel, a["s"]) == F.get(channel, b["s"]), obs_response
    )
    inf = pair_up("gt_inf", "pred_inf", lambda a, b: F.lit(True), inf_response)
    syn = F.when(
        F.col("gt_syn").isNotNull() & F.col("pred_syn").isNotNull(),
        F.array(
            row(
                "synthesis",
                F.lit(0),
                F.lit(0),
                F.when(F.col("gt_syn_text") == F.col("pred_syn_text"), "YES")
                .when(k % 9 == 0, "perhaps")
                .otherwise("no"),
            )
        ),
    ).otherwise(F.slice(inf, 1, 0))
    return (
        rel.select(k.cast("string").alias("sample_id"), F.explode(F.concat(obs, inf, syn)).alias("v"))
        .select("sample_id", "v.*")
        .where("response is not null")
    )


RAW_ATTRIBUTED = ("Acc_X", "Gyro_Z", "Total_Acc_Y", "AccZ", "Heart_Rate", "")


def attribution_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Attribution documents with file names: some without an id, some in both splits, some samples without any."""
    rel = orders_relation(spark, folder).select("k", "c", "p", "cls")
    versions = F.when(F.col("k") % 29 == 0, F.array().cast("array<int>")).when(
        F.col("k") % 10 == 0, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.when(F.col("c") % 3 == 0, 1).otherwise(0)))
    docs = rel.withColumn("v", F.explode(versions))
    stem = F.format_string(
        "%s_class%d_%s_s%07d.json",
        F.when(F.col("v") == 1, "test").otherwise("train"), F.col("cls"),
        F.replace(F.initcap(_pick(CLASSES, F.col("cls"))), F.lit(" "), F.lit("")), F.col("k"),
    )
    regions = F.expr(
        """transform(filter(sequence(1, 12), r -> r <= (p div 7 + c + v) % 13), r -> named_struct(
            's', cast((p + k + r * 5 + v) % 6 as int), 'm', cast((p * 3 + c + r * 7) % 11 as int),
            't', cast((p + r * 29) % 128 as int), 'l', cast((c + r * 17 + p % 50) % 110 + 1 as int)))"""
    )
    return docs.withColumn("r", regions).select(
        F.col("k").cast("string").alias("sample_idx"),
        _pick(CLASSES, F.col("cls")).alias("activity"),
        (F.col("p") % 100 / 100.0).alias("confidence"),
        F.when(F.col("k") % 4 != 0, F.col("c") % 10 / 100.0).alias("attribution_threshold_p90"),
        F.transform(
            "r",
            lambda r: F.struct(
                _pick(RAW_ATTRIBUTED, r["s"]).alias("sensor"),
                r["t"].alias("start_t"),
                (r["t"] + r["l"]).alias("end_t"),
                r["l"].alias("length"),
                F.when(r["m"] != 10, r["m"] / 100.0).alias("mean_importance"),
                (r["m"] / 50.0).alias("max_importance"),
                (r["t"] + 1).alias("peak_timestep"),
            ),
        ).alias("high_attribution_regions"),
        F.array(
            F.struct(F.lit("start").alias("phase"), (F.col("p") % 7 / 10.0).alias("importance")),
            F.struct(F.lit("end").alias("phase"), (F.col("p") % 9 / 10.0).alias("importance")),
        ).alias("temporal_phase_importance"),
        F.when(F.col("c") % 31 == 0, F.format_string("misc_%d_v%d.json", "k", "v"))
        .otherwise(stem)
        .alias("file_name"),
    )


def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn of a conversation as reference and the next turn as generated text, both whole."""
    turns = table(spark, folder, "conversations")
    after = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("generated")
    )
    pairs = turns.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", "role", F.col("text").alias("ground_truth_reasoning"), "generated"
    )
    return pairs.hint("rebalance")


def document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each document and the next one, if they share the language; texts are whole."""
    docs = table(spark, folder, "documents")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), "lang", F.col("text").alias("generated"))
    pairs = docs.join(after, ["doc_id", "lang"]).select(
        "doc_id", "lang", F.col("text").alias("ground_truth_reasoning"), "generated"
    )
    return pairs.hint("rebalance")  # comparing two texts costs far more than moving them


def token_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Eight neighbouring vectors make a sample; even ones are the reference side."""
    return table(spark, folder, "embeddings").select(
        F.expr("vec_id div 8").alias("sample_id"),
        F.when(F.col("vec_id") % 2 == 0, "reference").otherwise("generated").alias("side"),
        F.expr("(vec_id % 8) div 2").alias("pos"),
        F.col("embedding").alias("vec"),
    )


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as the log of generation runs, one run per event type, 128 rows a batch."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    placed = with_group_position(events, "event_type", ["ts", "event_id"], "seq")
    flag = lambda c: c.cast("double")
    return placed.select(
        F.col("event_type").alias("dataset"),
        F.col("seq").cast("bigint").alias("seq"),
        F.expr("cast(seq div 128 as bigint)").alias("batch"),
        F.floor("value").cast("double").alias("tokens"),
        (F.floor("value") * 5 + F.col("user_id") % 5).cast("double").alias("chars"),
        flag(F.col("user_id") % 4 == 0).alias("leak"),
        flag(F.col("user_id") % 9 == 0).alias("refusal"),
        flag(F.col("event_id") % 6 == 0).alias("parse_fail"),
        (F.col("event_id") % 10).cast("double").alias("n_obs"),
        (F.col("user_id") % 4).cast("double").alias("n_inf"),
        ((F.col("user_id") % 7 + 1) / 10.0).alias("seconds"),
    )


FILE_ROWS = 16


def write_evaluation_files(spark: SparkSession, folder: str, target: str) -> None:
    """Documents as evaluation files of sixteen rows each: arrays (some with an entry that is no row), objects, objects
    without rows, and broken ones."""
    number = F.expr(f"doc_id div {FILE_ROWS}")
    row = F.struct(
        "doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id")).alias("sample_id"),
        F.col("lang").alias("gt_activity"), F.col("source").alias("predicted_activity"),
        F.col("text").alias("ground_truth_reasoning"), F.col("source").alias("generated"),
        (F.col("doc_id") % 2 == 0).alias("prefix_active"),
    )
    rows = table(spark, folder, "documents").where("doc_id is not null")
    files = rows.groupBy(number.alias("file")).agg(F.sort_array(F.collect_list(row)).alias("rows"))  # at most 16 each
    plain = F.transform("rows", lambda r: r.dropFields("doc_id"))
    array = F.concat(F.lit("["), F.array_join(F.transform(plain, lambda r: F.to_json(r)), ",\n"), F.when(F.col("file") % 8 == 0, ", 7]").otherwise("]"))
    whole = F.to_json(F.struct(
        F.col("file").alias("run"), F.lit(3).alias("n_runs"),
        F.create_map(F.lit("model"), F.concat(F.lit("m"), F.col("file").cast("string"))).alias("config"),
        plain.alias("per_sample"),
    ))
    kind = F.col("file") % 4
    text = F.when(kind == 0, array).when(kind == 1, whole).when(kind == 2, F.replace(whole, F.lit("per_sample"), F.lit("rows")))
    files.select("file", text.otherwise(F.substr(array, F.lit(1), F.length(array) - 1)).alias("value")).write.partitionBy(
        "file"
    ).option("maxRecordsPerFile", 1).text(target)
