"""Semantic node matching of reference and generated traces.

Both graphs of a sample sit in one row, so candidate pairs, assignment, scores and provenance need that row only.
A verdict table that comes from outside costs one shuffle of the samples, without their text, and of the verdicts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reasonmill.functions.assign import PAIR_BASE
from reasonmill.functions.coded import COUNT_FIELDS, NODE_FIELDS, OPEN_FIELD, SAID_FIELDS, Vocabulary, coded_batches, counted_batches, packed_batches
from reasonmill.functions.expr import harmonic_mean, let, share, strings
from reasonmill.functions.matches import (
    INF, KINDS, OBS, PAIRS_TYPE, SYN, VERDICTS, inference_matches, judged_batches, match_counts, observation_matches,
)
from reasonmill.functions.parse import match_graph, trace_graph, unresolved_names
from reasonmill.functions.text import is_blank, verdict_of
from reasonmill.functions.vocab import canonical_sensor, window_distance
from reasonmill.schema import as_column

SCORES = (
    "snm_op", "snm_or", "snm_of1", "snm_o_temporal", "snm_o_cover",
    "snm_ip", "snm_ir", "snm_if1",
    "snm_iprov_abs", "snm_iprov_clean", "snm_iprov_penalised",
    "snm_sa",
)


# ---- preparation -------------------------------------------------------------------------------------------


def _match_graph(text: str, sensors: Sequence[str] | Column) -> Column:
    """Graph whose observations carry the canonical sensor next to the raw one."""
    if not isinstance(sensors, Column):
        return match_graph(text, sensors)

    def build(g: Column) -> Column:
        obs = F.transform(
            g["observations"],
            lambda o: let(
                canonical_sensor(o["sensor"], sensors),
                lambda s: F.struct(
                    o["id"].alias("id"),
                    s["name"].alias("sensor"),
                    o["sensor"].alias("raw_sensor"),
                    s["resolved"].alias("resolved"),
                    o["temporal"].alias("temporal"),
                    o["pattern"].alias("pattern"),
                ),
            ),
        )
        return F.struct(
            obs.alias("obs"), g["inferences"].alias("inf"), g["synthesis"].alias("syn")
        )

    return let(trace_graph(text), build)


def prepare(rows: DataFrame, sensors: Sequence[str] | Column, keys: Sequence[str]) -> DataFrame:
    """Parses both sides and says why a sample cannot be scored (``skip_reason``, NULL if it can).

    ``keys`` must identify a row: where sample ids repeat, add the file and the position in it.
    """
    parsed = rows.select(
        *keys,
        "gt_activity",
        "predicted_activity",
        is_blank("ground_truth_reasoning").alias("_no_gt"),
        is_blank("generated").alias("_no_pred"),
        _match_graph("ground_truth_reasoning", sensors).alias("gt"),
        _match_graph("generated", sensors).alias("pred"),
    )
    return parsed.withColumn(
        "skip_reason",
        F.when(F.col("_no_gt"), "no_gt_reasoning")
        .when(F.col("_no_pred"), "no_pred_text")
        .when(F.size("gt.obs") == 0, "gt_parse_fail")
        .when(F.size("pred.obs") == 0, "pred_parse_fail"),
    ).drop("_no_gt", "_no_pred")


def _if_scoreable(pairs: Column) -> Column:
    """NULL for skipped samples. A filter instead would be pushed below the parse and run it a second time."""
    return F.when(F.col("skip_reason").isNull(), pairs)


def unresolved_sensors(
    prepared: DataFrame, by: Sequence[str] = (), top: int | None = None
) -> DataFrame:
    """How often each sensor string could not be resolved, over all rows that have both texts; on request only the
    most frequent ones."""
    blank = F.coalesce(F.col("skip_reason").isin("no_gt_reasoning", "no_pred_text"), F.lit(False))
    raw = F.transform(
        F.filter(F.concat("gt.obs", "pred.obs"), lambda o: ~o["resolved"]), lambda o: o["raw_sensor"]
    )
    return _counted(prepared.select(*by, F.explode(F.when(~blank, raw)).alias("raw")), by, top)


def unresolved_sensors_of(
    rows: DataFrame, sensors: Sequence[str], by: Sequence[str] = (), top: int | None = None
) -> DataFrame:
    """``unresolved_sensors`` of rows that need no other preparation: only the open names leave the parse."""
    sides = ("ground_truth_reasoning", "generated")
    found = rows.select(*by, *[is_blank(s).alias(f"_{s}") for s in sides], unresolved_names(sides, sensors).alias("_raw"))
    raw = F.when(~F.col("_ground_truth_reasoning") & ~F.col("_generated"), F.col("_raw"))
    return _counted(found.select(*by, F.explode(raw).alias("raw")), by, top)


def _counted(names: DataFrame, by: Sequence[str], top: int | None) -> DataFrame:
    counts = names.groupBy(*by, "raw").agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), *by, "raw").limit(top)


# ---- candidate pairs ---------------------------------------------------------------------------------------


def _cross_refs(left: Column, right: Column, keep, build) -> Column:
    """Pairs of two node lists of one trace that pass ``keep``, in list order."""
    return F.flatten(
        F.transform(
            left,
            lambda a, i: F.transform(
                F.filter(
                    F.transform(right, lambda b, j: F.struct(j.alias("j"), b.alias("b"))),
                    lambda x: keep(a, x["b"]),
                ),
                lambda x: build(a, i, x["b"], x["j"]),
            ),
        )
    )


def _same_sensor(a: Column, b: Column) -> Column:
    return (a["sensor"] != "") & (a["sensor"] == b["sensor"])


def _pairs(build) -> Column:
    """All candidates of a sample: same-sensor observations, all inferences, and the two syntheses."""
    gt, pred = F.col("gt"), F.col("pred")
    obs = _cross_refs(
        gt["obs"], pred["obs"], _same_sensor, lambda a, i, b, j: build(OBS, i, j, a, b)
    )
    inf = _cross_refs(
        gt["inf"], pred["inf"], lambda a, b: F.lit(True), lambda a, i, b, j: build(INF, i, j, a, b)
    )
    syn = F.when(
        gt["syn"].isNotNull() & pred["syn"].isNotNull(),
        F.array(build(SYN, F.lit(0), F.lit(0), gt["syn"], pred["syn"])),
    ).otherwise(F.slice(inf, 1, 0))
    return F.concat(obs, inf, syn)


_QUESTIONS = {
    (OBS, False): "Do both observations of this sensor describe the same signal behaviour in the same window?",
    (OBS, True): "Do both patterns of this sensor go in the same direction?",
    (INF, False): "Do both inferences give the same movement interpretation?",
    (INF, True): "Do both inferences describe the same state of the body?",
    (SYN, False): "Do both syntheses come to the same conclusion on the activity?",
    (SYN, True): "Do both syntheses come to the same conclusion on the activity?",
}
_ANSWER_FORM = " Begin with YES or NO on a line of its own."


def _request(kind: str, i: Column, j: Column, a: Column, b: Column, relaxed: bool, tolerance: int):
    question = F.lit("\n" + _QUESTIONS[kind, relaxed] + _ANSWER_FORM)
    auto = F.lit(None).cast("string")
    if kind == OBS:
        head = F.concat(F.lit("Sensor: "), a["sensor"], F.lit("\n"))
        if relaxed:
            far = window_distance(a["temporal"], b["temporal"]) > tolerance
            auto = F.when(far, "NO")
            body = [F.lit("Reference: "), a["pattern"], F.lit("\nGenerated: "), b["pattern"]]
        else:
            body = [
                F.lit("Reference ("), a["temporal"], F.lit("): "), a["pattern"],
                F.lit("\nGenerated ("), b["temporal"], F.lit("): "), b["pattern"],
            ]
        text = F.concat(head, *body, question)
    else:
        field = "inference" if kind == INF else "text"
        text = F.concat(F.lit("Reference: "), a[field], F.lit("\nGenerated: "), b[field], question)
    return F.struct(
        F.lit(kind).alias("kind"),
        i.alias("i"),
        j.alias("j"),
        F.when(auto.isNull(), text).alias("request"),
        auto.alias("auto_verdict"),
    )


def judge_requests(
    prepared: DataFrame, keys: Sequence[str], relaxed: bool = False, tolerance: int = 1
) -> DataFrame:
    """One row per pair that needs a verdict. In relaxed mode observations in distant windows get an automatic NO
    and no request."""
    pairs = _pairs(lambda kind, i, j, a, b: _request(kind, i, j, a, b, relaxed, tolerance))
    return prepared.select(*keys, F.explode(_if_scoreable(pairs)).alias("p")).select(*keys, "p.*")


# ---- verdicts ----------------------------------------------------------------------------------------------


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda t: t != ""))


def token_overlap(a: Column, b: Column) -> Column:
    return let(
        F.struct(_tokens(a).alias("a"), _tokens(b).alias("b")),
        lambda t: F.coalesce(
            share(F.size(F.array_intersect(t["a"], t["b"])), F.size(F.array_union(t["a"], t["b"]))),
            F.lit(0.0),
        ),
    )


def _pair_struct(kind: str, i: Column, j: Column, same_window: Column, verdict: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        i.cast("int").alias("i"),
        j.cast("int").alias("j"),
        same_window.cast("int").alias("same_window"),
        verdict.alias("verdict"),
    )


def _same_window(kind: str, a: Column, b: Column) -> Column:
    return a["temporal"] == b["temporal"] if kind == OBS else F.lit(False)


def with_lexical_verdicts(
    prepared: DataFrame, threshold: float = 0.5, tolerance: int = 1
) -> DataFrame:
    """Verdicts by token overlap, inside the row: a stand-in for tests and dry runs."""

    def build(kind: str, i: Column, j: Column, a: Column, b: Column) -> Column:
        field = {OBS: "pattern", INF: "inference", SYN: "text"}[kind]
        same = token_overlap(a[field], b[field]) >= threshold
        if kind == OBS:
            same = same & (window_distance(a["temporal"], b["temporal"]) <= tolerance)
        verdict = F.when(same, "YES").otherwise("NO")
        return _pair_struct(kind, i, j, _same_window(kind, a, b), verdict)

    return prepared.withColumn("pairs", _if_scoreable(_pairs(build)))


def _verdict_code(verdict: Column | str) -> Column:
    """Rank of a verdict; of several for one pair the highest counts."""
    ranks = strings(VERDICTS)
    return F.nullif(F.array_position(ranks, as_column(verdict)), F.lit(0)).cast("int") - 1


def _placed(verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verdicts that a pair can have, with the place of that pair."""
    spread = F.lit(PAIR_BASE).cast("bigint")
    kind = F.array_position(strings(KINDS), F.col("kind")) - 1
    within = lambda c: F.col(c).between(0, PAIR_BASE - 1)
    return verdicts.where((kind >= 0) & within("i") & within("j")).dropna(subset=list(keys)).select(
        *keys, ((kind * spread + F.col("i")) * spread + F.col("j")).alias("_place"), "response"
    )


def with_verdict_table(
    prepared: DataFrame,
    verdicts: DataFrame,
    keys: Sequence[str],
    relaxed: bool = False,
    tolerance: int = 1,
) -> DataFrame:
    """Joins verdict responses ``(keys, kind, i, j, response)`` to the pairs of each sample.

    Samples and verdicts meet in one shuffle and one sort, as a sample followed by its verdicts, and are read off in
    order: a verdict is a code and a rank, of repeated ones YES counts over NO and NO over an error, and only requested
    pairs are kept, so what is held of a sample is bounded by its own nodes. Pass rows ``without_text``.
    """
    answers = _placed(verdicts, keys).select(
        *keys, F.lit(True).alias("_answer"), "_place", _verdict_code(verdict_of("response")).alias("_rank")
    )
    asked = prepared.withColumns(
        {"_answer": F.lit(False), "_place": F.lit(None).cast("bigint"), "_rank": F.lit(None).cast("int")}
    )
    met = asked.unionByName(answers, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "_answer")
    out = T.StructType([*prepared.schema.fields, T.StructField("pairs", PAIRS_TYPE)])
    return met.mapInArrow(partial(judged_batches, keys=tuple(keys), relaxed=relaxed, tolerance=tolerance), out)


def _without_text(side: str) -> Column:
    listed = lambda node, *names: F.struct(*[F.col(f"{side}.{node}.{n}").alias(n) for n in names]).alias(node)
    return F.struct(
        listed("obs", "id", "sensor", "temporal"), listed("inf", "id", "based_on"),
        F.when(F.col(f"{side}.syn").isNotNull(), F.struct(F.lit(True).alias("present"))).alias("syn"),
    )


def without_text(prepared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What matching needs once the requests are out: ids, sensors, windows and citations, each as a list of its own."""
    return prepared.select(
        *keys, "gt_activity", "predicted_activity", "skip_reason",
        *[_without_text(side).alias(side) for side in ("gt", "pred")],
    )


# ---- samples without names -----------------------------------------------------------------------------------


def coded(
    rows: DataFrame, vocabularies: Mapping[str, Vocabulary], keys: Sequence[str], of: Column | None = None,
    open_sensors: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with both sides as integers, cut and named in one pass over the texts: ``(keys, gt_activity, label, rest,
    skip_reason, nodes)``, where ``label`` is the class that the generated text names or else ``rest`` that text.

    ``of`` names the vocabulary of a row, that of "" is for all others. With ``open_sensors`` it also has ``open_names``, in
    some rows, which are the counts of ``unresolved_sensors`` in parts.
    """
    sides = (("ground_truth_reasoning", "gt"), ("generated", "pred"))
    base = rows.select(
        *keys, "gt_activity", *[F.make_valid_utf8(t).alias(f"_{side}") for t, side in sides],
        *[is_blank(t).alias(f"_no_{side}") for t, side in sides], (F.lit("") if of is None else of).alias("_of"),
    )
    carried = (*keys, "gt_activity")
    extra = [*SAID_FIELDS, *NODE_FIELDS, *([] if open_sensors is None else [OPEN_FIELD])]
    out = T.StructType([*[base.schema[c] for c in carried], *extra])
    return base.mapInArrow(partial(coded_batches, carried=carried, vocabularies=dict(vocabularies), open_sensors=open_sensors), out)


def open_counts(coded: DataFrame) -> DataFrame:
    """``unresolved_sensors`` of rows ``coded`` with ``open_sensors``."""
    return coded.select(F.explode("open_names").alias("x")).groupBy("x.raw").agg(F.sum("x.n").alias("n"))


def counted(
    coded: DataFrame, verdicts: DataFrame, keys: Sequence[str], relaxed: bool = False, tolerance: int = 1
) -> DataFrame:
    """Coded rows, with ``predicted_activity``, to what their scores are made of: ``with_verdict_table`` and the counts of
    ``score`` without the matches, and the numbers of pairs that ``judge_requests`` asks for, strictly and relaxed. Verdicts of
    one sample that stand together travel as one row."""
    answers = _placed(verdicts, keys).withColumn("response", F.col("response").cast("binary"))
    names = T.StructType([*[answers.schema[k] for k in keys], T.StructField("_codes", T.BinaryType())])
    packed = answers.mapInArrow(partial(packed_batches, keys=tuple(keys)), names).withColumn("_answer", F.lit(True))
    carried = (*keys, "gt_activity", "predicted_activity", "skip_reason")
    asked = coded.select(*carried, "nodes", F.lit(None).cast("binary").alias("_codes"), F.lit(False).alias("_answer"))
    met = asked.unionByName(packed, allowMissingColumns=True).repartition(*keys).sortWithinPartitions(*keys, "_answer")
    out = T.StructType([*[asked.schema[c] for c in carried], *COUNT_FIELDS])
    work = partial(counted_batches, keys=tuple(keys), carried=carried, relaxed=relaxed, tolerance=tolerance)
    return met.mapInArrow(work, out)


# ---- scores ------------------------------------------------------------------------------------------------


def score(judged: DataFrame) -> DataFrame:
    """Per-sample matches and scores. Skipped samples keep their row, with everything undefined.

    Matches and counts are functions of their own, so that a query runs only the ones it reads. They take the fields of
    the pairs one by one: an expression that is named once would be moved into their arguments, where it cannot run.
    """
    pairs = [f"pairs.{f.name}" for f in PAIRS_TYPE.elementType]
    nodes, cited = ["gt.obs.id", "gt.obs.sensor", "pred.obs.id"], ["gt.inf.based_on", "pred.inf.based_on"]
    matched = judged.withColumns(
        {
            "obs_matches": observation_matches(*nodes, "pred.obs.sensor", *pairs),
            "inf_matches": inference_matches(*nodes, "gt.inf.id", cited[0], "pred.inf.id", cited[1], *pairs),
            "_counts": match_counts(*nodes, *cited, *pairs),
        }
    )
    scored = F.col("skip_reason").isNull()
    n = {
        "n_gt_obs": F.size("gt.obs.id"), "n_pred_obs": F.size("pred.obs.id"),
        "n_gt_inf": F.size("gt.inf.id"), "n_pred_inf": F.size("pred.inf.id"),
        "obs_hits": F.col("_counts.obs_hits"), "inf_hits": F.col("_counts.inf_hits"),
    }
    matched = matched.withColumns({name: F.when(scored, c) for name, c in n.items()})
    return with_scores(matched, lambda name: F.col(f"_counts.{name}")).drop("_counts", "pairs")


def with_scores(matched: DataFrame, count: Callable[[str], Column] = F.col) -> DataFrame:
    """Scores of samples from their numbers of nodes and hits and from what ``match_counts`` gives."""
    scored = F.col("skip_reason").isNull()
    col = F.col
    both = lambda a, b, c: F.when((col(a) > 0) & (col(b) > 0), c)
    obs = lambda c: both("n_gt_obs", "n_pred_obs", c)
    inf = lambda c: both("n_gt_inf", "n_pred_inf", c)
    matched = matched.withColumns(
        {
            "obs_misses": col("n_gt_obs") - col("obs_hits"),
            "obs_hallucinations": col("n_pred_obs") - col("obs_hits"),
            "inf_misses": col("n_gt_inf") - col("inf_hits"),
            "inf_hallucinations": col("n_pred_inf") - col("inf_hits"),
            "snm_op": obs(share(col("obs_hits"), col("n_pred_obs"))),
            "snm_or": obs(share(col("obs_hits"), col("n_gt_obs"))),
            "snm_o_temporal": obs(share(count("temporal_hits"), col("obs_hits"))),
            "snm_o_cover": obs(share(count("covered"), count("channels"))),
            "snm_ip": inf(share(col("inf_hits"), col("n_pred_inf"))),
            "snm_ir": inf(share(col("inf_hits"), col("n_gt_inf"))),
            "snm_iprov_abs": inf(count("iprov_abs")),
            "snm_iprov_clean": inf(count("iprov_clean")),
            "snm_iprov_penalised": inf(count("iprov_penalised")),
            "synthesis_judge": F.when(scored, count("synthesis_judge")),
        }
    )
    return matched.withColumns(
        {
            "snm_of1": harmonic_mean(col("snm_op"), col("snm_or")),
            "snm_if1": harmonic_mean(col("snm_ip"), col("snm_ir")),
            "snm_sa": F.when(col("synthesis_judge") == "YES", 1.0).when(
                col("synthesis_judge") == "NO", 0.0
            ),
            "snm_skipped": ~scored,
        }
    )


SAMPLE_COLUMNS = (
    "snm_skipped", "skip_reason", "n_gt_obs", "n_pred_obs", "n_gt_inf", "n_pred_inf",
    "obs_hits", "obs_misses", "obs_hallucinations", "inf_hits", "inf_misses", "inf_hallucinations",
    "synthesis_judge", *SCORES,
)


def sample_table(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scored.select(*keys, "gt_activity", "predicted_activity", *SAMPLE_COLUMNS)


def match_table(scored: DataFrame, keys: Sequence[str], kind: str = OBS) -> DataFrame:
    column = "obs_matches" if kind == OBS else "inf_matches"
    return scored.select(*keys, F.explode(F.when(~F.col("snm_skipped"), F.col(column))).alias("m")).select(
        *keys, "m.*"
    )


def summary(scored: DataFrame, by: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """Means over samples for all samples and, scored ones only, split by correctness of the class. All three strata have
    a row; one without samples has counts of 0 and NULL means. ``sums`` are columns that are added up beside."""
    correct = F.col("gt_activity").eqNullSafe(F.col("predicted_activity"))
    stratum = F.when(~F.col("snm_skipped"), F.when(correct, "correct").otherwise("incorrect"))
    count_if = lambda c: F.count(F.when(c, 1))
    slim = scored.select(*by, "snm_skipped", "skip_reason", stratum.alias("_stratum"), *SCORES, *sums)
    grouped = slim.groupingSets([[*by], [*by, "_stratum"]], *by, "_stratum").agg(
        F.grouping("_stratum").alias("_whole"),
        F.count("*").alias("n_total"),
        count_if(~F.col("snm_skipped")).alias("n_scored"),
        count_if(F.col("snm_skipped")).alias("n_skipped"),
        count_if(F.col("skip_reason") == "gt_parse_fail").alias("n_gt_parse_fail"),
        count_if(F.col("skip_reason") == "pred_parse_fail").alias("n_pred_parse_fail"),
        *[F.sum(c).alias(c) for c in sums],
        *[F.avg(c).alias(c) for c in SCORES],
    )
    named = F.when(F.col("_whole") == 1, "all").otherwise(F.col("_stratum"))
    found = grouped.withColumn("stratum", named).where("stratum is not null")  # skipped samples are in no stratum of their own
    counts = ["n_total", "n_scored", "n_skipped", "n_gt_parse_fail", "n_pred_parse_fail", *sums]
    # At most three rows a group.
    few = found.groupBy(*by).agg(F.collect_list(F.struct("stratum", *counts, *SCORES)).alias("rows"))
    named = few.select(*by, "rows", F.explode(strings(["all", "correct", "incorrect"])).alias("stratum"))
    row = F.get(F.filter("rows", lambda r: r["stratum"] == F.col("stratum")), F.lit(0))
    return named.select(*by, "stratum", row.alias("row")).select(
        *by, "stratum", *[F.coalesce(F.col(f"row.{c}"), F.lit(0)).alias(c) for c in counts], *[f"row.{c}" for c in SCORES],
    )


def finite(c: Column) -> Column:
    """NULL for what JSON has no number for."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def result_document(
    strata: DataFrame, unresolved: DataFrame, calls: DataFrame | str, config: Mapping[str, str], top: int = 30
) -> DataFrame:
    """One row, ``document``: configuration, number of judge calls (rows of ``calls``, or that column of the stratum of all
    samples), the strata of ``summary`` by name, and
    the ``top`` sensor names that stayed unresolved. Undefined, infinite and NaN values are null. What is gathered here are
    three strata and ``top`` names, whatever the number of samples."""
    fields = [c for c in strata.columns if c not in ("stratum", calls if isinstance(calls, str) else None)]
    kinds = dict(strata.dtypes)
    row = F.struct(*[(finite(F.col(c)) if kinds[c] == "double" else F.col(c)).alias(c) for c in fields])
    summed = [F.max(F.when(F.col("stratum") == "all", F.col(calls))).alias("n_judge_calls")] if isinstance(calls, str) else []
    named = strata.agg(F.map_from_entries(F.collect_list(F.struct("stratum", row.alias("row")))).alias("strata"), *summed)
    frequent = unresolved.orderBy(F.desc("n"), "raw").limit(top).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "raw"))).alias("names")
    )
    asked = named if summed else calls.agg(F.count("*").alias("n_judge_calls")).join(named)
    whole = asked.join(frequent)  # one row each
    document = F.struct(
        F.create_map(*[F.lit(x) for pair in config.items() for x in pair]).alias("config") if config else F.lit(None).cast("map<string,string>").alias("config"),
        F.col("n_judge_calls"), F.col("strata"),
        F.transform("names", lambda x: F.struct(x["raw"].alias("raw"), (-x["less"]).alias("n"))).alias("unresolved_sensors"),
    )
    return whole.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))
