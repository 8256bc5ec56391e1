"""Graph metrics of generated traces: parse success, grounding, chain validity, coverage, node rates.

Everything about one trace is computed inside its row with array expressions, so the only shuffles are the
final aggregates (partial sums first) and, for grounding, one join with the attribution documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reasonmill.functions.expr import harmonic_mean, let, share
from reasonmill.functions.parse import trace_graph
from reasonmill.functions.text import is_blank, normalise_label, strip
from reasonmill.functions.vocab import CONFIDENCES, vocabulary_sensor
from reasonmill.registry import SENSOR_ALIASES

AXES = ("x", "y", "z")


def parse_eval_rows(rows: DataFrame) -> DataFrame:
    """Adds the graphs ``gen`` and ``ref`` and ``has_reference``; text and graph metrics use rows that have one."""
    return rows.withColumns(
        {
            "gen": trace_graph("generated"),
            "ref": trace_graph("ground_truth_reasoning"),
            "has_reference": ~is_blank("ground_truth_reasoning"),
        }
    )


def with_reference(graphs: DataFrame) -> DataFrame:
    return graphs.where("has_reference")


# ---- long tables -------------------------------------------------------------------------------------------


def observation_nodes(graphs: DataFrame, graph: str, keys: Sequence[str]) -> DataFrame:
    return graphs.select(
        *keys, F.posexplode(f"{graph}.observations").alias("pos", "node")
    ).select(*keys, "pos", "node.*")


def inference_nodes(graphs: DataFrame, graph: str, keys: Sequence[str]) -> DataFrame:
    return graphs.select(*keys, F.posexplode(f"{graph}.inferences").alias("pos", "node")).select(
        *keys, "pos", "node.*"
    )


def citation_edges(graphs: DataFrame, graph: str, keys: Sequence[str]) -> DataFrame:
    """One row per citation of an inference or of the synthesis, with the flag whether its target exists."""
    g = F.col(graph)
    obs_ids, inf_ids = g["observations"]["id"], g["inferences"]["id"]

    def edges(layer: str, owner: Column, cited: Column, targets: Column) -> Column:
        return F.transform(
            cited,
            lambda target, pos: F.struct(
                F.lit(layer).alias("layer"),
                owner.alias("node_id"),
                pos.alias("pos"),
                target.alias("cited_id"),
                F.array_contains(targets, target).alias("resolved"),
            ),
        )

    of_inferences = F.flatten(
        F.transform(g["inferences"], lambda n: edges("inference", n["id"], n["based_on"], obs_ids))
    )
    syn = g["synthesis"]["based_on"]
    of_synthesis = F.when(syn.isNotNull(), edges("synthesis", F.lit("S"), syn, inf_ids))
    none = F.slice(of_inferences, 1, 0)
    return graphs.select(
        *keys, F.explode(F.concat(of_inferences, F.coalesce(of_synthesis, none))).alias("e")
    ).select(*keys, "e.*")


# ---- expressions over one graph ----------------------------------------------------------------------------


def _sensor_of(observations: Column, node_id: Column) -> Column:
    """Sensor of a cited observation; of several nodes with the same id the last counts."""
    same = F.filter(observations, lambda o: o["id"] == node_id)
    return F.try_element_at(same, F.lit(-1))["sensor"]


def _names(text: Column, sensor: Column) -> Column:
    axis = F.element_at(F.split(sensor, "_", -1), -1)
    return (
        F.contains(text, sensor)
        | F.contains(text, F.replace(sensor, F.lit("_"), F.lit(" ")))
        | (axis.isin(*AXES) & F.contains(text, axis))
    )


def inference_checks(graph: Column) -> Column:
    """Per inference: ``structural`` (no dangling citation) and ``names_sensor`` (text names a cited sensor)."""
    obs = graph["observations"]
    return F.transform(
        graph["inferences"],
        lambda n: F.struct(
            F.forall(n["based_on"], lambda b: F.array_contains(obs["id"], b)).alias("structural"),
            F.exists(
                n["based_on"],
                lambda b: F.coalesce(
                    _names(F.lower(n["inference"]), _sensor_of(obs, b)), F.lit(False)
                ),
            ).alias("names_sensor"),
        ),
    )


def _count(items: Column, predicate) -> Column:
    return F.coalesce(F.size(F.filter(items, predicate)), F.lit(0))


# ---- parse success -----------------------------------------------------------------------------------------


def parse_success(graphs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rate = lambda g: F.avg((~F.col(f"{g}.parse_failed")).cast("double"))
    return graphs.groupBy(*by).agg(
        F.count("*").alias("n"), rate("gen").alias("psr"), rate("ref").alias("ref_psr")
    )


# ---- chain validity ----------------------------------------------------------------------------------------


def chain_validity_samples(graphs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shares per sample, NULL for samples that failed to parse or have no inference."""
    usable = ~F.col("gen.parse_failed") & (F.col("gen.n_inferences") > 0)
    checked = graphs.select(*keys, F.when(usable, inference_checks(F.col("gen"))).alias("checks"))
    n = F.size("checks")
    both = share(_count(F.col("checks"), lambda x: x["structural"] & x["names_sensor"]), n)
    return checked.select(
        *keys,
        F.when(F.col("checks").isNotNull(), share(_count(F.col("checks"), lambda x: x["structural"]), n)).alias(
            "rcv_structural"
        ),
        F.when(F.col("checks").isNotNull(), both).alias("rcv_semantic"),
        F.when(F.col("checks").isNotNull(), both).alias("rcv_combined"),
    )


def chain_validity(graphs: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    samples = chain_validity_samples(graphs, [*keys, *by])
    names = ("rcv_structural", "rcv_semantic", "rcv_combined")
    return samples.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names])


# ---- coverage ----------------------------------------------------------------------------------------------


def _coverage_parts(graphs: DataFrame, activity: str, by: Sequence[str] = ()) -> DataFrame:
    """Coverage per (class, number of observations): samples collapse into a histogram, and the class means are a
    window over that small table, so each sample is read once and no sample meets its class mean in a join."""
    histogram = graphs.groupBy(
        *by,
        F.col(activity).alias("activity"),
        F.when(~F.col("gen.parse_failed"), F.col("gen.n_observations")).alias("n_obs"),
    ).agg(
        F.count("*").alias("n"),
        F.sum(F.when(~F.col("ref.parse_failed"), F.col("ref.n_observations"))).alias("ref_obs"),
        F.count(F.when(~F.col("ref.parse_failed"), 1)).alias("ref_n"),
    )
    of_class = Window.partitionBy(*by, "activity")
    means = histogram.withColumn(
        "ref_obs_mean", share(F.sum("ref_obs").over(of_class), F.sum("ref_n").over(of_class))
    )
    return means.where("n_obs is not null and ref_obs_mean > 0").withColumn(
        "gc", F.least(share(F.col("n_obs"), F.col("ref_obs_mean")), F.lit(1.0))
    )


def coverage_by_class(
    graphs: DataFrame, activity: str = "gt_activity", by: Sequence[str] = ()
) -> DataFrame:
    parts = _coverage_parts(graphs, activity, by)
    return parts.groupBy(*by, "activity").agg(
        share(F.sum(F.col("gc") * F.col("n")), F.sum("n")).alias("gc_mean"),
        F.max("ref_obs_mean").alias("ref_obs_mean"),
        F.sum("n").alias("n_scored"),
    )


def coverage(graphs: DataFrame, activity: str = "gt_activity", by: Sequence[str] = ()) -> DataFrame:
    parts = _coverage_parts(graphs, activity, by)
    return parts.groupBy(*by).agg(
        share(F.sum(F.col("gc") * F.col("n")), F.sum("n")).alias("gc_mean")
    )


# ---- grounding ---------------------------------------------------------------------------------------------


def important_sensors(
    regions: Column, top_k: int, aliases: Mapping[str, str] = SENSOR_ALIASES
) -> Column:
    """Vocabulary names of the sensors of the top-k regions by mean importance; ties keep list order."""
    ranked = F.array_sort(
        F.transform(
            regions,
            lambda r, i: F.struct(
                (-F.coalesce(r["mean_importance"], F.lit(0.0))).alias("down"),
                i.alias("pos"),
                F.coalesce(r["sensor"], F.lit("")).alias("sensor"),
            ),
        )
    )
    names = F.transform(F.slice(ranked, 1, top_k), lambda r: vocabulary_sensor(r["sensor"], aliases))
    return F.array_distinct(F.filter(names, lambda s: s != ""))


def mentioned_sensors(graph: Column) -> Column:
    names = F.transform(graph["observations"], lambda o: strip(F.lower(o["sensor"])))
    return F.array_distinct(F.filter(names, lambda s: s != ""))


def grounding_samples(
    graphs: DataFrame,
    attributions: DataFrame,
    keys: Sequence[str],
    top_k: int = 3,
    aliases: Mapping[str, str] = SENSOR_ALIASES,
) -> DataFrame:
    """Overlap of attributed and mentioned sensors per sample.

    ``attributions`` holds one row per ``sample_id`` (see ``sources.attribution.latest_per_sample``). Both sides
    shrink to their sensor lists before the join, so no region and no text is shuffled.
    """
    docs = attributions.select(
        F.col("sample_id").alias("_doc_id"),
        F.lit(True).alias("has_doc"),
        important_sensors(F.col("high_attribution_regions"), top_k, aliases).alias("important"),
    )
    slim = graphs.select(
        *keys,
        F.col("sample_id").alias("_id"),
        F.col("gen.parse_failed").alias("parse_failed"),
        mentioned_sensors(F.col("gen")).alias("mentioned"),
    )
    joined = slim.join(docs, slim["_id"] == docs["_doc_id"], "left")
    overlap = F.size(F.array_intersect("important", "mentioned"))
    usable = ~F.col("parse_failed") & (F.size("important") > 0) & (F.size("mentioned") > 0)
    scored = joined.select(
        *keys,
        "parse_failed",
        F.when(usable, share(overlap, F.size("mentioned"))).alias("gs_precision"),
        F.when(usable, share(overlap, F.size("important"))).alias("gs_recall"),
    )
    return scored.withColumn("gs_f1", harmonic_mean(F.col("gs_precision"), F.col("gs_recall")))


def grounding(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    scored = F.col("gs_f1").isNotNull()
    return samples.groupBy(*by).agg(
        F.avg("gs_recall").alias("gs_recall"),
        F.avg("gs_precision").alias("gs_precision"),
        F.avg("gs_f1").alias("gs_f1"),
        F.count("gs_f1").alias("n_scored"),
        F.count(F.when(~scored & ~F.col("parse_failed"), 1)).alias("n_skipped"),
        F.count(F.when(F.col("parse_failed"), 1)).alias("n_parse_fail"),
    )


# ---- node rates --------------------------------------------------------------------------------------------


def node_counts(
    graphs: DataFrame,
    classes: Sequence[str] | Column,
    sensors: Sequence[str] | Column,
    by: Sequence[str] = (),
    confidences: Sequence[str] = CONFIDENCES,
) -> DataFrame:
    """Countable facts of every graph, as one narrow row of integers per trace. Classes and sensors are the same for all
    rows, or columns with a list per row."""
    g = F.col("gen")
    vocabulary = classes if isinstance(classes, Column) else [c.lower().strip() for c in classes]
    listed = lambda x, values: F.array_contains(values, x) if isinstance(values, Column) else x.isin(*values)

    def facts(checks: Column) -> Column:
        obs, syn = g["observations"], g["synthesis"]
        obs_ids = F.array_distinct(obs["id"])
        cited = F.flatten(g["inferences"]["based_on"])
        return F.struct(
            F.size(obs).alias("obs"),
            _count(obs, lambda o: listed(o["sensor"], sensors)).alias("obs_sensor"),
            _count(obs, lambda o: o["temporal"] != "").alias("obs_temporal"),
            _count(obs, lambda o: o["confidence"].isin(*confidences)).alias("obs_confidence"),
            F.size(checks).alias("inf"),
            _count(checks, lambda x: x["structural"]).alias("inf_structural"),
            _count(checks, lambda x: x["names_sensor"]).alias("inf_names_sensor"),
            F.when(F.size(checks) > 0, F.size(obs_ids)).otherwise(0).alias("obs_citable"),
            F.size(F.array_intersect(obs_ids, cited)).alias("obs_cited"),
            syn.isNotNull().cast("int").alias("syn"),
            F.coalesce(F.arrays_overlap(syn["based_on"], g["inferences"]["id"]), F.lit(False))
            .cast("int")
            .alias("syn_cites"),
        )

    return graphs.select(
        *by,
        (~g["parse_failed"]).cast("int").alias("parsed"),
        F.coalesce(listed(normalise_label(g["activity"]), vocabulary), F.lit(False))
        .cast("int")
        .alias("activity_listed"),
        F.when(~g["parse_failed"], let(inference_checks(g), facts)).alias("f"),
    ).select(*by, "parsed", "activity_listed", "f.*")


def node_rates(
    graphs: DataFrame,
    classes: Sequence[str] | Column,
    sensors: Sequence[str] | Column,
    by: Sequence[str] = (),
    confidences: Sequence[str] = CONFIDENCES,
) -> DataFrame:
    """Micro rates of the observation, inference and synthesis layers: sums over sums, not means of samples."""
    counts = node_counts(graphs, classes, sensors, by, confidences)
    total = lambda c: F.sum(c)
    with_inf = F.count(F.when(F.col("inf") > 0, 1))
    parsed = total("parsed")
    return counts.groupBy(*by).agg(
        share(parsed, F.count("*")).alias("obs_parse_rate"),
        share(total("obs_sensor"), total("obs")).alias("obs_sensor_valid_rate"),
        share(total("obs_temporal"), total("obs")).alias("obs_temporal_rate"),
        share(total("obs_confidence"), total("obs")).alias("obs_confidence_rate"),
        share(with_inf, parsed).alias("obs_coverage_rate"),
        share(with_inf, parsed).alias("inf_present_rate"),
        share(total("inf_structural"), total("inf")).alias("inf_structural_rate"),
        share(total("inf_names_sensor"), total("inf")).alias("inf_semantic_rate"),
        share(total("obs_cited"), total("obs_citable")).alias("inf_obs_coverage"),
        share(total("syn"), parsed).alias("syn_present_rate"),
        share(total("syn_cites"), total("syn")).alias("syn_ref_rate"),
        share(total("activity_listed"), F.count("*")).alias("syn_activity_valid_rate"),
        F.count("*").alias("n_total"),
        F.coalesce(parsed, F.lit(0)).alias("n_parsed"),
    )
