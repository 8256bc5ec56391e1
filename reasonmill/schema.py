"""Explicit schemas of all documents as DDL text; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


REGION = (
    "struct<sensor:string,start_t:int,end_t:int,length:int,mean_importance:double,"
    "max_importance:double,peak_timestep:int>"
)
PHASE = "struct<phase:string,importance:double>"

ATTRIBUTION_DOC = (
    "sample_idx string, activity string, confidence double, attribution_threshold_p90 double,"
    f"high_attribution_regions array<{REGION}>, temporal_phase_importance array<{PHASE}>,"
    "mantis_embedding string"
)

OBSERVATION = "struct<id:string,sensor:string,temporal:string,pattern:string,confidence:string>"
INFERENCE = "struct<id:string,based_on:array<string>,inference:string,confidence:string>"
SYNTHESIS = "struct<based_on:array<string>,text:string>"
GRAPH = (
    f"struct<observations:array<{OBSERVATION}>,inferences:array<{INFERENCE}>,synthesis:{SYNTHESIS},"
    "activity:string,n_observations:int,n_inferences:int,parse_failed:boolean>"
)

REASONING_RECORD = (
    "sample_id string, split string, predicted_activity string, confidence double, overall_reasoning string,"
    f"reasoning_graph {GRAPH}, generation_timestamp timestamp, model_used string, mantis_embedding string"
)

TRAINING_EXAMPLE = (
    "input string, output string, metadata struct<sample_id:string,split:string,predicted_activity:string,"
    f"confidence:double,overall_reasoning:string,reasoning_graph:{GRAPH},generation_timestamp:string,"
    "model_used:string>"
)

REFERENCE_DOC = (
    "sample_idx string, sample_id string, predicted_activity string, overall_reasoning string"
)

EVAL_ROW = (
    "struct<sample_id:string,gt_activity:string,predicted_activity:string,ground_truth_reasoning:string,"
    "generated:string,prefix_active:boolean>"
)
EVAL_ROWS = EVAL_ROW[len("struct<"):-1].replace(":", " ").replace(",", ", ")
EVAL_FILE = (
    f"run int, n_runs int, config map<string,string>, metrics string, per_sample array<{EVAL_ROW}>"
)

VERDICTS = "sample_key string, kind string, i int, j int, response string"

RUN_LOG = (
    "dataset string, seq bigint, batch bigint, tokens double, chars double, leak double, refusal double,"
    "parse_fail double, n_obs double, n_inf double"
)
