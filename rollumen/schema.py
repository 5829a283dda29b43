"""Schemas of the canonical tables. Readers declare them; nothing in production is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

MESSAGE = "struct<role: string, content: string>"

TRAINING_ROW = (
    f"data_source string, prompt array<{MESSAGE}>, images array<struct<path: string, bytes: binary>>, "
    "bbox_images array<struct<path: string>>, ability string, reward_model struct<style: string, ground_truth: string>, "
    "extra_info struct<answer: string, question: string, index: bigint, source_extra_info: map<string, string>>"
)
BENCHMARK_RECORD = (
    "images array<string>, crop_images array<string>, query string, response string, index bigint, id string, "
    "question_id string, category string, l2_category string, type string, task string, source string, image_source string"
)
ANSWER_LOG = (
    BENCHMARK_RECORD + ", sample_uid string, model_answer string, extracted_answer string, judge string, "
    "judge_source string, seq bigint"
)
SFT_ROW = "prompt string, response string"
PREFERENCE_ROW = "prompt string, chosen string, rejected string"
CHAT_ROW = f"messages array<{MESSAGE}>, tools array<string>, enable_thinking boolean"
TOKEN_ROW = (
    "row_id bigint, uid bigint, t int, mask int, logp_old double, logp_new double, logp_ref double, logp_rollout double, "
    "reward double, value double, sum_pi_sq double, is_weight double"
)
STREAM_SAMPLE = (
    "ts timestamp, sample_id string, epoch int, uid string, param_version bigint, param_version_start array<bigint>, "
    "param_version_end array<bigint>, processing_times array<double>, tool_calls array<double>, "
    "rollout_status map<string, double>"
)
METRIC_ROW = "step bigint, name string, value double, agg string"
CODE_RESULT = "test_idx int, input string, expected string, actual string, passed boolean, debug string, time double"
OFFLINE_ROW = "data_source string, responses array<string>, reward_model struct<ground_truth: string>"


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
