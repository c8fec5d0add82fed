"""Explicit table schemas. Nothing in the package relies on schema inference."""

from __future__ import annotations

from pyspark.sql import types as T

TRACE = ["pid", "rollout_idx"]
POSITION = ["pid", "rollout_idx", "t"]

PROBLEM_FILE = T.StructType(
    [
        T.StructField("problem_id", T.StringType()),
        T.StructField("pid", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)

ROLLOUT_FILE = T.StructType(
    [
        T.StructField("problem_id", T.StringType()),
        T.StructField("pid", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("rollout_idx", T.LongType()),
        T.StructField("rollout_id", T.LongType()),
        T.StructField("sample_id", T.LongType()),
        T.StructField("generated_text", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("is_correct", T.BooleanType()),
        T.StructField("output_ids", T.ArrayType(T.IntegerType())),
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
    ]
)

TOPK = T.StructType(
    [
        T.StructField("pid", T.StringType()),
        T.StructField("rollout_idx", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("token_id", T.LongType()),
        T.StructField("logprob", T.DoubleType()),
        T.StructField("rank", T.LongType()),
    ]
)

# The ten per-token arrays of a cached rollout.
CACHE_ARRAYS = [
    "Delta_path",
    "G_cov",
    "V",
    "J_approx",
    "pA_on_set",
    "logit_var",
    "entropy",
    "kl_div",
    "logit_skew",
    "logit_kurt",
]

FEATURE_CACHE = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("model_tag", T.StringType()),
        T.StructField("pid", T.StringType()),
        T.StructField("rollout_idx", T.LongType()),
        T.StructField("shard", T.LongType()),
    ]
    + [T.StructField(name, T.ArrayType(T.FloatType())) for name in CACHE_ARRAYS]
)

# Where each row of a cell is stored.
INDEX = T.StructType(
    [
        T.StructField("pid", T.StringType()),
        T.StructField("rollout_idx", T.LongType()),
        T.StructField("shard", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("row", T.LongType()),
    ]
)

# Blocks of raw top-K lists of one model.
CAPTURE = T.StructType(
    [
        T.StructField("pid", T.StringType()),
        T.StructField("rollout_idx", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("positions", T.ArrayType(T.LongType())),
        T.StructField("topk_logprobs", T.ArrayType(T.FloatType())),
        T.StructField("topk_token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("T_extracted", T.DoubleType()),
        T.StructField("task", T.StringType()),
        T.StructField("model_tag", T.StringType()),
    ]
)

LOGIT_WINDOW = T.StructType(
    [
        T.StructField("detector_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("w_idx", T.IntegerType()),
        T.StructField("logits", T.ArrayType(T.FloatType())),
        T.StructField("spec_logits", T.ArrayType(T.FloatType())),
        T.StructField("prefix_ids", T.ArrayType(T.IntegerType())),
    ]
)

INTERVENTIONS = ["sparse_steer", "sparse_steer_random", "local_temp", "dense_steer"]

PROFILE = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("cell", "model", "task", "problem_id")]
    + [T.StructField("n_failed_rollouts", T.IntegerType())]
    + [
        T.StructField(c, T.DoubleType())
        for c in ["spread", "concentration", "logit_dispersion", "retry", *INTERVENTIONS]
    ]
)
