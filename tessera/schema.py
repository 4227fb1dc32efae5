"""Stored tables: keys, columns and Spark types."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType, TimestampType,
)

# Names and order of columns.
EXAMPLE_KEY = ("run_id", "dataset", "split", "sample_id")
ROLLOUT_KEY = (*EXAMPLE_KEY, "strategy", "rollout_index")
TOKEN_KEY = (*ROLLOUT_KEY, "step")
SCORE_KEY = (*ROLLOUT_KEY, "scorer_name", "scorer_version")
RESUME_KEY = ROLLOUT_KEY[1:]

PROBABILITY_FLOATS = (
    "logp", "kl_u_p", "kl_p_u", "gini", "entropy", "dist_perplexity", "inverse_perplexity", "max_prob", "margin_top2", "log_ratio_margin_top2", "selected_dominance", "selected_logrank",
    *(f"topk_mass_{k}" for k in (2, 5, 10, 20)), *(f"tail_mass_{k}" for k in (2, 5, 10, 20)), "norm_entropy_concentration",
    "renyi_entropy_0p5", "renyi_entropy_1", "renyi_entropy_2", "renyi_entropy_4", "renyi_entropy_inf", "js_p_u",
)
PROBABILITY_INTEGERS = ("selected_rank", "nucleus_size_0p9", "nucleus_size_0p95", "nucleus_size_0p99")
PROBABILITY_METRICS = PROBABILITY_FLOATS + PROBABILITY_INTEGERS

#: Layers of each scenario, both ends included; the second and third lie within the first.
SCENARIOS = {"all_layers_all_heads": (1, 36), "early_visual_integration": (1, 21), "visual_reasoning": (22, 34)}
ATTENTION_GROUPS = ("img_attn", "prompt_text_attn", "generated_text_attn", "prompt_generated_text_attn", "all_attn")
ATTENTION_SUFFIXES = ("total", "avg", "gini", "entropy", "kl_u_p", "kl_p_u", "dist_perplexity")
ATTENTION_RATIOS = tuple(f"attn_ratio_{x}" for x in (
    "img_to_prompt_text", "img_to_generated_text", "img_to_all", "prompt_text_to_all", "generated_text_to_all", "prompt_generated_text_to_all",
))
ATTENTION_METRICS = tuple(f"{g}_{s}" for g in ATTENTION_GROUPS for s in ATTENTION_SUFFIXES) + ATTENTION_RATIOS
HIDDEN_METRICS = tuple(f"cosine_gen_imgproto_hidden_{x}" for x in ("avg_all_layers", "last_layer", "early_visual_integration", "visual_reasoning"))

#: Unsigned 64-bit numbers, which Spark has no type for.
UINT64 = DecimalType(20, 0)
STRING, SHORT, INT, LONG, FLOAT, DOUBLE, BOOL, TIME = StringType(), ShortType(), IntegerType(), LongType(), FloatType(), DoubleType(), BooleanType(), TimestampType()
INTS = ArrayType(INT, False)


def field(name: str, kind: DataType) -> StructField:
    """A column without nulls."""
    return StructField(name, kind, False)


def nullable(name: str, kind: DataType) -> StructField:
    return StructField(name, kind, True)


IMAGES = ArrayType(
    StructType([nullable("source_ref", STRING), field("sha256", STRING), field("width", INT), field("height", INT), field("mode", STRING)]), False,
)

# The stored tables, column by column.
EXAMPLE_FIELDS = [field("run_id", STRING), field("dataset", STRING), field("split", STRING), field("sample_id", STRING)]
ROLLOUT_FIELDS = [*EXAMPLE_FIELDS, field("strategy", STRING), field("rollout_index", INT)]
TOKEN_FIELDS = [*ROLLOUT_FIELDS, field("step", INT)]
SCORE_FIELDS = [*ROLLOUT_FIELDS, field("scorer_name", STRING), field("scorer_version", STRING)]
ATTENTION_COUNTS = ("n_image_tokens", "n_prompt_text_tokens", "n_generated_text_tokens", "n_prompt_generated_text_tokens", "n_all_attn_tokens")

TABLES: dict[str, StructType] = {
    "examples": StructType([
        *EXAMPLE_FIELDS,
        nullable("source_row_index", LONG),
        field("question", STRING),
        field("rendered_prompt", STRING),
        field("prompt_token_ids", INTS),
        field("prompt_token_count", INT),
        field("ground_truth_json", STRING),
        nullable("answer_type", STRING),
        field("images", IMAGES),
        field("metadata_json", STRING),
    ]),
    "generations": StructType([
        *ROLLOUT_FIELDS,
        field("shard_id", STRING),
        field("rollout_seed", UINT64),
        field("temperature", FLOAT),
        field("top_p", FLOAT),
        nullable("top_k", INT),
        field("repetition_penalty", FLOAT),
        field("generated_token_ids", INTS),
        field("generated_text", STRING),
        field("num_retained_tokens", INT),
        field("stop_reason", STRING),
        nullable("terminating_token_id", INT),
        field("hit_max_new_tokens", BOOL),
        field("prompt_token_count", INT),
        nullable("wall_time_seconds", DOUBLE),
        nullable("tokens_per_second", DOUBLE),
        field("completed_at_utc", TIME),
    ]),
    "tokens": StructType([
        *TOKEN_FIELDS,
        field("shard_id", STRING),
        field("token_id", INT),
        field("token_piece", STRING),
        field("token_text", STRING),
        field("predictor_position", INT),
        field("context_length", INT),
    ]),
    "token_probability_metrics": StructType([
        *TOKEN_FIELDS,
        field("shard_id", STRING),
        field("metrics_valid", BOOL),
        nullable("invalid_reason", STRING),
        *[nullable(m, FLOAT) for m in PROBABILITY_FLOATS],
        *[nullable(m, INT) for m in PROBABILITY_INTEGERS],
    ]),
    "token_attention_metrics": StructType([
        *TOKEN_FIELDS,
        field("shard_id", STRING),
        *[field(n, INT) for n in ATTENTION_COUNTS],
        *[f for s in SCENARIOS for f in (field(f"{s}__valid", BOOL), *[nullable(f"{s}__{m}", FLOAT) for m in ATTENTION_METRICS])],
    ]),
    "token_hidden_state_metrics": StructType([
        *TOKEN_FIELDS,
        field("shard_id", STRING),
        field("valid_layers_all", SHORT),
        field("valid_layers_early_visual_integration", SHORT),
        field("valid_layers_visual_reasoning", SHORT),
        field("last_layer_valid", BOOL),
        *[nullable(m, FLOAT) for m in HIDDEN_METRICS],
    ]),
    "scores": StructType([
        *SCORE_FIELDS,
        field("score_shard_id", STRING),
        nullable("is_correct", BOOL),
        nullable("raw_final_answer", STRING),
        nullable("extracted_answer", STRING),
        field("scorer_method", STRING),
        field("score_details_json", STRING),
        field("scored_at_utc", TIME),
    ]),
}
CORE_TABLES = tuple(t for t in TABLES if t not in ("examples", "scores"))
TOKEN_TABLES = CORE_TABLES[1:]
KEYS = {"examples": EXAMPLE_KEY, "generations": ROLLOUT_KEY, "scores": SCORE_KEY, **{t: TOKEN_KEY for t in TOKEN_TABLES}}
