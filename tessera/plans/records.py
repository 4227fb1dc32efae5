"""Rows of the stored tables, made of what readers and metrics give."""

from __future__ import annotations

import hashlib
import inspect
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.identity import canonical_json, sha256_hex
from tessera.functions.text import PROMPT_SUFFIXES, render_question
from tessera.schema import ATTENTION_METRICS, HIDDEN_METRICS, KEYS, PROBABILITY_METRICS, SCENARIOS, TABLES, TOKEN_KEY


def prompt_hash(rendered: Column, token_ids: Column) -> Column:
    """Identity of a rendered prompt: SHA-256 of its text and tokens."""
    return sha256_hex(canonical_json(rendered_prompt=rendered, prompt_token_ids=token_ids))


def template_hash(template: str) -> str:
    """Identity of a prompt template: SHA-256 of its name, its end and the code that applies it."""
    if template not in PROMPT_SUFFIXES:
        raise KeyError(f"unknown prompt template {template!r}")
    payload = {"name": template, "renderer": inspect.getsource(render_question), "suffix": PROMPT_SUFFIXES[template]}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def example_rows(examples: DataFrame, run_id: str, dataset: str, split: str, token_ids: Column | None = None) -> DataFrame:
    """Rows of ``examples`` from a reader's. ``token_ids`` are the rendered prompt's tokens (the column prompt_token_ids unless given); they are counted.

    The truth is stored as JSON with sorted keys; an image by its source, hash, width, height and mode.
    """
    ids = (F.col("prompt_token_ids") if token_ids is None else token_ids).cast("array<int>")
    truth = canonical_json(answer=F.col("ground_truth"), question_for_eval=F.col("eval_question"))
    pictures = F.transform(
        "images",
        lambda i: F.struct(
            i["path"].alias("source_ref"), i["sha256"].alias("sha256"), i["width"].alias("width"), i["height"].alias("height"),
            F.lit("RGB").alias("mode"),
        ),
    )
    return examples.select(
        F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "sample_id", "source_row_index", "question", "rendered_prompt", ids.alias("prompt_token_ids"),
        F.size(ids).alias("prompt_token_count"), truth.alias("ground_truth_json"), "answer_type", pictures.alias("images"), "metadata_json",
    )


def generation_rows(generations: DataFrame) -> DataFrame:
    """Rows of ``generations``: retained tokens are counted, and the maximum is hit where no stop token ended the text."""
    counted = generations.withColumn("num_retained_tokens", F.size("generated_token_ids")).withColumn(
        "hit_max_new_tokens", F.col("stop_reason") == "max_new_tokens",
    )
    return counted.select(*TABLES["generations"].names)


def token_rows(generations: DataFrame, pieces: Column, texts: Column) -> DataFrame:
    """Rows of ``tokens``: one for each retained token, from arrays of ids, pieces and texts of the same length."""
    zipped = F.arrays_zip(F.col("generated_token_ids").alias("token_id"), pieces.alias("token_piece"), texts.alias("token_text"))
    rows = generations.select(
        *KEYS["generations"], "shard_id", "prompt_token_count", F.posexplode(zipped).alias("_at", "t"),
    ).withColumn("step", F.col("_at") + 1)
    context = F.col("prompt_token_count") + F.col("step") - 1
    return rows.select(
        *TOKEN_KEY, "shard_id", "t.token_id", "t.token_piece", "t.token_text", (context - 1).alias("predictor_position"),
        context.alias("context_length"),
    )


def _cast(df: DataFrame, table: str, named: dict[str, Column] | None = None) -> DataFrame:
    named = named or {}
    return df.select(*[(named[f.name] if f.name in named else F.col(f.name)).cast(f.dataType).alias(f.name) for f in TABLES[table]])


def probability_rows(metrics: DataFrame) -> DataFrame:
    """Rows of ``token_probability_metrics`` from keys, shard and metrics; metrics that aren't finite are null."""
    finite = {m: F.when(~F.isnan(F.col(m).cast("double")) & (F.abs(F.col(m).cast("double")) < float("inf")), F.col(m)) for m in PROBABILITY_METRICS}
    return _cast(metrics, "token_probability_metrics", finite)


def attention_rows(scenarios: DataFrame) -> DataFrame:
    """Rows of ``token_attention_metrics`` from keys, shard and :func:`tessera.operators.attention.scenarios`, whose columns are ``<scenario>__<metric>`` and the numbers of tokens."""
    finite = {f"{s}__{m}": F.when(
        ~F.isnan(F.col(f"{s}__{m}")) & (F.abs(F.col(f"{s}__{m}")) < float("inf")), F.col(f"{s}__{m}"),
    ) for s in SCENARIOS for m in ATTENTION_METRICS}
    return _cast(scenarios, "token_attention_metrics", finite)


def hidden_rows(means: DataFrame) -> DataFrame:
    """Rows of ``token_hidden_state_metrics`` from keys, shard and :func:`tessera.operators.hidden.layer_means`."""
    return _cast(means, "token_hidden_state_metrics", {m: F.col(m) for m in HIDDEN_METRICS})
