"""Relational constraints as a list of rules; each rule is a query of the rows that break it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.schema import KEYS, ROLLOUT_KEY, SCORE_KEY, TOKEN_KEY, TOKEN_TABLES

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    name: str
    violations: Callable[[Tables], DataFrame]


def check(tables: Tables, rules: list[Rule]) -> DataFrame:
    """``rule``, ``n_violations`` of all rules, in one query."""
    counts = [r.violations(tables).agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(r.name).alias("rule"), "n_violations") for r in rules]
    return reduce(DataFrame.unionByName, counts)


def duplicates(df: DataFrame, key) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key) -> DataFrame:
    return child.join(parent.select(*key).distinct(), list(key), "left_anti")


def misaligned(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """Keys that are in one of two tables only, or not as often in both."""
    count = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(n))
    return count(left, "n_left").join(count(right, "n_right"), list(key), "full").where("not (n_left <=> n_right)")


def set_difference(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows declared but absent, and rows present but not declared, with their side."""
    actual = actual.select(*declared.columns)
    return declared.exceptAll(actual).withColumn("side", F.lit("missing")).unionByName(actual.exceptAll(declared).withColumn("side", F.lit("undeclared")))


def positional_differences(source: DataFrame, stored: DataFrame, ordinal: str, columns: list[str]) -> DataFrame:
    """Ordinals at which two ordered tables differ or one has no row."""
    a = source.select(F.col(ordinal), F.struct(*columns).alias("_a"))
    b = stored.select(F.col(ordinal), F.struct(*columns).alias("_b"))
    return a.join(b, ordinal, "full").where("not (_a <=> _b)").select(
        ordinal, F.col("_a").isNull().alias("only_stored"), F.col("_b").isNull().alias("only_source"),
    )


def contiguity(tokens: DataFrame, key, step: str) -> DataFrame:
    """Keys whose steps aren't 1 to n, each once: three sums decide, no rows are gathered."""
    sums = tokens.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min(step).alias("first"), F.max(step).alias("last"), F.countDistinct(step).alias("distinct"),
    )
    return sums.where("first <> 1 or last <> n or distinct <> n")


def id_mismatches(t: Tables) -> DataFrame:
    """Rollouts whose list of token ids isn't that of their token rows, as the rows' number and each place tell."""
    listed = t["generations"].select(*ROLLOUT_KEY, F.posexplode("generated_token_ids").alias("_at", "listed")).withColumn("step", F.col("_at") + 1)
    rows = t["tokens"].select(*TOKEN_KEY, F.col("token_id").alias("stored"))
    return listed.join(rows, list(TOKEN_KEY), "full").where("not (listed <=> stored)")


def stop_mismatches(t: Tables) -> DataFrame:
    stopped = (F.col("stop_reason") == "stop_token") & F.col("terminating_token_id").isNotNull() & ~F.col("hit_max_new_tokens")
    full = (F.col("stop_reason") == "max_new_tokens") & F.col("terminating_token_id").isNull() & F.col("hit_max_new_tokens")
    return t["generations"].where(~F.coalesce(stopped | full, F.lit(False)))


def alignment_mismatches(t: Tables) -> DataFrame:
    rows = t["tokens"].join(t["generations"].select(*ROLLOUT_KEY, "prompt_token_count"), list(ROLLOUT_KEY))
    return rows.where("context_length <> prompt_token_count + step - 1 or predictor_position <> context_length - 1")


def attention_mismatches(t: Tables) -> DataFrame:
    """Attention rows whose numbers of tokens are negative, don't add up, or count other than the tokens before the step as generated."""
    return t["token_attention_metrics"].where(
        "n_generated_text_tokens <> step - 1 or n_image_tokens < 0 or n_prompt_text_tokens < 0 or n_prompt_generated_text_tokens <> n_prompt_text_tokens + n_generated_text_tokens "
        "or n_all_attn_tokens <> n_image_tokens + n_prompt_generated_text_tokens"
    )


def validity_mismatches(t: Tables) -> DataFrame:
    return t["token_probability_metrics"].where("metrics_valid <=> (invalid_reason is not null)")


def out_of_range(t: Tables) -> DataFrame:
    return t["generations"].where("rollout_seed < 0 or rollout_seed > 18446744073709551615 or prompt_token_count <= 0 or rollout_index < 0 or num_retained_tokens <> size(generated_token_ids)")


def storage_rules() -> list[Rule]:
    """Constraints of a run's stored tables."""
    rules = [Rule(f"unique_{name}", lambda t, n=name: duplicates(t[n], KEYS[n])) for name in ("generations", *TOKEN_TABLES, "scores")]
    rules += [Rule(f"aligned_{name}", lambda t, n=name: misaligned(t["tokens"], t[n], TOKEN_KEY)) for name in TOKEN_TABLES[1:]]
    return rules + [
        Rule(
            "tokens_have_generation", lambda t: orphans(t["tokens"], t["generations"], ROLLOUT_KEY),
        ), Rule("scores_have_generation", lambda t: orphans(t["scores"], t["generations"], ROLLOUT_KEY)),
        Rule(
            "generations_have_example", lambda t: orphans(t["generations"], t["examples"], KEYS["examples"]),
        ), Rule("contiguous_steps", lambda t: contiguity(t["tokens"], ROLLOUT_KEY, "step")),
        Rule("token_ids_match", id_mismatches), Rule("stop_reason", stop_mismatches), Rule("context_alignment", alignment_mismatches), Rule("attention_counts", attention_mismatches), Rule("validity_reason", validity_mismatches), Rule("generation_ranges", out_of_range),
        Rule("one_shard_per_rollout", lambda t: t["generations"].groupBy(*ROLLOUT_KEY).agg(F.countDistinct("shard_id").alias("n")).where("n > 1")),
        Rule("one_shard_per_score", lambda t: t["scores"].groupBy(*SCORE_KEY).agg(F.countDistinct("score_shard_id").alias("n")).where("n > 1")),
    ]


def group_status(df: DataFrame, key, status: str = "status") -> DataFrame:
    """Status of a group from its runs': all complete, any failed, any begun, else planned."""
    is_ = lambda s: F.col(status) == s
    fold = F.when(F.bool_and(is_("complete")), "complete").when(F.bool_or(is_("failed")), "failed").when(~F.bool_and(is_("planned")), "running").otherwise("planned")
    return df.groupBy(*key).agg(fold.alias("status"))


#: Which status may follow which.
TRANSITIONS = {("planned", "running"), ("running", "complete"), ("running", "failed"), ("failed", "running")}


def check_transition(now: str, then: str) -> None:
    if (now, then) not in TRANSITIONS:
        raise ValueError(f"{now} is not followed by {then}")


def may_follow(now: Column, then: Column) -> Column:
    """Whether a status may follow another."""
    return F.coalesce(F.array_contains(F.array(*[F.lit("\n".join(t)) for t in sorted(TRANSITIONS)]), F.concat(now, F.lit("\n"), then)), F.lit(False))


def completed_prompts(df: DataFrame, sample: str, index: str, n: int) -> DataFrame:
    """Samples with at least ``n`` different rollouts."""
    return df.groupBy(sample).agg(F.countDistinct(index).alias("n_rollouts")).where(F.col("n_rollouts") >= n)


def inventory(tokens: DataFrame, shard: str = "shard_id") -> DataFrame:
    """Per shard: tokens, least and greatest step."""
    return tokens.groupBy(shard).agg(F.count(F.lit(1)).alias("token_count"), F.min("step").alias("min_step"), F.max("step").alias("max_step"))
