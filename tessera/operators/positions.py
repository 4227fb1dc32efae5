"""Which prompt positions are image, text or markup, and how steps align with positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(tokens: DataFrame, key: list[str], position: str, start: Column, end: Column, pad: Column, special: Column) -> DataFrame:
    """Classify each token of a prompt by one running sum: ``depth`` (spans open before it) and ``kind``.

    A pad inside a span is ``image``, a token that isn't special is ``text``, anything else ``markup``.
    ``error`` names what breaks the structure: ``nested_start``, ``end_without_start``, ``pad_outside``.
    """
    order = Window.partitionBy(*key).orderBy(position)
    change = F.when(start, 1).when(end, -1).otherwise(0)
    rows = tokens.withColumn("depth", F.coalesce(F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    kind = F.when(pad & (F.col("depth") == 1), "image").when(start | end | pad | special, "markup").otherwise("text")
    error = F.when(start & (F.col("depth") >= 1), "nested_start").when(end & (F.col("depth") <= 0), "end_without_start").when(pad & (F.col("depth") != 1), "pad_outside")
    return rows.withColumn("kind", kind).withColumn("error", error)


def groups(classified: DataFrame, key: list[str], position: str, start: Column, end: Column) -> DataFrame:
    """Per prompt: ``image`` and ``prompt`` positions in order, ``n_errors``, and whether a span was left open."""
    collected = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col(position).cast("int"))))
    return classified.groupBy(*key).agg(
        collected("image").alias("image"), collected("text").alias("prompt"), F.count("error").alias("n_errors"),
        (F.sum(F.when(start, 1).otherwise(0)) > F.sum(F.when(end, 1).otherwise(0))).alias("unterminated"),
    )


def context_length(prompt_count: Column, step: Column) -> Column:
    return prompt_count + step - 1


def predictor_position(prompt_count: Column, step: Column) -> Column:
    """The position that predicts a step's token; the prompt's last one at step 1."""
    return context_length(prompt_count, step) - 1


def generated_positions(prompt_count: Column, step: Column) -> Column:
    """Positions of the tokens generated before a step."""
    return F.when(step > 1, F.sequence(prompt_count, prompt_count + step - 2)).otherwise(F.array().cast("array<int>"))
