"""Prompt batches: bounded windows of pending work, sorted by length inside, cut into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import cut


def with_ordinal(df: DataFrame, order: list, name: str = "ordinal", start: int = 0) -> DataFrame:
    """``df`` with the global position of each row in ``order``, without sorting all rows in one task.

    Rows are range-partitioned and sorted; each partition's size then shifts the next ones. Only the
    sizes, one row a partition, meet in one place. ``order`` should leave no ties.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    local = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut(rows.withColumn("_part", F.shiftright(local, 33)).withColumn("_nth", local.bitwiseAND((1 << 33) - 1)))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    return rows.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_shift") + F.col("_nth") + start).drop("_part", "_nth", "_shift")


def schedule(
    work: DataFrame, batch_size: int, strategy: str, window_size: int | None = None, ordinal: str = "ordinal", tokens: str = "tokens",
    images: str = "images",
) -> DataFrame:
    """``work`` with ``window``, ``batch`` (global number) and ``slot``.

    ``ordinal`` counts pending rows from 0. Contiguous windows are batches as they are; bucketed ones are
    sorted by (tokens, images, ordinal) before they are cut. Windows are independent, so they are
    sorted in parallel.
    """
    if batch_size <= 0:
        raise ValueError("batch size must be positive")
    if strategy not in ("contiguous", "token_count_bucketed"):
        raise ValueError(f"unknown strategy {strategy!r}")
    bucketed = strategy == "token_count_bucketed"
    if bucketed and (window_size is None or window_size < batch_size):
        raise ValueError("the window must hold at least one batch")
    size = window_size if bucketed and batch_size > 1 else batch_size
    rows = work.withColumn("window", F.floor(F.col(ordinal) / size))
    inside = Window.partitionBy("window").orderBy(*([tokens, images, ordinal] if bucketed and batch_size > 1 else [ordinal]))
    nth = F.row_number().over(inside) - 1
    per_window = -(-size // batch_size)
    return rows.withColumn("_nth", nth).withColumn(
        "batch", F.col("window") * per_window + F.floor(F.col("_nth") / batch_size),
    ).withColumn("slot", (F.col("_nth") % batch_size).cast("int")).drop("_nth")


def padding(n: Column, longest: Column, total: Column) -> Column:
    return F.when(n * longest > 0, (n * longest - total) / (n * longest)).otherwise(0.0)


def telemetry(scheduled: DataFrame, tokens: str = "tokens", images: str = "images") -> DataFrame:
    """Per batch: prompts, lengths, padded tokens, the padded fraction (0 where nothing is padded), image tokens."""
    n, longest, total = F.count(F.lit(1)), F.max(tokens), F.sum(tokens)
    return scheduled.groupBy("batch").agg(
        n.alias("prompt_count"), F.min(tokens).alias("min_prompt_length"), longest.alias("max_prompt_length"), total.alias("total_unpadded_prompt_tokens"),
        (n * longest).alias("total_padded_prompt_tokens"), padding(n, longest, total).alias("padding_fraction"), F.min(images).alias("min_image_token_count"), F.max(images).alias("max_image_token_count"),
    )


def totals(batches: DataFrame) -> DataFrame:
    """Sums of a run's telemetry; without padded tokens the fraction is null."""
    padded, plain = F.sum("total_padded_prompt_tokens"), F.sum("total_unpadded_prompt_tokens")
    return batches.agg(
        F.count(F.lit(1)).alias("batches"), F.sum("prompt_count").alias("prompts"), plain.alias("unpadded_tokens"), padded.alias("padded_tokens"),
        F.try_divide(padded - plain, padded).alias("padding_fraction"),
    )


def throughput(tokens: Column, seconds: Column) -> Column:
    """Tokens a second; null unless time has passed."""
    return F.when(seconds > 0, tokens / seconds)


def remaining_seconds(total: Column, done: Column, done_at_start: Column, elapsed: Column) -> Column:
    """What is left times the time that each has taken since the start; null while none is done."""
    return F.when(done > done_at_start, (total - done) * elapsed / (done - done_at_start))
