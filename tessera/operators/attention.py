"""Attention metrics of a token: how its attention falls on image, prompt and generated positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from tessera.schema import ATTENTION_COUNTS, ATTENTION_GROUPS, ATTENTION_METRICS, SCENARIOS
from tessera.session import in_arrow

#: Below this total a distribution or a ratio is undefined; values above its negative count as 0.
EPSILON = 1e-8
#: The least positive double: with it any total above 0 has a distribution.
POSITIVE = 5e-324
INF = float("inf")
LAYERS = 36


def is_valid(vector: Column) -> Column:
    return F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < INF) & (x >= -EPSILON), F.lit(False)))


def groups_are_valid(size: Column, *groups: Column) -> Column:
    """Positions are in range, none repeated, and no two groups share one."""
    all_ = F.concat(*groups)
    return (F.size(F.array_distinct(all_)) == F.size(all_)) & F.forall(all_, lambda i: F.coalesce((i >= 0) & (i < size), F.lit(False)))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def _shares(name: str) -> Column:
    return F.transform(f"_{name}", lambda x: x / F.col(f"_{name}_t"))


def _group_metrics(name: str, values: Column, total: Column, d: Column, valid: Column, least: float) -> dict[str, Column]:
    n = F.size(values).cast("double")
    has = valid & (F.size(values) > 0) & (total >= least)
    entropy = F.aggregate(d, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    spread = F.aggregate(d, F.lit(0.0), lambda s, x: s + F.when(x > 0, F.ln(x)).otherwise(F.lit(-INF)))
    defined = {
        "gini": F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x), "entropy": entropy, "kl_u_p": -F.ln(n) - spread / n, "kl_p_u": F.ln(n) + entropy,
        "dist_perplexity": -F.exp(-entropy),
    }
    made = {"total": F.when(valid, total), "avg": F.when(valid & (F.size(values) > 0), total / n)} | {k: F.when(has, v) for k, v in defined.items()}
    return {f"{name}_{k}": v for k, v in made.items()}


def metrics(
    df: DataFrame, vector: str = "attention", image: str = "image", prompt: str = "prompt", generated: str = "generated", prefix: str = "",
    keep: list[str] | None = None, least: float = EPSILON,
) -> DataFrame:
    """The 41 metrics and ``valid`` of each row, by array expressions alone; the vector is never made to sum to 1.

    The groups are arrays of 0-based positions; positions in no group are ignored. An empty group has
    total 0 and no other metric. A vector with a value that isn't finite or lies below -1e-8 makes all
    metrics null and ``valid`` false; a null vector does, too. A position out of range or in two places
    makes the row invalid as well. A group's distribution, and a ratio, needs a total of ``least``, which
    is above 0.
    """
    v = F.col(vector).cast("array<double>")
    groups = [F.col(c) for c in (image, prompt, generated)]
    ok = F.coalesce(is_valid(v) & groups_are_valid(F.size(v), *groups), F.lit(False))
    rows = df.withColumn("_ok", ok).withColumn("_v", F.when(F.col("_ok"), F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))))
    for name, c in zip("ipg", (image, prompt, generated)):
        rows = rows.withColumn(f"_{name}", F.when(F.col("_ok"), F.transform(c, lambda i: F.col("_v")[i])))
    parts = {
        "img_attn": F.col("_i"), "prompt_text_attn": F.col("_p"), "generated_text_attn": F.col("_g"),
        "prompt_generated_text_attn": F.concat("_p", "_g"), "all_attn": F.concat("_i", "_p", "_g"),
    }
    valid = F.col("_ok")
    made: dict[str, Column] = {}
    # each group's values, total and distribution are columns of their own, so they are worked out once
    for name in ATTENTION_GROUPS:
        rows = rows.withColumn(f"_{name}", parts[name]).withColumn(f"_{name}_t", _total(F.col(f"_{name}")))
        rows = rows.withColumn(f"_{name}_d", F.when(F.col(f"_{name}_t") >= least, _shares(name)))
        made |= _group_metrics(name, F.col(f"_{name}"), F.col(f"_{name}_t"), F.col(f"_{name}_d"), valid, least)
    i, p, g = (F.col(f"_{x}_t") for x in ATTENTION_GROUPS[:3])
    ratio = lambda a, b: F.when(valid & (b >= least), a / b)
    whole = i + p + g
    made |= {f"attn_ratio_{k}": r for k, r in {
        "img_to_prompt_text": ratio(i, i + p), "img_to_generated_text": ratio(i, i + g), "img_to_all": ratio(i, whole),
        "prompt_text_to_all": ratio(p, whole), "generated_text_to_all": ratio(g, whole), "prompt_generated_text_to_all": ratio(p + g, whole),
    }.items()}
    kept = keep if keep is not None else [c for c in df.columns if c != vector]
    return rows.select(*kept, valid.alias(f"{prefix}valid"), *[made[m].alias(f"{prefix}{m}") for m in ATTENTION_METRICS])


def _partial_sums(n_key: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each batch of heads (key columns, layer, vector) a row for each key: per scenario the sum of its vectors, their number, and whether one is invalid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy() for k in range(n_key)]
            _, first, group = np.unique(np.stack([*codes, np.zeros(batch.num_rows, np.int64)], 1), axis=0, return_index=True, return_inverse=True)
            layers, lists = pc.fill_null(batch.column(n_key), 0).to_numpy(zero_copy_only=False), batch.column(n_key + 1)
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()  # nulls are NaN
            given = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(ends) > 0)
            order = np.argsort(group, kind="stable")
            columns: list[list] = [[] for _ in range(3 * len(SCENARIOS))]
            for members in np.split(order, np.cumsum(np.bincount(group))[:-1]):
                for k, (low, high) in enumerate(SCENARIOS.values()):
                    inside = members[(layers[members] >= low) & (layers[members] <= high)]
                    total, bad = np.zeros(0), False
                    for i in inside.tolist():
                        x = values[ends[i] : ends[i + 1]] if given[i] else np.zeros(0)
                        sound = given[i] and bool(((x >= -EPSILON) & (x < INF)).all()) and len(total) in (0, len(x))
                        bad |= not sound
                        if sound:
                            total = total + np.maximum(x, 0) if len(total) else np.maximum(x, 0)
                    for column, value in zip(columns[3 * k : 3 * k + 3], (total, len(inside), bad)):
                        column.append(value)
            kinds = [pa.list_(pa.float64()), pa.int64(), pa.bool_()] * len(SCENARIOS)
            keys = [batch.column(k).take(pa.array(first)) for k in range(n_key)]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=names)

    return run


def mean_over_layers(df: DataFrame, key: list[str], layer: str = "layer", vector: str = "attention") -> DataFrame:
    """Mean attention over the layers and heads of each scenario: ``key`` and an array ``<scenario>`` each, null if one of its rows is invalid.

    A row is one head of one layer; a vector that is null, empty, invalid, or not as long as the others
    of its key in a batch makes the scenarios of its layer null; a key's heads are of one length. Heads are summed within Arrow batches, so what is
    spread out by position and shuffled is a row for each key and batch, not each head.
    """
    names = [*key, *[f"{x}{k}" for k in range(len(SCENARIOS)) for x in ("_sum", "_n", "_bad")]]
    fields = [df.schema[k] for k in key]
    for k in range(len(SCENARIOS)):
        fields += [StructField(f"_sum{k}", ArrayType(DoubleType())), StructField(f"_n{k}", LongType()), StructField(f"_bad{k}", BooleanType())]
    heads = df.select(*key, F.col(layer).cast("int").alias("_layer"), F.col(vector).cast("array<double>").alias("_v"))
    parts = heads.transform(in_arrow, _partial_sums(len(key), names), StructType(fields))
    sums, numbers, flags = ([f"{x}{k}" for k in range(len(SCENARIOS))] for x in ("_sum", "_n", "_bad"))
    sizes = F.greatest(*[F.size(c) for c in sums])
    # one row of numbers stands before the positions, so that a key without sums is not lost
    rows = parts.select(*key, *numbers, *flags, *sums, F.explode(F.sequence(F.lit(-1), sizes - 1)).alias("_at"))
    at = F.col("_at")
    totals = rows.groupBy(*key, "_at").agg(
        *[F.sum(F.when(at >= 0, F.get(c, at))).alias(c) for c in sums], *[F.sum(F.when(at < 0, F.col(c))).alias(c) for c in numbers],
        *[F.bool_or(c).alias(c) for c in flags],
    )
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when((at >= 0) & F.col(c).isNotNull(), F.struct("_at", c)))), lambda x: x[c])
    done = totals.groupBy(*key).agg(
        *[ordered(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in numbers], *[F.bool_or(c).alias(c) for c in flags],
    )
    mean = lambda c, n: F.transform(c, lambda x: x / F.col(n))
    means = [
        F.when((F.col(n) > 0) & ~F.col(b) & (F.size(c) > 0), mean(c, n)).alias(s)
        for s, c, n, b in zip(SCENARIOS, sums, numbers, flags)
    ]
    return done.select(*key, *means)


def layer_errors(df: DataFrame, key: list[str], layer: str = "layer") -> DataFrame:
    """Keys whose layers aren't exactly 1 to 36, and what is wrong: missing, duplicate or unknown layers."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(layer).alias("distinct"), F.min(layer).alias("lo"), F.max(layer).alias("hi"))
    wrong = F.when((F.col("lo") < 1) | (F.col("hi") > LAYERS), "unknown_layer").when(F.col("distinct") < LAYERS, "missing_layer").when(F.col("n") > F.col("distinct"), "duplicate_layer")
    return counts.withColumn("error", wrong).where("error is not null").select(*key, "error")


def scenarios(df: DataFrame, key: list[str], positions: DataFrame, layer: str = "layer", vector: str = "attention") -> DataFrame:
    """All 3 x 41 metrics with their scenario's prefix, from heads (``df``) and the groups (``positions``: key, image, prompt, generated)."""
    groups = ["image", "prompt", "generated"]
    rows, done = mean_over_layers(df, key, layer, vector).join(positions.select(*key, *groups), key), []
    for at, s in enumerate(SCENARIOS):
        rows = metrics(rows, vector=s, prefix=f"{s}__", keep=[*key, *groups, *list(SCENARIOS)[at + 1 :], *done])
        done = [c for c in rows.columns if "__" in c]
    return rows.select(*key, *counts(F.col("image"), F.col("prompt"), F.col("generated")), *done)


def counts(image: Column, prompt: Column, generated: Column) -> list[Column]:
    """The five numbers of tokens of an attention record, from the arrays of positions."""
    i, p, g = (F.size(c) for c in (image, prompt, generated))
    return [c.cast("int").alias(n) for n, c in zip(ATTENTION_COUNTS, (i, p, g, p + g, i + p + g))]
