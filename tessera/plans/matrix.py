"""Run matrices, expected rollouts, what is left of them, and the wide view of the metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.identity import run_id, seed
from tessera.schema import TOKEN_KEY, TOKEN_TABLES


def runs(datasets: DataFrame, strategies: DataFrame, group: str, prefix: str = "tessera") -> DataFrame:
    """A run for each dataset (dataset, split, filter_id) and strategy: a product of two configuration tables of a few rows."""
    cells = datasets.select("dataset", "split", "filter_id").crossJoin(F.broadcast(strategies.select("strategy")))
    return cells.withColumn("run_id", run_id(F.lit(group), F.col("dataset"), F.col("split"), F.col("filter_id"), F.col("strategy"), prefix))


def expected_rollouts(examples: DataFrame, n: int) -> DataFrame:
    """Each example with each rollout index below ``n``, generated in place."""
    return examples.withColumn(
        "rollout_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))),
    ) if n > 0 else examples.withColumn("rollout_index", F.lit(0)).limit(0)


def with_seeds(rollouts: DataFrame, base_seed: int) -> DataFrame:
    if not 0 <= base_seed < 1 << 64:
        raise ValueError("the base seed must be an unsigned 64-bit number")
    return rollouts.withColumn(
        "rollout_seed", seed(F.lit(base_seed).cast("decimal(20,0)"), F.col("dataset"), F.col("sample_id"), F.col("strategy"), F.col("rollout_index")),
    )


def pending(expected: DataFrame, completed: DataFrame, key: list[str]) -> DataFrame:
    return expected.join(completed.select(*key).distinct(), key, "left_anti")


def selected(examples: DataFrame, ids: list[str]) -> DataFrame:
    """Examples in the order asked for; an id that doesn't exist is an error."""
    if len(set(ids)) != len(ids):
        raise ValueError("sample ids must be unique")
    wanted = examples.sparkSession.createDataFrame(list(enumerate(ids)), "position long, sample_id string")
    found = examples.join(F.broadcast(wanted), "sample_id")
    missing = wanted.join(found.select("sample_id").distinct(), "sample_id", "left_anti").select("sample_id").collect()
    if missing:
        raise KeyError(f"unknown sample ids: {sorted(r.sample_id for r in missing)}")
    return found.orderBy("position").drop("position")


def wide_view(tables: dict[str, DataFrame], key: list[str] | None = None) -> DataFrame:
    """Tokens with all their metrics on one row: equi-joins on the same key, which share one partitioning.

    Tables written with :func:`write_bucketed` join without any shuffle.
    """
    key = key or list(TOKEN_KEY)
    out = tables[TOKEN_TABLES[0]]
    for name in TOKEN_TABLES[1:]:
        out = out.join(tables[name].drop("shard_id"), key)
    return out


def write_bucketed(df: DataFrame, table: str, key: list[str], buckets: int) -> None:
    """Store a metric table bucketed and sorted by its rollout, so that joins and groupings on it need no shuffle."""
    df.write.mode("errorifexists").bucketBy(buckets, *key).sortBy(*key).format("parquet").saveAsTable(table)
