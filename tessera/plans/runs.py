"""Which runs and rows are worked on, in what order, and whether a plan is the one expected."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.constraints import set_difference
from tessera.plans.commits import Store
from tessera.plans.scoring_run import Scorer, ScoreSummary, score_run
from tessera.sources.adapters import Adapter, adapter

CELL = ("dataset", "split", "filter_id", "strategy")


def selected_runs(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """All runs, or the one of an id; an id that no run has is an error."""
    found = runs if run_id is None else runs.where(F.col("run_id") == run_id)
    if found.isEmpty():
        raise KeyError(f"unknown run_id {run_id!r}")
    return found


def unfinished_runs(runs: DataFrame) -> DataFrame:
    """Runs that still have work: all but the complete ones; a run without status has not begun."""
    return runs.where(~F.col("status").eqNullSafe("complete"))


def plan_difference(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Cells (dataset, split, filter, strategy) that only one of two plans has, with their side."""
    return set_difference(expected.select(*CELL), existing.select(*CELL))


def check_plan(expected: DataFrame, existing: DataFrame) -> None:
    """A plan that is there must have exactly the cells of the configuration."""
    differ = plan_difference(expected, existing).limit(20).collect()
    if differ:
        raise ValueError(f"the plan differs from the configuration: {[tuple(r) for r in differ]}")


def first_examples(examples: DataFrame, n: int, ordinal: str = "source_row_index") -> DataFrame:
    """The first ``n`` examples in the source's order."""
    return examples.orderBy(ordinal).limit(n)


def ordered_bundles(rollouts: DataFrame, ordinal: str = "ordinal", index: str = "rollout_index") -> DataFrame:
    """Rollouts in the order in which they are handed on: by example, then by rollout."""
    return rollouts.orderBy(ordinal, index)


def gathered(rollouts: DataFrame, prompts: DataFrame, row: str = "prompt_row") -> DataFrame:
    """Each rollout with what its prompt has; several rollouts share a prompt, and one without a prompt is an error."""
    marked = prompts.withColumn("_has", F.lit(True))
    joined = rollouts.join(marked, row, "left")
    return joined.withColumn(
        row,
        F.when(F.col("_has"), F.col(row)).otherwise(F.raise_error(F.concat(F.lit("no prompt "), F.col(row).cast("string"))).cast(rollouts.schema[row].dataType)),
    ).drop("_has")


def missing_keys(present: Iterable[str], required: Iterable[str]) -> list[str]:
    """Required settings that aren't there, in order."""
    return sorted(set(required) - set(present))


def candidates(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group the different values in order."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("candidates"))


@dataclass
class Engine:
    """Work on a group of runs with parts that may be replaced: how adapters and stores are made, what scores, and who is told of measurements."""

    make_store: Callable[[str], Store]
    make_adapter: Callable[[str], Adapter] = adapter
    make_scorer: Callable[[Adapter], Scorer] = lambda a: a.scorer()
    on_measurement: Callable[[dict], None] = lambda measured: None
    measured: list[dict] = field(default_factory=list)

    def score(self, runs: DataFrame, run_id: str | None = None) -> list[ScoreSummary]:
        """Score all runs of a group, or one, as offline scoring does: what has a score of this scorer is passed over."""
        out = []
        for r in selected_runs(runs, run_id).select("run_id", "dataset").orderBy("run_id").collect():  # configuration, a few rows
            start = time.perf_counter()
            summary = score_run(self.make_store(r.run_id), r.run_id, self.make_scorer(self.make_adapter(r.dataset)))
            out.append(summary)
            measured = {"run_id": r.run_id, "seconds": time.perf_counter() - start, "committed": summary.committed, "failed": summary.failed}
            self.measured.append(measured)
            self.on_measurement(measured)
        return out
