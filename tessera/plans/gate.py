"""Release gate of an experiment group: named rules over its manifest, its stored tables and its benchmarks; and events for logs."""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.constraints import duplicates, set_difference
from tessera.plans.commits import Store, orphans, verify
from tessera.schema import ROLLOUT_KEY


@dataclass(frozen=True)
class Finding:
    rule: str
    passed: bool
    detail: str = ""


def manifest_findings(group: dict, runs: list[dict], expected_runs: int, rollouts: int, hashes: dict[str, str]) -> list[Finding]:
    """Rules on the manifests alone: number and status of runs, rollouts, a clean source tree, hashes, parents' and children's agreement."""
    ids = [r.get("run_id") for r in runs]
    parents = {r.get("run_id"): r for r in group.get("runs", [])}
    unlike = [i for r in runs for i in [r.get("run_id")] if any(parents.get(i, {}).get(k) != r.get(k) for k in ("dataset", "split", "filter_id", "strategy"))]
    return [
        Finding("run_count", len(runs) == expected_runs, f"{len(runs)} of {expected_runs}"), Finding("unique_runs", len(set(ids)) == len(ids)),
        Finding("all_complete", bool(runs) and all(r.get("status") == "complete" for r in runs)), Finding("group_complete", group.get("status") == "complete"),
        Finding("rollouts_per_example", all(r.get("rollouts") == rollouts for r in runs)), Finding("clean_source", not group.get("git_dirty", True)),
        Finding("parent_agrees", not unlike and set(parents) == set(ids), ", ".join(map(str, unlike))),
        *(Finding(f"hash:{k}", group.get(k) == v) for k, v in hashes.items()),
    ]


def manifest_conflicts(parents: DataFrame, children: DataFrame, fields: list[str], key: str = "run_id") -> DataFrame:
    """``key, field, parent, child``: fields in which a run's entry in its group's manifest and its own manifest differ, null being equal to null. A run that only one of them has differs in ``key``; so does one that either has several times, once for each pair."""
    both = parents.select(F.col(key).alias("_p"), *[F.col(f).cast("string").alias(f"_p_{f}") for f in fields]).join(
        children.select(F.col(key).alias("_c"), *[F.col(f).cast("string").alias(f"_c_{f}") for f in fields]), F.col("_p") == F.col("_c"), "full",
    )
    alone = F.col("_p").isNull() | F.col("_c").isNull()
    pair = lambda f, p, c: F.struct(F.lit(f).alias("field"), p.cast("string").alias("parent"), c.cast("string").alias("child"))
    told = F.when(alone, F.array(pair(key, F.col("_p"), F.col("_c")))).otherwise(F.array(*[pair(f, F.col(f"_p_{f}"), F.col(f"_c_{f}")) for f in fields]))
    return both.select(F.coalesce("_p", "_c").alias(key), F.explode(told).alias("d")).select(key, "d.*").where("not (parent <=> child)")


def _report(row: DataFrame, findings: dict[str, Column]) -> DataFrame:
    """A table of one row of aggregates as ``rule, passed``; what can't be told has not passed."""
    told = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in findings.items()])
    return row.select(F.explode(told).alias("f")).select("f.*")


def run_report(runs: DataFrame, parents: DataFrame, expected_runs: int, rollouts: int, fields: list[str]) -> DataFrame:
    """``rule, passed`` of the manifests as tables: number and identity of runs, their status and rollouts, and agreement with the group's entries."""
    row = runs.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("run_id").alias("different"), F.bool_and(F.col("status").eqNullSafe("complete")).alias("complete"),
        F.bool_and(F.col("rollouts").eqNullSafe(F.lit(rollouts))).alias("rollouts"),
    )
    alike = manifest_conflicts(parents, runs, fields).agg((F.count(F.lit(1)) == 0).alias("agrees"))
    found = {
        "run_count": F.col("n") == expected_runs, "unique_runs": F.col("different") == F.col("n"), "all_complete": F.col("complete"),
        "rollouts_per_example": F.col("rollouts"), "parent_agrees": F.col("agrees"),
    }
    return _report(row.crossJoin(alike), found)  # a row each


def benchmark_report(measured: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """``rule, passed`` of benchmarks as a table: see :func:`benchmark_findings`."""
    asked = F.array(*[F.struct(F.lit(p).cast("long").alias("prompts"), F.lit(r).cast("long").alias("rollouts")) for p, r in shapes])
    done = measured.groupBy(F.col("prompts").cast("long").alias("prompts"), F.col("rollouts").cast("long").alias("rollouts")).agg(F.bool_and("complete").alias("complete"))
    ran = done.where("complete").agg(F.collect_set(F.when(F.array_contains(asked, F.struct("prompts", "rollouts")), F.struct("prompts", "rollouts"))).alias("ran"))  # of the shapes alone
    row = measured.agg((F.count_distinct("ids_hash") == 1).alias("same")).crossJoin(ran)
    return _report(row, {"benchmark_shapes": F.size("ran") == len(set(shapes)), "benchmark_ids_agree": F.col("same")})


def storage_findings(store: Store, expected: DataFrame, generations: DataFrame) -> list[Finding]:
    """Rules on what is stored: exactly the expected rollouts, each once, no part that isn't committed, counts as committed."""
    key = [c for c in ROLLOUT_KEY if c in expected.columns]
    missing = set_difference(expected.select(*key).distinct(), generations.select(*key).distinct()).groupBy("side").count().collect()
    twice = duplicates(generations, key).count()
    left = orphans(store)
    return [
        Finding("expected_rollouts", not missing, ", ".join(f"{r['count']} {r.side}" for r in missing)), Finding("rollouts_once", twice == 0, str(twice)),
        Finding("no_orphans", not left, str(len(left))), Finding("inventory", verify(store).count() == 0),
    ]


def benchmark_findings(measured: DataFrame, shapes: list[tuple[int, int]]) -> list[Finding]:
    """Rules on benchmarks (``prompts, rollouts, complete, ids_hash``): each shape ran to its end, and all retained the same ids."""
    rows = measured.groupBy("prompts", "rollouts").agg(F.bool_and("complete").alias("complete"), F.collect_set("ids_hash").alias("hashes")).collect()
    done = {(r.prompts, r.rollouts) for r in rows if r.complete}
    hashes = {h for r in rows for h in r.hashes}
    return [
        Finding("benchmark_shapes", set(shapes) <= done, str(sorted(set(shapes) - done))),
        Finding("benchmark_ids_agree", len(hashes) == 1, str(len(hashes))),
    ]


def passed(findings: list[Finding]) -> bool:
    return all(f.passed for f in findings)


def log_event(name: str, stream=None, **fields) -> None:
    """One line of JSON with the time; null fields are left out."""
    made = {"event": name, "at": datetime.now(timezone.utc).isoformat()} | {k: v for k, v in fields.items() if v is not None}
    print(json.dumps(made, sort_keys=True, ensure_ascii=False), file=stream or sys.stderr)
