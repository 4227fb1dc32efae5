"""The release gate's rules and log events."""

import io
import json

from tessera.plans import gate

CELL = {"dataset": "d", "split": "t", "filter_id": "all", "strategy": "s"}
RUN = {"run_id": "r", "status": "complete", "rollouts": 32, **CELL}
GROUP = {"status": "complete", "git_dirty": False, "config_hash": "h", "runs": [{"run_id": "r", **CELL}]}


def failed(findings):
    return {f.rule for f in findings if not f.passed}


def test_manifest_rules():
    assert gate.passed(gate.manifest_findings(GROUP, [RUN], 1, 32, {"config_hash": "h"}))
    assert failed(gate.manifest_findings(GROUP | {"git_dirty": True}, [RUN | {"status": "failed", "split": "x", "rollouts": 8}], 2, 32, {"config_hash": "z"})) == {
        "run_count", "all_complete", "rollouts_per_example", "clean_source", "parent_agrees", "hash:config_hash",
    }


def test_benchmark_rules(spark):
    rows = spark.createDataFrame(
        [(4, 32, True, "a"), (8, 32, True, "b"), (16, 32, False, "a")], "prompts int, rollouts int, complete boolean, ids_hash string",
    )
    assert failed(gate.benchmark_findings(rows, [(4, 32), (16, 32)])) == {"benchmark_shapes", "benchmark_ids_agree"}
    assert gate.passed(gate.benchmark_findings(rows.limit(1), [(4, 32)]))


def test_events():
    out = io.StringIO()
    gate.log_event("shard", out, shard="a", error=None)
    made = json.loads(out.getvalue())
    assert made["event"] == "shard" and made["shard"] == "a" and "error" not in made


def test_queries_are_listed_without_a_session():
    """The entry is imported, and its queries listed, before any session exists."""
    import os
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=top, check=True, timeout=120)
