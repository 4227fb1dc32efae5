"""Offline scoring of what a run has committed: pending generations, scores, failures, one commit."""

from __future__ import annotations

import hashlib
import inspect
import json
import traceback
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.identity import canonical_json, score_shard_id
from tessera.operators import scoring
from tessera.plans.commits import CommitError, Store, append_failures, commit_shard, quarantine, read_committed, read_examples, run_rules
from tessera.plans.lineage import cut
from tessera.schema import EXAMPLE_KEY, ROLLOUT_KEY, TABLES
from tessera.session import in_arrow

RESULT = "is_correct boolean, raw_final_answer string, extracted_answer string, scorer_method string, extra string, error string"
FIELDS = ("is_correct", "raw_final_answer", "extracted_answer", "scorer_method")


def code_hash(*modules) -> str:
    """SHA-256 of the source of modules or functions, in order."""
    return hashlib.sha256("\0".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


@dataclass(frozen=True)
class Scorer:
    """A named version of a way to score.

    ``function`` takes (question, truth, answer type, text) and gives a mapping, whose keys beyond the
    four of a score go to the details, or None to abstain; what it raises is a failure of that row alone.
    Without one the extraction rules of :mod:`tessera.operators.scoring` are used, as expressions.
    """

    name: str
    version: str
    function: Callable[[str, str, str, str], Mapping | None] | None = None

    def identity(self) -> dict[str, str]:
        code = code_hash(scoring, text) if self.function is None else code_hash(self.function)
        config = json.dumps({"name": self.name, "version": self.version}, sort_keys=True, separators=(",", ":"))
        return {"name": self.name, "version": self.version, "config_hash": hashlib.sha256(config.encode()).hexdigest(), "code_hash": code}

    def results(self, rows: DataFrame) -> DataFrame:
        """``rows`` (question, ground_truth, answer_type, generated_text and others) with a score's fields, ``extra`` (JSON) and ``error``."""
        if self.function is None:
            return scoring.score(rows).withColumn("extra", F.lit("{}")).withColumn("error", F.lit(None).cast("string"))
        function, inputs = self.function, ("question", "ground_truth", "answer_type", "generated_text")
        kept = rows.columns

        def one(*values) -> tuple:
            try:
                found = function(*values)
                if found is None:
                    return None, None, None, "abstain", "{}", None
                correct = found.get("is_correct")
                extra = json.dumps(
                    {k: v for k, v in found.items() if k not in FIELDS}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False,
                )
                said = [None if found.get(k) is None else str(found[k]) for k in FIELDS[1:3]]
                return None if correct is None else bool(correct), *said, str(found.get("scorer_method") or "unknown"), extra, None
            except Exception as e:
                return None, None, None, "failed", "{}", f"{type(e).__name__}: {e}\n{traceback.format_exc(limit=3)}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [one(*values) for values in zip(*(batch.column(kept.index(c)).to_pylist() for c in inputs))]
                columns = list(zip(*made)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(columns[0], pa.bool_()), *[pa.array(c, pa.string()) for c in columns[1:]]],
                    names=[*kept, *FIELDS, "extra", "error"],
                )

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.transform(in_arrow, run, f"{schema}, {RESULT}")


@dataclass(frozen=True)
class ScoreSummary:
    run_id: str
    scorer_name: str
    scorer_version: str
    committed: int
    shards: int
    skipped: int
    failed: int


def record_identity(store: Store, identity: dict[str, str]) -> None:
    """Keep a scorer's hashes with the run; the same name and version with other hashes is an error."""
    name = f"_scorers/{identity['name']}@{identity['version']}.json"
    try:
        store.create(name, json.dumps(identity, sort_keys=True))
    except CommitError:
        if json.loads(store.read(name)) != identity:
            raise CommitError(f"scorer {identity['name']} {identity['version']} conflicts with the hashes recorded for it") from None


def details(identity: dict[str, str], answer_type: Column, truth: Column, extra: Column) -> Column:
    """JSON of a score's circumstances with sorted keys: the answer's type, the truth (JSON), the scorer's hashes, and what the scorer adds (JSON)."""
    own = F.from_json(extra, "map<string,string>")
    plain = canonical_json(answer_type=answer_type, scorer_code_hash=F.lit(identity["code_hash"]), scorer_config_hash=F.lit(identity["config_hash"]))
    added = F.when(F.coalesce(F.size(own), F.lit(0)) > 0, F.concat(F.lit(',"extra":'), extra)).otherwise("")
    # answer_type, extra, ground_truth and scorer_* are in the order of their names
    head, tail = F.regexp_extract(
        plain, '^(\\{"answer_type":.*?)(,"scorer_code_hash":.*)$', 1,
    ), F.regexp_extract(plain, '^(\\{"answer_type":.*?)(,"scorer_code_hash":.*)$', 2)
    return F.concat(head, added, F.lit(',"ground_truth":'), F.coalesce(truth, F.lit("null")), tail)


def score_rows(scored: DataFrame, identity: dict[str, str], scored_at: datetime) -> DataFrame:
    """Rows of ``scores`` from results; a score shard is named by its core shard, the scorer's hashes and the rollouts in it."""
    members = scored.groupBy("shard_id").agg(F.array_sort(F.collect_list("rollout_index")).alias("rollouts"))
    payload = canonical_json(
        code_hash=F.lit(identity["code_hash"]), config_hash=F.lit(identity["config_hash"]), core_shard_id=F.col("shard_id"),
        name=F.lit(identity["name"]), rollouts=F.col("rollouts"), version=F.lit(identity["version"]),
    )
    named = members.select("shard_id", score_shard_id(F.col("shard_id"), payload).alias("score_shard_id"))
    made = scored.join(named, "shard_id").withColumns({
        "scorer_name": F.lit(identity["name"]), "scorer_version": F.lit(identity["version"]), "scored_at_utc": F.lit(scored_at).cast("timestamp"),
        "score_details_json": details(identity, F.col("answer_type"), F.col("ground_truth_json"), F.col("extra")),
    })
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES["scores"]])


def score_run(store: Store, run_id: str, scorer: Scorer, attempt: str | None = None, scored_at: datetime | None = None) -> ScoreSummary:
    """Score every committed generation of a run that has no score of this scorer yet, and commit the scores together.

    A generation without an example, and one whose scorer raises, becomes a failure record and no score;
    it is tried again by the next call. Scoring the same run again commits nothing.
    """
    attempt, scored_at = attempt or f"attempt-{uuid.uuid4().hex}", scored_at or datetime.now(timezone.utc)
    quarantine(store)
    identity = scorer.identity()
    record_identity(store, identity)
    generations = read_committed(store, "generations").where(F.col("run_id") == run_id)
    left = cut(scoring.pending(generations, read_committed(store, "scores"), list(ROLLOUT_KEY), scorer.name, scorer.version))
    skipped, n = generations.count() - left.count(), left.count()
    if not n:
        return ScoreSummary(run_id, scorer.name, scorer.version, 0, 0, skipped, 0)
    truth = F.from_json("ground_truth_json", "answer string, question_for_eval string")
    examples = read_examples(store).select(
        *EXAMPLE_KEY, F.coalesce(truth["question_for_eval"], "question").alias("question"),
        F.coalesce(truth["answer"], F.lit("")).alias("ground_truth"), "answer_type", "ground_truth_json",
    )
    found, alone = scoring.with_examples(
        left.select(*ROLLOUT_KEY, "shard_id", "generated_text"), examples, list(EXAMPLE_KEY),
        ["question", "ground_truth", "answer_type", "ground_truth_json"],
    )
    results = cut(scorer.results(found))
    failed = results.where("error is not null").select(*ROLLOUT_KEY, "error").unionByName(alone.select(*ROLLOUT_KEY, "error"))
    n_failed = failed.count()
    if n_failed:
        told = {"stage": "scoring", "attempt": attempt, "scorer_name": scorer.name, "scorer_version": scorer.version, "created_at_utc": scored_at.isoformat()}
        append_failures(
            store,
            failed.select(
                *[F.lit(v).alias(k) for k, v in told.items()], *ROLLOUT_KEY, F.substring_index("error", ":", 1).alias("exception_type"),
                F.col("error").alias("message"),
            ),
        )
    rows = cut(score_rows(results.where("error is null"), identity, scored_at))
    committed, shards = rows.agg(F.count(F.lit(1)), F.countDistinct("score_shard_id")).first()
    if committed:
        commit_shard(store, attempt, {"scores": rows}, run_rules({"run_id": run_id}, kind="scores"), kind="scores")
    return ScoreSummary(run_id, scorer.name, scorer.version, committed, shards, skipped, n_failed)
