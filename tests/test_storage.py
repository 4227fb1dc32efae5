"""Commits, crashes, constraints with broken rows, configuration and streaming."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import config
from tessera.operators import constraints
from tessera.plans import commits, matrix
from tessera.schema import CORE_TABLES, TABLES, TOKEN_TABLES

NOW = datetime.datetime(2026, 1, 1)


def filled(schema: StructType, **given):
    """A row of a table: values given, else one of the column's type."""
    blank = {"string": "s", "integer": 0, "long": 0, "short": 0, "float": 0.5, "double": 0.5, "boolean": True, "timestamp": NOW}
    out = []
    for f in schema:
        kind = f.dataType.typeName()
        out.append(given[f.name] if f.name in given else [] if kind == "array" else 0 if kind.startswith("decimal") else None if f.nullable else blank[kind])
    return tuple(out)


def shard(spark, sample: str, lengths: list[int]) -> dict:
    """Core tables of one sample with a rollout for each length."""
    key = {"run_id": "r", "dataset": "d", "split": "t", "sample_id": sample, "strategy": "st", "shard_id": sample}
    rows = {t: [] for t in CORE_TABLES}
    for k, n in enumerate(lengths):
        ids = list(range(100, 100 + n))
        rows["generations"].append(filled(
            TABLES["generations"], **key, rollout_index=k, generated_token_ids=ids, num_retained_tokens=n, stop_reason="stop_token",
            terminating_token_id=9, hit_max_new_tokens=False, prompt_token_count=5,
        ))
        for step, token in enumerate(ids, 1):
            at = {**key, "rollout_index": k, "step": step}
            rows["tokens"].append(filled(TABLES["tokens"], **at, token_id=token, context_length=5 + step - 1, predictor_position=5 + step - 2))
            for t in TOKEN_TABLES[1:]:
                rows[t].append(filled(TABLES[t], **at, n_generated_text_tokens=step - 1, n_prompt_generated_text_tokens=step - 1, n_all_attn_tokens=step - 1))
    from decimal import Decimal

    fix = lambda t, row: tuple(Decimal(v) if f.dataType.typeName().startswith("decimal") else v for f, v in zip(TABLES[t], row))
    return {t: spark.createDataFrame([fix(t, r) for r in rows[t]], TABLES[t]) for t in CORE_TABLES}


def core_rules():
    return [r for r in constraints.storage_rules() if "score" not in r.name and "example" not in r.name]


@pytest.fixture
def store(spark, tmp_path):
    return commits.Store(spark, f"file://{tmp_path}/run")


def test_commit_and_read(spark, store):
    done = commits.commit_shard(store, "a", shard(spark, "a", [1, 0]), core_rules())
    commits.commit_shard(store, "b", shard(spark, "b", [0]))
    assert done["rollouts"] == 2 and done["min_step"] == done["max_step"] == 1
    assert commits.read_committed(store, "generations").count() == 3 and commits.read_committed(store, "tokens").count() == 1
    assert commits.completed(store).count() == 3 and commits.orphans(store) == [] and commits.verify(store).count() == 0
    with pytest.raises(commits.CommitError):
        commits.commit_shard(store, "a", shard(spark, "a", [1]))
    assert commits.read_committed(store, "scores").count() == 0


@pytest.mark.parametrize("at", ["validate", "write:generations", "verify:tokens", "write:token_hidden_state_metrics", "commit", "after"])
def test_crashes(spark, store, at):
    def crash(stage):
        if stage == at:
            raise OSError(stage)

    tables = shard(spark, "a", [1])
    with pytest.raises(OSError):
        commits.commit_shard(store, "a", tables, failure_injector=crash)
    assert commits.read_committed(store, "generations").count() == (at == "after")
    if at != "after":
        assert len(commits.quarantine(store)) == len(commits.orphans(store)) + {
            "validate": 0, "write:generations": 0, "verify:tokens": 2, "write:token_hidden_state_metrics": 4, "commit": 5,
        }[at]
        commits.commit_shard(store, "a", tables)
        assert commits.read_committed(store, "generations").count() == 1


def test_broken_rows_are_named(spark, store):
    good = shard(spark, "a", [2, 1])
    found = {r.rule: r.n_violations for r in constraints.check(good, core_rules()).collect()}
    assert set(found.values()) == {0}
    broken = dict(good)
    broken["tokens"] = good["tokens"].where("step <> 1 or rollout_index <> 0")
    broken["generations"] = good["generations"].withColumn("terminating_token_id", F.lit(None).cast("int"))
    broken["token_probability_metrics"] = good["token_probability_metrics"].withColumn("metrics_valid", F.lit(False))
    found = {r.rule for r in constraints.check(broken, core_rules()).where("n_violations > 0").collect()}
    assert {"contiguous_steps", "token_ids_match", "stop_reason", "validity_reason", "aligned_token_attention_metrics"} <= found
    with pytest.raises(commits.CommitError):
        commits.commit_shard(store, "x", broken, core_rules())
    nan = dict(good) | {"token_probability_metrics": good["token_probability_metrics"].withColumn("logp", F.lit(float("nan")).cast("float"))}
    with pytest.raises(Exception, match="NaN"):
        commits.commit_shard(store, "y", nan)
    with pytest.raises(commits.CommitError):
        commits.conform(good["tokens"].drop("step"), "tokens")


def test_failures_are_kept(spark, store):
    assert commits.failures(store).count() == 0
    commits.append_failure(store, {"stage": "scoring", "message": "ü"})
    assert commits.failures(store).first().message == "ü"


def test_transitions():
    constraints.check_transition("failed", "running")
    with pytest.raises(ValueError):
        constraints.check_transition("complete", "running")


def test_selection(spark):
    df = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    assert [r.sample_id for r in matrix.selected(df, ["b", "a"]).collect()] == ["b", "a"]
    for bad in (["a", "z"], ["a", "a"]):
        with pytest.raises((KeyError, ValueError)):
            matrix.selected(df, bad)


def test_bucketed_tables_join_without_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("wide_a", "wide_b"):
            spark.sql(f"drop table if exists {name}")
            matrix.write_bucketed(spark.range(100).withColumnRenamed("id", "k"), name, ["k"], 4)
        plan = spark.table("wide_a").join(spark.table("wide_b"), "k")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 10 << 20)


GROUP = {
    "id": "g", "datasets": [{"name": "mathverse", "split": "test", "path": "x"}], "strategies": {"diverse": {"temperature": 1.0, "top_p": 0.99}}, "rollouts": 32, "base_seed": 42, "microbatch": 8,
    "scheduler": {"batch_size": 4}, "hardware": {"max_rows": 64},
}


def test_config(tmp_path):
    (tmp_path / "hw.json").write_text(json.dumps({"max_rows": 64}))
    (tmp_path / "g.json").write_text(json.dumps(GROUP | {"hardware": {"include": "hw.json"}}))
    assert config.load(str(tmp_path / "g.json")).hash == config.build(config.GroupConfig, GROUP).hash
    for change in (
        {"microbatch": 64}, {"extra": 1}, {"base_seed": -1}, {"hardware": {"max_rows": 8}}, {"strategies": {"x": {"temperature": 0}}},
        {"scheduler": {"batch_size": 4, "strategy": "token_count_bucketed", "window_size": 2}},
    ):
        with pytest.raises(config.ConfigError):
            config.build(config.GroupConfig, GROUP | change)


def test_stored_names():
    """Names and order of a stored table's columns are fixed."""
    names = TABLES["token_attention_metrics"].names
    assert names[:13] == [
        "run_id", "dataset", "split", "sample_id", "strategy", "rollout_index", "step", "shard_id", "n_image_tokens", "n_prompt_text_tokens", "n_generated_text_tokens", "n_prompt_generated_text_tokens", "n_all_attn_tokens",
    ]
    assert len(names) == 13 + 3 * 42 and not TABLES["scores"]["scorer_method"].nullable and TABLES["scores"]["is_correct"].nullable


RUN = {
    "run_id": "r", "dataset": "d", "split": "t", "strategy": "st", "rollouts": 2, "temperature": 0.5, "top_p": 0.5, "top_k": None,
    "repetition_penalty": 0.5,
}


def test_a_shard_is_held_against_its_run(spark, store):
    tables = shard(spark, "a", [2, 1])
    commits.commit_shard(store, "a", tables, core_rules(), run=RUN)
    for change, rule in (
        ({"run_id": "q"}, "run_of_tokens"), ({"rollouts": 1}, "rollouts_of_run"), ({"top_p": 0.9}, "sampling_of_run"),
        ({"top_k": 5}, "sampling_of_run"),
    ):
        with pytest.raises(commits.CommitError, match=rule):
            commits.commit_shard(store, "b", shard(spark, "b", [2, 1]), run=RUN | change)
    with pytest.raises(commits.CommitError, match="shard_of_generations"):
        commits.commit_shard(store, "c", tables, run=RUN)
    wrong = tables | {"token_attention_metrics": tables["token_attention_metrics"].withColumn("n_all_attn_tokens", F.lit(7))}
    with pytest.raises(commits.CommitError, match="attention_counts"):
        commits.commit_shard(store, "d", wrong, core_rules())


def test_changed_parts_are_told(spark, store, tmp_path):
    commits.commit_shard(store, "a", shard(spark, "a", [2, 1]), run=RUN)
    commits.commit_shard(store, "b", shard(spark, "b", [0]), run=RUN)
    assert commits.verify(store).count() == 0
    part = next(c for c in commits.commits(store) if c["shard"] == "a")["parts"]["tokens"]["path"]
    spark.createDataFrame([], TABLES["tokens"]).coalesce(1).write.mode("append").parquet(f"{store.root}/{part}")
    assert {r.what.split(":")[0] for r in commits.verify(store).collect()} == {"file"}
    commits.read_committed(store, "tokens").limit(1).coalesce(1).write.mode("append").parquet(f"{store.root}/{part}")
    found = commits.verify(store).collect()
    assert {"rows", "keys", "file"} <= {r.what.split(":")[0] for r in found} and {r.shard for r in found if r.what == "rows"} == {"a"}
    torn = tmp_path / "run/_commits/core/z.json"
    torn.write_text('{"sh')
    # the files that were added to the part belong to no commit either
    assert len(commits.commits(store)) == 2 and [n for n in commits.orphans(store) if not n.startswith(part)] == ["_commits/core/z.json"]
    with pytest.raises(commits.CommitError):
        store.create("_commits/core/z.json", "{}")
    commits.quarantine(store)
    (tmp_path / "run/_commits/core/y.json").write_text(json.dumps({"shard": "y", "parts": {"tokens": {"path": "data/tokens/../../x"}}}))
    with pytest.raises(commits.CommitError, match="outside"):
        commits.commits(store)


PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (30).to_bytes(4, "big") + (20).to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"


def test_from_a_source_to_committed_scores(spark, store, tmp_path):
    from tessera.plans import records, runs
    from tessera.plans.scoring_run import Scorer, score_run
    from tessera.sources import adapters

    (tmp_path / "pictures").mkdir()
    (tmp_path / "pictures/b.png").write_bytes(PNG)
    picture = "struct<bytes: binary, path: string>"
    source = [
        ("a", None, "Vision", "Which?\n(A) x\n(B) y", "B", (PNG, None)), ("b", None, "Vision", "How many?", "1/2", (None, "pictures/b.png")),
        ("c", None, "Text", "Else", "2", None),
    ]
    path = str(tmp_path / "source.parquet")
    import pyarrow as pa
    import pyarrow.parquet as pq

    kinds = [
        ("sample_index", pa.string()), ("problem_index", pa.string()), ("problem_version", pa.string()), ("question", pa.string()),
        ("answer", pa.string()), ("image", pa.struct([("bytes", pa.binary()), ("path", pa.string())])),
    ]
    rows = [dict(zip([k for k, _ in kinds], (*r[:5], None if r[5] is None else dict(zip(("bytes", "path"), r[5]))))) for r in source]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema(kinds)), path)
    adapter = adapters.adapter("mathverse")
    examples = adapter.examples(spark, path, {"problem_version": " VISION"})
    assert [tuple(m.role for m in r.messages) for r in adapter.messages(examples).collect()] == [("user",)] * 2
    made = records.example_rows(examples, "r", "d", "t", F.array(F.lit(1), F.lit(2)))
    commits.write_examples(store, made)
    stored = {r.sample_id: r for r in commits.read_examples(store).collect()}
    assert len(stored) == 2 and all(r.prompt_token_count == 2 for r in stored.values())
    assert [(i.source_ref, i.width, i.height, i.mode) for i in stored["b"].images] == [("pictures/b.png", 30, 20, "RGB")] and stored["a"].images[0].sha256 == stored["b"].images[0].sha256
    assert json.loads(stored["a"].ground_truth_json) == {"answer": "B", "question_for_eval": "Which?\n(A) x\n(B) y"}
    for sample, said in (("a", ["\\boxed{B}", "no idea"]), ("b", ["\\boxed{0.5}", "\\boxed{3}"]), ("z", ["\\boxed{1}"])):
        tables = shard(spark, sample, [0] * len(said))
        answers = F.array(*[F.lit(x) for x in said])
        commits.commit_shard(
            store, sample, tables | {"generations": tables["generations"].withColumn("generated_text", F.get(answers, F.col("rollout_index")))},
            run=RUN,
        )
    summary = score_run(store, "r", adapter.scorer(), scored_at=NOW)
    assert (summary.committed, summary.shards, summary.skipped, summary.failed) == (4, 2, 0, 1)
    scores = {(r.sample_id, r.rollout_index): r for r in commits.read_committed(store, "scores").collect()}
    assert {k: r.is_correct for k, r in scores.items()} == {("a", 0): True, ("a", 1): None, ("b", 0): True, ("b", 1): False}
    details = json.loads(scores["a", 0].score_details_json)
    assert details["ground_truth"]["answer"] == "B" and details["answer_type"] == "multiple_choice" and len(details["scorer_code_hash"]) == 64 and scores["a", 0].scored_at_utc == NOW
    assert scores["a", 0].score_shard_id.startswith("a-") and scores["a", 0].score_shard_id == scores["a", 1].score_shard_id
    assert commits.failures(store).first().message == "missing_example"
    again = score_run(store, "r", adapter.scorer())
    assert (again.committed, again.skipped, again.failed) == (0, 4, 1) and commits.read_committed(store, "scores").count() == 4

    def picky(question, truth, kind, text):
        if "idea" in text:
            raise ValueError("no answer")
        return None if "3" in text else {"is_correct": truth in text, "scorer_method": "picky", "length": len(text)}

    other = score_run(store, "r", Scorer("picky", "1", picky))
    assert (other.committed, other.failed) == (3, 2)
    mine = {(r.sample_id, r.rollout_index): r for r in commits.read_committed(store, "scores").where("scorer_name = 'picky'").collect()}
    assert mine["b", 1].scorer_method == "abstain" and mine["b", 1].is_correct is None and json.loads(mine["a", 0].score_details_json)["extra"] == {"length": 9}
    assert {r.exception_type for r in commits.failures(store).collect()} == {"missing_example", "ValueError"}
    with pytest.raises(commits.CommitError, match="conflicts"):
        score_run(store, "r", Scorer("picky", "1", lambda q, t, k, x: None))
    told = []
    engine = runs.Engine(lambda run_id: store, lambda name: adapter, on_measurement=told.append)
    plan = spark.createDataFrame([("r", "mathverse", "complete"), ("q", "mathverse", None)], "run_id string, dataset string, status string")
    assert engine.score(plan, "r")[0].skipped == 4 and told[0]["run_id"] == "r"
    with pytest.raises(KeyError):
        engine.score(plan, "unknown")
    assert [r.run_id for r in runs.unfinished_runs(plan).collect()] == ["q"]
    assert commits.verify(store).count() == 0 and commits.verify(store, "scores").count() == 0 and commits.verify(store, "examples").count() == 0


def test_sources_refuse(spark, tmp_path):
    from tessera.sources import adapters

    path = str(tmp_path / "a.parquet")
    spark.createDataFrame(
        [("x", None, "Q", "1"), ("x", None, "R", "2")], "sample_index string, problem_index string, question string, answer string",
    ).coalesce(1).write.parquet(path)
    with pytest.raises(ValueError, match="repeated"):
        adapters.adapter("mathverse").examples(spark, path)
    path = str(tmp_path / "b.parquet")
    spark.createDataFrame(
        [("x", "Q", "1", (None, "gone.png"))], "sample_index string, question string, answer string, image struct<bytes: binary, path: string>",
    ).coalesce(1).write.parquet(path)
    with pytest.raises(Exception, match="no image"):
        adapters.adapter("mathverse").examples(spark, path).collect()
    with pytest.raises(KeyError):
        adapters.adapter("unknown")
    with pytest.raises(ValueError):
        adapters.register(adapters.adapter("mathverse"))


def test_image_headers():
    from tessera.sources.images import size_of

    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + (7).to_bytes(2, "big") + (9).to_bytes(2, "big") + b"\x03\x01\x11\x00"
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X" + b"\x0a\x00\x00\x00\x00\x00\x00\x00" + (4).to_bytes(3, "little") + (5).to_bytes(3, "little")
    assert [size_of(x) for x in (
        PNG, b"GIF89a\x05\x00\x06\x00", jpeg, webp, b"abc", b"", None, PNG[:18],
    )] == [(30, 20), (5, 6), (9, 7), (5, 6), None, None, None, None]


def test_order_and_plans(spark):
    from tessera.plans import runs

    rows = spark.createDataFrame([(2, 0), (1, 1), (1, 0), (0, 5)], "ordinal int, rollout_index int")
    assert [tuple(r) for r in runs.ordered_bundles(rows).collect()] == [(0, 5), (1, 0), (1, 1), (2, 0)]
    assert [r.ordinal for r in runs.first_examples(rows, 1, "ordinal").collect()] == [0]
    prompts = spark.createDataFrame([(0, "p"), (1, "q")], "prompt_row int, prompt string")
    taken = rows.select(F.least(F.col("ordinal"), F.lit(1)).alias("prompt_row"), "rollout_index")
    assert sorted(r.prompt for r in runs.gathered(taken, prompts).collect()) == ["p", "q", "q", "q"]
    with pytest.raises(Exception, match="no prompt"):
        runs.gathered(rows.select(F.col("ordinal").alias("prompt_row")), prompts.limit(1)).collect()
    cells = spark.createDataFrame([("d", "t", "all", "s")], "dataset string, split string, filter_id string, strategy string")
    runs.check_plan(cells, cells)
    with pytest.raises(ValueError):
        runs.check_plan(cells, cells.limit(0))
    assert runs.missing_keys({"a"}, {"b", "a", "c"}) == ["b", "c"]


def test_stream_retries_add_nothing(spark, tmp_path):
    from tessera.streaming.scores import score_stream

    schema = "sample_id string, rollout_index int, top_k int, shard_id string, generated_text string"
    rows = spark.createDataFrame([("a", 0, None, "s", r"\boxed{1}"), ("a", 1, None, "s", "x"), ("b", 0, 5, "t", r"\boxed{2}")], schema)
    rows.write.parquet(str(tmp_path / "in"))
    examples = spark.createDataFrame(
        [("a", "q", "1", "freeform"), ("b", "q", "3", "freeform")], "sample_id string, question string, ground_truth string, answer_type string",
    )
    for k, identity in enumerate((None, ["sample_id", "rollout_index", "top_k"])):
        for attempt in range(2):  # the second has lost the stream's offsets and meets all rows again
            score_stream(
                spark, str(tmp_path / "in"), examples, str(tmp_path / f"out{k}"), str(tmp_path / f"offsets{k}{attempt}"), ["sample_id"], "rules", "1",
                schema=rows.schema, identity=identity, shard="shard_id",
            ).awaitTermination()
        assert spark.read.parquet(str(tmp_path / f"out{k}")).count() == 3


def test_the_log_has_snapshots(spark, store, tmp_path, monkeypatch):
    """A snapshot stands for the files that are older; newer ones are read beside it; what a crash leaves in between counts as nothing."""
    import os
    import shutil

    for k in range(5):
        commits.commit_shard(store, f"s {k}+%", {"examples": spark.createDataFrame([filled(TABLES["examples"], run_id="r", sample_id=str(k))], TABLES["examples"])}, kind="examples")
    assert commits.snapshot(store, "core") is None
    first = commits.snapshot(store, "examples")
    for n in (tmp_path / "run/_commits/examples").iterdir():
        os.utime(n, (10**9, 10**9))  # far older than the snapshot: no longer opened
        n.write_bytes(n.read_bytes() if n.suffix == ".crc" else b"{}")
        os.utime(n, (10**9, 10**9))
    assert [c["shard"] for c in commits.commits(store, "examples")] == [f"s {k}+%" for k in range(5)]
    commits.commit_shard(store, "late", {"examples": spark.createDataFrame([filled(TABLES["examples"], run_id="r", sample_id="9")], TABLES["examples"])}, kind="examples", snapshot_every=1)
    assert commits._snapshots(store, "examples")[0] == first and len(commits._snapshots(store, "examples")) == 2
    shutil.copytree(tmp_path / f"run/_snapshots/examples/{first}", tmp_path / "run/_snapshots/examples/999999999999999-torn")  # died before its marker
    assert sorted(r.sample_id for r in commits.read_examples(store).collect()) == ["0", "1", "2", "3", "4", "9"]
    assert commits.verify(store, "examples").count() == 0 and commits.orphans(store) == []
    assert [r.sample_id for r in commits.read_shard(store, "examples", "s 3+%").collect()] == ["3"] and commits.read_shard(store, "examples", "x").count() == 0
    plan = commits.read_committed(store, "examples")._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "Parquet" in plan
    assert "PartitionFilters: [isnotnull(_part" in commits.read_shard(store, "examples", "late")._jdf.queryExecution().executedPlan().toString()


def test_footers_are_enough_for_rows_and_steps(spark, store, tmp_path):
    commits.commit_shard(store, "a", shard(spark, "a", [2, 3]), settings=commits.WriterSettings(level=9, row_group_bytes=1 << 20, dictionary=False))
    commits.commit_shard(store, "b", shard(spark, "b", [0]))
    assert commits.verify(store, content=False).count() == 0
    found = {r.part.split("-")[0]: (r.rows, r.min_step, r.max_step) for r in commits.footers(store, "tokens").collect()}
    assert found["a"] == (5, 1, 3) and found.get("b", (0, None, None)) == (0, None, None)
    import pyarrow.parquet as pq

    part = next(c for c in commits.commits(store) if c["shard"] == "a")["parts"]["tokens"]
    files = [tmp_path / "run" / part["path"] / f["name"] for f in part["files"]]
    group = next(pq.ParquetFile(f).metadata for f in files if pq.ParquetFile(f).metadata.num_rows).row_group(0)
    column = next(group.column(k) for k in range(group.num_columns) if group.column(k).path_in_schema == "step")
    assert column.compression == "ZSTD" and column.statistics.has_min_max and not any("DICT" in e for e in column.encodings)
    with pytest.raises(commits.CommitError):
        commits.WriterSettings(compression="snappy", level=3).options()
    # data pages that are overwritten: footers still tell the rows, hashes tell the change
    data = bytearray(files[0].read_bytes())
    data[4] ^= 255
    files[0].write_bytes(bytes(data))
    (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)
    assert commits.verify(store, content=False).count() == 0
    assert [r.what for r in commits.verify(store).where("what like 'file:%'").collect()] == [f"file:{files[0].name}"]


def test_loose_files_are_found_at_any_depth(spark, store, tmp_path):
    commits.commit_shard(store, "a", shard(spark, "a", [1]))
    part = commits.commits(store)[0]["parts"]["tokens"]["path"]
    inside, beside = tmp_path / "run" / part / "deep/extra.bin", tmp_path / "run/data/tokens/stray.tmp"
    inside.parent.mkdir()
    inside.write_text("x")
    beside.write_text("y")
    assert {r.name for r in commits.loose_files(store).collect()} == {f"{part}/deep/extra.bin", "data/tokens/stray.tmp"}
    assert commits.orphans(store) == sorted([f"{part}/deep/extra.bin", "data/tokens/stray.tmp"])
    commits.quarantine(store)
    assert commits.orphans(store) == [] and commits.verify(store).count() == 0 and not inside.exists() and not beside.exists()


def test_a_stream_reads_no_scores_while_it_has_its_offsets(spark, tmp_path, monkeypatch):
    """State tells what has been met: rows that come again in later files are left out without reading the target, and a batch that is run again overwrites itself."""
    from tessera.operators import scoring
    from tessera.streaming.scores import score_stream

    schema, asked = "sample_id string, rollout_index int, generated_text string", []
    monkeypatch.setattr(scoring, "pending", lambda *a: asked.append(a) or a[0])
    examples = spark.createDataFrame([("a", "q", "1", "freeform")], "sample_id string, question string, ground_truth string, answer_type string")

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        score_stream(spark, str(tmp_path / "in"), examples, str(tmp_path / "out"), str(tmp_path / "offsets"), ["sample_id"], "rules", "1", schema=spark.createDataFrame([], schema).schema).awaitTermination()
        return sorted((r.rollout_index is None, r.rollout_index) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run([("a", 0, "x"), ("a", 1, "y"), ("a", None, "z")]) == [(False, 0), (False, 1), (True, None)]
    assert run([("a", 1, "y"), ("a", 2, "y"), ("a", None, "z")]) == [(False, 0), (False, 1), (False, 2), (True, None)] and asked == []
    last = sorted((tmp_path / "offsets/commits").iterdir())
    for path in [p for p in last if p.name.strip(".").split(".")[0] == max(q.name for q in last if q.name.isdigit())]:
        path.unlink()  # died after the scores were written: the batch is run again
    assert run([("a", 3, "y")]) == [(False, 0), (False, 1), (False, 2), (False, 3), (True, None)] and asked == []
