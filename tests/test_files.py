"""Files as streams, stored tables as a data source, times with zones."""

import hashlib
import os
import shutil
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tessera.functions import times
from tessera.plans import commits
from tessera.sources import datasets, files, stored
from tests.test_storage import shard


def test_hashes_are_those_of_the_files(spark, tmp_path):
    made = {"a.bin": b"", "b c%20.bin": b"x" * 100_000, "d.gz": b"no gzip at all", "ü/e.bin": bytes(range(256)) * 50}
    for name, data in made.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = {os.path.basename(r.path): (r.length, r.sha256) for r in files.hashed(files.walked(spark, f"file://{tmp_path}")).collect()}
    assert found == {os.path.basename(n): (len(d), hashlib.sha256(d).hexdigest()) for n, d in made.items()}
    assert {os.path.basename(r.path) for r in datasets.source_hashes(spark, str(tmp_path), "*.bin").collect()} == {"a.bin", "b c%20.bin", "e.bin"}


def test_hashing_a_large_file_takes_a_chunk_of_memory(spark, tmp_path):
    """Three GB, beyond what one value of Spark can hold; the workers stay small."""
    with open(tmp_path / "large.bin", "wb") as out:
        out.truncate(3 << 30)
    state, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(3 << 6):
        state.update(zeros)
    assert files.sha256(str(tmp_path / "large.bin")) == state.hexdigest()
    row = files.hashes(spark, str(tmp_path)).first()
    assert (row.length, row.sha256) == (3 << 30, state.hexdigest())


def test_paths_of_stores():
    assert files.located("file:/a b")[1] == files.located("file:///a b")[1] == "/a b"
    assert files.located("/a:/b")[1] == "/a:/b"
    with pytest.raises(ValueError, match="no stream"):
        files.located("unknown://host/a")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A store of three shards, and a commit of a fourth that a copy may take."""
    path = tmp_path_factory.mktemp("made")
    store = commits.Store(spark, f"file://{path}")
    for name, lengths in (("a", [2, 3]), ("b", [1]), ("c%d", [2, 0]), ("late", [4])):
        commits.commit_shard(store, name, shard(spark, name, lengths))
    shutil.move(path / "_commits/core/late.json", path / "late")
    stored.register(spark)
    return path


@pytest.fixture
def filled(spark, made, tmp_path):
    shutil.copytree(made, tmp_path / "run store")
    return commits.Store(spark, f"file://{tmp_path}/run store")


def source(spark, store, table, **options):
    return spark.read.format("tessera").options(table=table, **options).load(store.root)


def test_the_source_gives_committed_rows(spark, filled):
    for table in ("generations", "tokens", "token_attention_metrics"):
        want, found = commits.read_committed(filled, table), source(spark, filled, table)
        assert found.schema.names == want.schema.names
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    few = source(spark, filled, "tokens", columns="shard_id, step")
    assert few.columns == ["shard_id", "step"] and few.count() == 8
    with pytest.raises(Exception, match="option table"):
        source(spark, filled, "none")


def test_a_filter_on_the_shard_opens_one_commit(spark, filled, tmp_path):
    """The other shards' commits and parts are unreadable, and nothing of them is asked for."""
    for folder, _, names in os.walk(tmp_path / "run store"):
        for n in names:
            if n == "b.json" or (n.endswith(".parquet") and "_part=b-" in folder):
                (open(os.path.join(folder, n), "w")).write("{}")
    rows = source(spark, filled, "tokens")
    assert sorted(r.step for r in rows.where("shard_id = 'a' and step >= 2").collect()) == [2, 2, 3]
    assert rows.where(F.col("shard_id").isin("c%d", "none")).count() == 2
    assert rows.where("shard_id = 'a' and shard_id = 'c%d'").count() == 0


def test_the_source_takes_snapshots_and_newer_commits(spark, filled, monkeypatch):
    commits.snapshot(filled)
    filled.create("_commits/core/late.json", filled.read("late"))
    assert source(spark, filled, "tokens").groupBy("shard_id").count().count() == 4
    monkeypatch.setattr(stored, "PARTITION_BYTES", 1)
    reader = stored.StoredReader(filled.root, "tokens", source(spark, filled, "tokens").schema)
    rows = [b.num_rows for p in reader.partitions() for b in reader.read(p)]
    assert sum(rows) == 12 and len(reader.partitions()) > 4


def test_torn_commits_and_foreign_parts(spark, filled):
    filled.create("_commits/core/torn.json", '{"shard": "torn"')
    assert source(spark, filled, "tokens").count() == 8
    filled.create("_commits/core/out.json", '{"shard": "out", "parts": {"tokens": {"path": "../other", "files": []}}}')
    with pytest.raises(Exception, match="outside of its table"):
        source(spark, filled, "tokens").count()


def test_times_need_a_zone(spark):
    texts = ["2024-01-02T03:04:05Z", "2024-01-02 03:04+0530", "1969-12-31T23:59:59.5-08", "2024-02-29T00:00:00.000001+00:00", "0001-01-01T00:00:00Z", "2024-03-31T02:30:00Z"]
    refused = ["2024-01-02T03:04:05", "2024-02-30T00:00:00Z", "2024-01-02", "", " 2024-01-02T03:04:05Z", "2024-01-02T25:00:00Z", "2024-01-02T03:04:05Z\n", "1704164645"]
    for zone in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            rows = spark.createDataFrame([(t,) for t in [*texts, *refused, None]], "t string")
            found = [r.w for r in rows.select(times.iso(times.instant(F.col("t"))).alias("w")).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert found[: len(texts)] == [datetime.fromisoformat(t).astimezone(timezone.utc).isoformat() for t in texts]
        assert found[len(texts):] == [None] * (len(refused) + 1)
    assert rows.where("t is null").select(times.zoned(F.col("t")).alias("z")).first().z is None
    with pytest.raises(Exception, match="no time with a zone"):
        rows.where("t = '2024-01-02'").select(times.zoned(F.col("t"))).collect()
