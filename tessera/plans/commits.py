"""Shards of several tables published together: parts first, one commit file last.

A shard is readable when its commit file exists, and only the parts that the file names are read, so a
writer may die anywhere. All file operations go through Hadoop's file system, so any store that
Spark can write works; the commit file is created only if it isn't there.

The commit files are a log. It is read as a table by the executors: the last snapshot of it, which is
Parquet, and the files that are newer. Parts are directories ``_part=...`` of their table, so Spark prunes them as
partitions: by a join with the log, so that only committed ones are read, and by a filter.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from tessera.operators.constraints import Rule, check, duplicates
from tessera.plans.lineage import ensure_checkpoint_dir
from tessera.schema import CORE_TABLES, EXAMPLE_KEY, RESUME_KEY, ROLLOUT_KEY, SCORE_KEY, TABLES
from tessera.sources.files import hashes

#: Tables of a shard of each kind.
KINDS = {"core": CORE_TABLES, "scores": ("scores",), "examples": ("examples",)}


#: What a commit record says of its parts.
_PARTS = "parts map<string, struct<path: string, rows: long, keys: string, min_step: int, max_step: int, types: string, files: array<struct<name: string, length: long, sha256: string>>>>"
#: A file of the log is read beside a snapshot if it isn't older than the snapshot's newest by more than this: what was begun before may have ended later.
OVERLAP = timedelta(minutes=10)


class CommitError(RuntimeError):
    pass


@dataclass(frozen=True)
class WriterSettings:
    """How parts are written: codec and its level, bytes of a row group, dictionaries."""

    compression: str = "zstd"
    level: int | None = None
    row_group_bytes: int | None = None
    dictionary: bool | None = None

    def options(self) -> dict[str, str]:
        told = {
            "parquet.compression.codec.zstd.level": self.level, "parquet.block.size": self.row_group_bytes,
            "parquet.enable.dictionary": None if self.dictionary is None else str(self.dictionary).lower(),
        }
        if self.level is not None and self.compression != "zstd":
            raise CommitError("only zstd has levels here")
        return {"compression": self.compression} | {k: str(v) for k, v in told.items() if v is not None}


class Store:
    """Files below one directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def list(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a file that must not exist, under its own name and only if nobody else has: the store decides between writers.

        A writer that dies in between leaves a file that is no JSON; readers pass over it and :func:`quarantine` moves it away.
        """
        self.fs.mkdirs(self._path(name).getParent())
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:
            if "exist" in str(e).lower():
                raise CommitError(f"{name} exists") from None
            raise
        stream.write(bytearray(text.encode()))
        stream.close()

    def move(self, name: str, to: str) -> None:
        self.fs.mkdirs(self._path(to).getParent())
        if not self.fs.rename(self._path(name), self._path(to)):
            raise CommitError(f"{name} can't be moved")


def _lenient(kind: DataType) -> DataType:
    """The same type with nulls allowed inside; what comes from an expression may always be null to Spark."""
    if isinstance(kind, ArrayType):
        return ArrayType(_lenient(kind.elementType), True)
    return StructType([StructField(f.name, _lenient(f.dataType), True) for f in kind]) if isinstance(kind, StructType) else kind


def _has_null(kind: DataType) -> Callable[[Column], Column]:
    """Whether an element is null, or a field of it that must not be."""
    fields = [f.name for f in kind if not f.nullable] if isinstance(kind, StructType) else []
    return lambda x: reduce(lambda a, b: a | b, [x[n].isNull() for n in fields], x.isNull())


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns and types of a stored table; other or missing columns are an error, NaN too."""
    want = TABLES[table]
    if set(df.columns) != set(want.names):
        raise CommitError(f"{table}: columns differ by {sorted(set(df.columns) ^ set(want.names))}")
    out = df.select(*[F.col(f.name).cast(_lenient(f.dataType)).alias(f.name) for f in want])
    for f in want:
        if isinstance(f.dataType, ArrayType):
            out = out.withColumn(
                f.name,
                F.when(F.exists(f.name, _has_null(f.dataType.elementType)), F.raise_error(F.lit(f"null inside {table}.{f.name}"))).otherwise(F.col(f.name)),
            )
        if f.dataType.typeName() in ("float", "double"):
            out = out.withColumn(f.name, F.when(F.isnan(f.name), F.raise_error(F.lit(f"NaN in {table}.{f.name}"))).otherwise(F.col(f.name)))
        if not f.nullable:
            out = out.withColumn(f.name, F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"null in {table}.{f.name}"))).otherwise(F.col(f.name)))
    return out


def run_rules(run: dict, shard: str | None = None, kind: str = "core") -> list[Rule]:
    """Rules of one shard against its run (``run_id, dataset, split, strategy`` and, for a core shard, ``rollouts`` and the sampling fields): identity, shard column, sampling fields, rollout numbers."""
    own = [c for c in ("run_id", "dataset", "split", "strategy") if c in run]
    sampling = [c for c in ("temperature", "top_p", "top_k", "repetition_penalty") if c in run]
    column = "score_shard_id" if kind == "scores" else "shard_id"

    def differs(df: DataFrame, names: list[str]) -> DataFrame:
        """Rows that differ from the run in one of these columns, as the column's own type has the run's value."""
        same = [F.col(c).eqNullSafe(F.lit(run[c]).cast(df.schema[c].dataType)) for c in names]
        return df.where(~reduce(lambda a, b: a & b, same, F.lit(True)))

    tables = CORE_TABLES if kind == "core" else ("scores",)
    rules = [Rule(f"run_of_{t}", lambda x, t=t: differs(x[t], own)) for t in tables]
    if shard is not None:
        rules += [Rule(f"shard_of_{t}", lambda x, t=t: x[t].where(~F.col(column).eqNullSafe(F.lit(shard)))) for t in tables]
    if kind == "core":
        rules.append(Rule("sampling_of_run", lambda x: differs(x["generations"], sampling)))
        if "rollouts" in run:
            rules.append(Rule("rollouts_of_run", lambda x: x["generations"].where(F.col("rollout_index") >= run["rollouts"])))
    return rules


def _digest(table: str, columns: list[str]) -> Column:
    """Order-free digest of a table's keys, without the run's id."""
    keys = {"examples": EXAMPLE_KEY, "scores": SCORE_KEY}.get(table, RESUME_KEY)
    return F.coalesce(F.sum(F.xxhash64(*[c for c in keys if c in columns]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")


def _types(schema: StructType) -> str:
    """Names and types of columns in order; files don't keep whether nulls are allowed."""
    return hashlib.sha256(schema.simpleString().encode()).hexdigest()


def _files(spark: SparkSession, path: str | list[str], only: DataFrame | None = None) -> DataFrame:
    """``part``, ``name``, ``length``, ``sha256`` of the data files below tables or a part, or of the parts in ``only``; streamed where they are."""
    at = F.regexp_extract("path", "([^/]+)/([^/]+)$", 1), F.regexp_extract("path", "([^/]+)$", 1)
    return hashes(spark, path, "*.parquet", only).select(at[0].alias("part"), at[1].alias("name"), "length", "sha256")


def _step_range(written: DataFrame):
    return (F.min("step"), F.max("step")) if "step" in written.columns else (F.lit(None).cast("int"), F.lit(None).cast("int"))


def commit_shard(
    store: Store, shard: str, tables: dict[str, DataFrame], rules: list[Rule] | None = None, failure_injector: Callable[[str], None] | None = None, kind: str = "core", run: dict | None = None,
    settings: WriterSettings = WriterSettings(), snapshot_every: int = 1000,
) -> dict:
    """Validate, write and publish one shard; gives the commit record.

    ``kind`` is core, scores or examples. With ``run`` the shard is held against its run (:func:`run_rules`);
    a core shard's rows must all name ``shard``. The record has each part's rows, digest of keys, range of
    steps, types, and its files with length and SHA-256. ``failure_injector`` is called with the name of
    each stage before it, for tests of crashes. A failed attempt leaves parts that nothing refers to; see
    :func:`quarantine`. One commit in ``snapshot_every``, by a hash of its name, takes a snapshot of the log behind it.
    """
    stage = failure_injector or (lambda name: None)
    expected = KINDS[kind]
    if set(tables) != set(expected):
        raise CommitError(f"a {kind} shard has the tables {expected}")
    record = f"_commits/{kind}/{shard}.json"
    if store.exists(record):
        raise CommitError(f"shard {shard} is committed")
    stage("validate")
    rules = [*(rules or ()), *(run_rules(run, shard if kind == "core" else None, kind) if run else ())]
    if rules:
        broken = [r.rule for r in check(tables, rules).where("n_violations > 0").collect()]
        if broken:
            raise CommitError(f"shard {shard} breaks {broken}")
    attempt, parts = uuid.uuid4().hex[:12], {}
    for name in expected:
        stage(f"write:{name}")
        part = f"data/{name}/_part={quote(shard, safe='')}-{attempt}"
        conform(tables[name], name).write.mode("errorifexists").options(**settings.options()).parquet(f"{store.root}/{part}")
        stage(f"verify:{name}")
        written = store.spark.read.parquet(f"{store.root}/{part}")
        n, keys, first, last = written.agg(F.count(F.lit(1)), _digest(name, written.columns), *_step_range(written)).first()
        files = sorted((r["name"], r.length, r.sha256) for r in _files(store.spark, f"{store.root}/{part}").collect())
        parts[name] = {
            "path": part, "rows": n, "keys": keys, "min_step": first, "max_step": last, "types": _types(written.schema), "files": [dict(zip(("name", "length", "sha256"), f)) for f in files],
        }
    done = {"shard": shard, "kind": kind, "parts": parts, "created_at": datetime.now(timezone.utc).isoformat()}
    if kind == "core":
        done |= {
            "rollouts": parts["generations"]["rows"], "token_keys": parts["tokens"]["rows"], "min_step": parts["tokens"]["min_step"],
            "max_step": parts["tokens"]["max_step"],
        }
    stage("commit")
    store.create(record, json.dumps(done, sort_keys=True, indent=2))
    stage("after")
    if int(hashlib.sha256(shard.encode()).hexdigest(), 16) % snapshot_every == 0:
        snapshot(store, kind)
    return done


def _snapshots(store: Store, kind: str) -> list[str]:
    """Names of finished snapshots, the last one last."""
    return sorted(n.removesuffix(".done") for n in store.list(f"_snapshots/{kind}") if n.endswith(".done"))


def _newest(name: str) -> datetime:
    """When the newest file of a snapshot was written."""
    return datetime.fromtimestamp(int(name.split("-")[0]) / 1000, timezone.utc)


def log(store: Store, kind: str = "core") -> DataFrame:
    """``shard, record, written_at``: the commit records as text, from the last snapshot and the files that may be newer. Files that are no JSON are attempts that died and count as nothing."""
    empty = store.spark.createDataFrame([], "shard string, record string, written_at timestamp")
    if not store.exists(f"_commits/{kind}"):
        return empty
    reader, done = store.spark.read.option("pathGlobFilter", "*.json"), _snapshots(store, kind)
    if done:
        reader = reader.option("timeZone", "UTC").option("modifiedAfter", (_newest(done[-1]) - OVERLAP).strftime("%Y-%m-%dT%H:%M:%S"))
    files = reader.text(f"{store.root}/_commits/{kind}", wholetext=True).select("value", F.col("_metadata.file_modification_time").alias("written_at"))
    sound = files.select(F.get_json_object("value", "$.shard").alias("shard"), F.col("value").alias("record"), "written_at").where("shard is not null")
    if not done:
        return sound
    before = store.spark.read.schema(empty.schema).parquet(f"{store.root}/_snapshots/{kind}/{done[-1]}")
    return before.unionByName(sound).groupBy("shard").agg(F.max_by("record", "written_at").alias("record"), F.max("written_at").alias("written_at"))


def snapshot(store: Store, kind: str = "core") -> str | None:
    """Write the log as one table that stands for its files from now on; None without commits. It may die at any time, and several may be made at once: a snapshot counts when its marker is there."""
    rows = log(store, kind)
    newest = rows.agg(F.max(F.unix_millis("written_at"))).first()[0]
    if newest is None:
        return None
    name = f"{newest:015d}-{uuid.uuid4().hex}"
    # what comes between the two readings is newer than the name says, and is read from its file too
    rows.write.mode("errorifexists").parquet(f"{store.root}/_snapshots/{kind}/{name}")
    store.create(f"_snapshots/{kind}/{name}.done", "")
    return name


def commits(store: Store, kind: str = "core") -> list[dict]:
    """The commit records by shard, on the driver: for stores of few shards, and for looking at them. Everything else here takes :func:`log`."""
    found = [json.loads(r.record) for r in log(store, kind).select("record").collect()]
    for c in found:
        for table, part in c["parts"].items():
            if not re.fullmatch(rf"data/{table}/_part=[^/]+", part["path"]):
                raise CommitError(f"commit {c['shard']} names a part outside of its table: {part['path']}")
    return sorted(found, key=lambda c: c["shard"])


def declared(store: Store, kind: str = "core") -> DataFrame:
    """``shard, table, part, rows, keys, min_step, max_step, types, files`` of all committed parts, as their records have it. A part outside of its table's directory is an error."""
    record = F.from_json("record", _PARTS)
    rows = log(store, kind).select("shard", F.explode(record["parts"]).alias("table", "p"))
    inside = F.regexp_extract(F.col("p.path"), "^data/([^/]+)/_part=([^/]+)$", 1) == F.col("table")
    wrong = F.raise_error(F.concat_ws(" ", F.lit("commit"), "shard", F.lit("names a part outside of its table:"), "p.path")).cast("string")
    part = F.when(inside, F.regexp_extract("p.path", "([^/]+)$", 1)).otherwise(wrong)
    return rows.select("shard", "table", part.alias("part"), *[F.col(f"p.{n}").alias(n) for n in ("rows", "keys", "min_step", "max_step", "types", "files")])


def _kind_of(table: str) -> str:
    return next(k for k, tables in KINDS.items() if table in tables)


def _all_parts(store: Store, table: str, schema: StructType | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    """All rows below a table's directory, committed or not, with the directory's ``_part``; None if there is none."""
    if not any(n.startswith("_part=") for n in store.list(f"data/{table}")):
        return None
    fields = [*(schema or TABLES[table]).fields, StructField("_part", StringType())]
    return (spark or store.spark).read.schema(StructType(fields)).option("basePath", f"{store.root}/data/{table}").parquet(f"{store.root}/data/{table}")


def _committed(store: Store, table: str) -> DataFrame:
    """``_part`` of a table's committed parts, as Spark reads it from their directories."""
    rows = declared(store, _kind_of(table)).where(F.col("table") == table)
    return rows.select(F.url_decode(F.replace(F.regexp_extract("part", "^_part=(.*)$", 1), F.lit("+"), F.lit("%2B"))).alias("_part"))


def read_committed(store: Store, table: str) -> DataFrame:
    """All committed rows of a table. The parts that the log names are joined to the directories by partition, so others aren't read."""
    rows = _all_parts(store, table)
    if rows is None:
        return store.spark.createDataFrame([], TABLES[table])
    return rows.join(_committed(store, table), "_part", "left_semi").select(*TABLES[table].names)


def read_shard(store: Store, table: str, shard: str) -> DataFrame:
    """The committed rows of one shard: only the files of its part are read."""
    rows = _all_parts(store, table)
    if rows is None:
        return store.spark.createDataFrame([], TABLES[table])
    told = declared(store, _kind_of(table)).where((F.col("table") == table) & (F.col("shard") == shard)).select("part").collect()  # one at most
    return rows.where(F.col("_part").isin([unquote(r.part.removeprefix("_part=")) for r in told])).select(*TABLES[table].names)


def write_examples(store: Store, examples: DataFrame, shard: str = "examples") -> dict:
    """Store a run's examples, written and published in one step."""
    return commit_shard(store, shard, {"examples": examples}, [Rule("unique_examples", lambda t: duplicates(t["examples"], EXAMPLE_KEY))], kind="examples")


def read_examples(store: Store) -> DataFrame:
    """A run's examples; other types of columns and repeated keys are errors."""
    if declared(store, "examples").isEmpty():
        raise CommitError("no examples are committed")
    if _stored_types(store, "examples") != _types(TABLES["examples"]):
        raise CommitError("the stored examples have other columns or types")
    rows = read_committed(store, "examples")
    if not duplicates(rows, EXAMPLE_KEY).isEmpty():
        raise CommitError("the stored examples repeat a key")
    return rows


def _stored_types(store: Store, table: str) -> str:
    """Names and types of the columns that a table's files have, all footers merged."""
    path = f"{store.root}/data/{table}"
    return _types(StructType([f for f in store.spark.read.option("mergeSchema", True).option("basePath", path).parquet(path).schema if f.name != "_part"]))


def footers(store: Store, table: str) -> DataFrame:
    """``part, rows, min_step, max_step`` of all parts of a table, from the footers of its files: counts and bounds are pushed into the scan, so no data page is read."""
    schema = "part string, rows long, min_step int, max_step int"
    # the reader that takes aggregates is off by default; a session of its own doesn't change the caller's
    session = store.spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    rows = _all_parts(store, table, spark=session)
    if rows is None:
        return store.spark.createDataFrame([], schema)
    counted = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in zip(("min_step", "max_step"), _step_range(rows))])
    path = f"{_shared(store.spark)}/footers-{uuid.uuid4().hex}"
    counted.withColumnRenamed("_part", "part").write.parquet(path)
    return store.spark.read.schema(schema).parquet(path)


def _shared(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


_INVENTORY = "part string, table string, rows long, keys string, min_step int, max_step int, types string"


def inventory(store: Store, kind: str = "core", content: bool = True) -> DataFrame:
    """What is there of each committed part: ``part, table, rows, keys, min_step, max_step, types``. Rows and steps come from footers; keys, from one grouped scan a table, only with ``content``."""
    made = []
    for table in KINDS[kind]:
        rows = _all_parts(store, table)
        if rows is None:
            continue
        counted = footers(store, table).join(_committed(store, table).withColumnRenamed("_part", "part"), "part", "left_semi").where("rows > 0")
        if content:
            keys = rows.join(_committed(store, table), "_part", "left_semi").groupBy(F.col("_part").alias("part")).agg(_digest(table, TABLES[table].names).alias("keys"))
            counted = counted.join(keys, "part", "left")
        else:
            counted = counted.withColumn("keys", F.lit(None).cast("string"))
        made.append(counted.select(
            F.concat(F.lit("_part="), _quoted(F.col("part"))).alias("part"), F.lit(table).alias("table"), "rows", "keys", "min_step", "max_step", F.lit(_stored_types(store, table)).alias("types"),
        ))
    return reduce(DataFrame.unionByName, made) if made else store.spark.createDataFrame([], _INVENTORY)


def _quoted(part: Column) -> Column:
    """A part's name as its directory has it, see :func:`urllib.parse.quote`."""
    return F.replace(F.replace(F.replace(F.url_encode(part), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def verify(store: Store, kind: str = "core", content: bool = True) -> DataFrame:
    """``shard, table, what, declared, actual``: parts that differ from their commit in rows, keys, steps, types, or in a file's name, length or SHA-256. Without ``content`` only what footers and the listing tell: rows, steps, types."""
    names = ("rows", *(("keys",) if content else ()), "min_step", "max_step", "types")
    told = declared(store, kind)
    actual = inventory(store, kind, content).select("part", "table", *[F.col(n).alias(f"_{n}") for n in names])
    both = told.join(actual, ["part", "table"], "left").select(
        "shard", "table", F.explode(F.array(*[F.struct(
            F.lit(n).alias("what"), F.col(n).cast("string").alias("declared"), F.col(f"_{n}").cast("string").alias("actual"),
        ) for n in names])).alias("c")
    )
    # a part without rows isn't in the inventory: nothing of it can differ but its rows
    differ = both.select("shard", "table", "c.*").where("not (declared <=> actual) and not (actual is null and (declared in ('0') or what in ('keys', 'types')))")
    if not content:
        return differ
    named = told.select("shard", "table", "part", F.explode("files").alias("f")).select("shard", "table", "part", "f.name", F.concat_ws(" ", "f.length", "f.sha256").alias("declared"))
    # only files of committed parts are hashed
    folders = [f"{store.root}/data/{t}" for t in KINDS[kind] if store.list(f"data/{t}")]
    there = store.spark.createDataFrame([], "part string, name string, actual string")
    if folders:
        there = _files(store.spark, folders, told.select("part").distinct()).select("part", "name", F.concat_ws(" ", "length", "sha256").alias("actual"))
    hashed = named.join(there, ["part", "name"], "full")
    return differ.unionByName(hashed.where("not (declared <=> actual)").select(
        "shard", "table", F.concat(F.lit("file:"), F.col("name")).alias("what"), "declared", "actual",
    ))


def completed(store: Store) -> DataFrame:
    """Identities of committed rollouts, without their run's id; one that two shards hold is an error for the caller's rules."""
    return read_committed(store, "generations").select(*ROLLOUT_KEY[1:]).distinct()


def loose_files(store: Store) -> DataFrame:
    """``name``: data files below ``data``, at any depth, that no commit names. Spark lists them; contents aren't read."""
    if not store.list("data"):
        return store.spark.createDataFrame([], "name string")
    files = store.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{store.root}/data")
    there = files.select(F.regexp_extract("path", "/(data/.*)$", 1).alias("name"))
    kinds = [declared(store, kind) for kind in KINDS]
    named = [k.select(F.concat_ws("/", F.lit("data"), "table", "part", "f.name").alias("name")) for k in (d.select("table", "part", F.explode("files").alias("f")) for d in kinds)]
    return there.join(reduce(DataFrame.unionByName, named), "name", "left_anti")


def orphans(store: Store) -> list[str]:
    """Parts that no commit names, loose files inside of those that one does and beside them, and commit files of attempts that died. What is found comes to the driver, not what is in order, but for the names of the parts."""
    named = {f"data/{r.table}/{r.part}" for kind in KINDS for r in declared(store, kind).select("table", "part").collect()}
    present = {f"data/{t}/{d}" for t in store.list("data") for d in store.list(f"data/{t}")}
    inside = [r.name for r in loose_files(store).collect() if "/".join(r.name.split("/")[:3]) in named]
    torn = []
    for kind in KINDS:
        known = {r.shard for r in log(store, kind).select("shard").collect()}
        torn += [f"_commits/{kind}/{n}" for n in store.list(f"_commits/{kind}") if n.endswith(".json") and n.removesuffix(".json") not in known]
    return sorted([*(present - named), *inside, *torn])


def quarantine(store: Store) -> list[str]:
    """Move orphans aside; gives their names."""
    found = orphans(store)
    for name in found:
        store.move(name, f"_quarantine/{uuid.uuid4().hex[:8]}/{name}")
    return found


def append_failure(store: Store, failure: dict) -> str:
    """Record one failure as a file of canonical JSON, so that writers never share a file."""
    name = f"_failures/{uuid.uuid4().hex}.json"
    store.create(name, json.dumps(failure, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n")
    return name


def append_failures(store: Store, rows: DataFrame) -> None:
    """Record many failures, one line each, written where they are."""
    rows.write.mode("append").json(f"{store.root}/_failures/{uuid.uuid4().hex}")


def failures(store: Store) -> DataFrame:
    if not store.list("_failures"):
        return store.spark.createDataFrame([], "stage string, message string")
    return store.spark.read.option("recursiveFileLookup", True).json(f"{store.root}/_failures")
