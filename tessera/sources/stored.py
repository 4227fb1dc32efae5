"""Stored tables as a data source: ``spark.read.format("tessera").option("table", "tokens").load(root)``.

The partitions are planned from the commit log: a filter on the shard's column opens that shard's commit file and no
other, without a listing; otherwise the last snapshot of the log and the files that are newer. Files are opened by the
executors; filters on single columns pick row groups by their statistics. All filters are left to Spark as well.
Python data sources don't tell which columns are asked for, so ``columns`` names them where a few are wanted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.plans.commits import KINDS, OVERLAP, CommitError
from tessera.schema import TABLES
from tessera.session import ship
from tessera.sources.files import located

#: Bytes of files that one partition takes, and what opening a file counts for.
PARTITION_BYTES, OPEN_COST = 128 << 20, 4 << 20
#: Rows of a batch; rows may hold long arrays.
BATCH_ROWS = 1024

_COMPARED = {
    ds.EqualTo: lambda c, v: c == v, ds.GreaterThan: lambda c, v: c > v, ds.GreaterThanOrEqual: lambda c, v: c >= v,
    ds.LessThan: lambda c, v: c < v, ds.LessThanOrEqual: lambda c, v: c <= v, ds.In: lambda c, v: c.isin(list(v)),
}


@dataclass
class Files(ds.InputPartition):
    """Files of committed parts: path, and which slice of its row groups of how many."""

    pieces: list[tuple[str, int, int]]


def _record(system: pafs.FileSystem, name: str) -> dict | None:
    """A commit record; None for what isn't there, and for an attempt that died."""
    try:
        with system.open_input_stream(name, compression=None) as stream:
            return json.loads(stream.read())
    except FileNotFoundError:
        return None
    except ValueError:
        return None


def _log(system: pafs.FileSystem, root: str, kind: str) -> Iterator[dict]:
    """All commit records: the last snapshot's, and those of files that may be newer, which win."""
    folder = lambda name: system.get_file_info(pafs.FileSelector(f"{root}/{name}", allow_not_found=True))
    done = sorted(f.base_name.removesuffix(".done") for f in folder(f"_snapshots/{kind}") if f.base_name.endswith(".done"))
    since, seen = datetime.fromtimestamp(0, timezone.utc), set()
    if done:
        since = datetime.fromtimestamp(int(done[-1].split("-")[0]) / 1000, timezone.utc) - OVERLAP
    for f in folder(f"_commits/{kind}"):
        if f.base_name.endswith(".json") and (f.mtime is None or f.mtime >= since):
            found = _record(system, f.path)
            if found:
                seen.add(found["shard"])
                yield found
    if done:
        rows = pads.dataset(f"{root}/_snapshots/{kind}/{done[-1]}", filesystem=system, format="parquet")
        for batch in rows.to_batches(columns=["shard", "record"], batch_size=BATCH_ROWS):
            yield from (json.loads(r["record"]) for r in batch.to_pylist() if r["shard"] not in seen)


class StoredReader(ds.DataSourceReader):
    def __init__(self, root: str, table: str, schema: StructType):
        self.root, self.table, self.wanted = root.rstrip("/"), table, schema
        self.kind = next(k for k, tables in KINDS.items() if table in tables)
        self.shards: set[str] | None = None
        self.compared: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        shard = {"core": "shard_id", "scores": "score_shard_id"}.get(self.kind)
        for f in filters:
            if type(f) in _COMPARED and len(f.attribute) == 1:
                name, value = f.attribute[0], f.value
                if name == shard and isinstance(f, (ds.EqualTo, ds.In)):
                    named = {v for v in (value if isinstance(f, ds.In) else [value]) if v is not None}
                    self.shards = named if self.shards is None else self.shards & named
                if all(isinstance(v, (str, int)) for v in (value if isinstance(f, ds.In) else [value])):
                    self.compared.append((type(f), name, value))
            yield f

    def _records(self) -> Iterator[dict]:
        system, root = located(self.root)
        if self.shards is None:
            yield from _log(system, root, self.kind)
        else:
            yield from (r for r in (_record(system, f"{root}/_commits/{self.kind}/{s}.json") for s in sorted(self.shards)) if r)

    def partitions(self) -> list[Files]:
        made, held, room = [], [], 0
        for record in self._records():
            part = record["parts"][self.table]
            if not re.fullmatch(rf"data/{self.table}/_part=[^/]+", part["path"]):
                raise CommitError(f"commit {record['shard']} names a part outside of its table: {part['path']}")
            for f in part["files"]:
                slices = -(-f["length"] // PARTITION_BYTES) or 1
                for k in range(slices):
                    cost = f["length"] // slices + OPEN_COST
                    if held and room + cost > PARTITION_BYTES + OPEN_COST:
                        made.append(Files(held))
                        held, room = [], 0
                    held.append((f"{self.root}/{part['path']}/{f['name']}", k, slices))
                    room += cost
        return [*made, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.wanted)
        tests = [_COMPARED[kind](pc.field(name), value) for kind, name, value in self.compared]
        keep = reduce(lambda a, b: a & b, tests) if tests else None
        for path, k, slices in partition.pieces:
            system, name = located(path)
            fragment = pads.ParquetFileFormat().make_fragment(name, filesystem=system)
            groups = [g for g in range(fragment.metadata.num_row_groups) if g * slices // fragment.metadata.num_row_groups == k]
            if groups:
                found = fragment.subset(row_group_ids=groups).to_batches(columns=target.names, filter=keep, batch_size=BATCH_ROWS)
                yield from (b for rows in found if rows.num_rows for b in pa.Table.from_batches([rows]).cast(target).to_batches())


class StoredTables(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera"

    def schema(self) -> StructType:
        table = self.options.get("table", "")
        if table not in TABLES:
            raise ValueError(f"option table: {table!r} is none of {sorted(TABLES)}")
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return StructType([TABLES[table][c] for c in wanted]) if wanted else TABLES[table]

    def reader(self, schema: StructType) -> StoredReader:
        return StoredReader(self.options["path"], self.options["table"], schema)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed to Python data sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark).dataSource.register(StoredTables)
