"""Digests of groups of rows in order, in bounded memory."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import in_arrow


#: Where a block belongs: the partition and the number in it, and what it holds.
_PLACE = ("part", "number", "block")
#: Bytes of framed values that go on as one row.
BLOCK = 1 << 18


def _ends(batch: pa.RecordBatch, keys: int, at: tuple | None) -> Iterator[tuple[tuple, int, int, bool]]:
    """Runs of equal keys (the first ``keys`` columns) of a batch: key, begin, end, and whether it isn't the key ``at`` of the run before."""
    names = list(zip(*(c.to_pylist() for c in batch.columns[:keys]))) if keys else [()] * batch.num_rows
    begin = 0
    for i in range(1, len(names) + 1):
        if i == len(names) or names[i] != names[begin]:
            yield names[begin], begin, i, names[begin] != at
            at, begin = names[begin], i


def _framed(keys: int, place: list[str]):
    """Rows sorted by key and order as blocks: key, partition, number, and the compressed values, each behind its length; null for a null value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at, first, held = TaskContext.get().partitionId(), 0, None, None, bytearray()

        def block(data: bytes | None) -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays([*first.columns[:keys], *columns], names=[*first.schema.names[:keys], *place])

        for batch in batches:
            values = batch.columns[-1]
            for key, begin, end, new in _ends(batch, keys, at):
                if new:
                    if held:
                        yield block(zlib.compress(held, 1))
                        number, held = number + 1, bytearray()
                    at, first = key, batch.slice(begin, 1)
                for value in values.slice(begin, end - begin):
                    if value.is_valid:
                        data = value.as_buffer()
                        held += data.size.to_bytes(8, "big")
                        held += data
                    if not value.is_valid or len(held) >= BLOCK:
                        yield block(zlib.compress(held, 1) if value.is_valid else None)
                        number, held = number + 1, bytearray()
        if held:
            yield block(zlib.compress(held, 1))

    return run


def _digested(keys: int):
    """Blocks sorted by key and place: a hash state goes on through Arrow batches until the key changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, state = None, None, None

        def ended() -> pa.RecordBatch:
            digest = pa.array([state and state.hexdigest()], pa.string())
            return pa.RecordBatch.from_arrays([*first.columns[:keys], digest], names=[*first.schema.names[:keys], "digest"])

        for batch in batches:
            for key, begin, end, new in _ends(batch, keys, at):
                if new:
                    if first is not None:
                        yield ended()
                    at, first, state = key, batch.slice(begin, 1), hashlib.sha256()
                for data in batch.columns[-1].slice(begin, end - begin):
                    if state is not None and data.is_valid:
                        state.update(zlib.decompress(data.as_buffer()))
                    else:
                        state = None
        if first is not None:
            yield ended()

    return run


def ordered_digests(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """``by``, ``digest``: of each group the SHA-256 over its values in order, each behind its length in eight bytes.

    Rows of equal ``order`` come by value; a group with a null value has a null digest, and null keys are a
    group. All rows are put in order by ranges of key and order, so a group is sorted by many tasks, which
    hand on its values as compressed blocks; one task puts a group's blocks in order and streams them through
    a hash state. Such a digest is sequential: hashing one group is one task's work.
    """
    name = "value"
    while any(c.startswith(name) for c in by):
        name += "_"
    place = [f"{name}_{p}" for p in _PLACE]
    rows = df.select(*by, *[F.col(c).alias(f"{name}{k}") for k, c in enumerate(order)], F.col(value).cast("binary").alias(name))
    keys = [f"`{c}`" for c in by]
    columns = [*keys, *(f"{name}{k}" for k in range(len(order))), name]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    kinds = ", ".join(f"{n} {t}" for n, t in zip(place, ("int", "long", "binary")))
    blocks = rows.repartitionByRange(*(columns[:-1] or columns)).sortWithinPartitions(*columns).transform(in_arrow, _framed(len(by), place), f"{types}, {kinds}" if by else kinds)
    dealt = blocks.repartition(*keys) if by else blocks.coalesce(1)
    ordered = dealt.sortWithinPartitions(*keys, *place[:2])
    return ordered.transform(in_arrow, _digested(len(by)), f"{types}, digest string" if by else "digest string")
