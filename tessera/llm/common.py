"""Helpers shared by the training-data operators: lineage cuts, components, runs of keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, ensure_checkpoint_dir, written
from tessera.session import in_arrow, read_table

__all__ = [
    "Remembered", "connected_components", "cut", "edge_batch", "ensure_checkpoint_dir", "fresh", "in_arrow", "key_runs", "pieces", "read_table",
    "spanning_forest", "texts_of", "written",
]


#: Texts that a task has as Python strings at once; Arrow hands on some thousands.
TEXTS = 512


def spanning_forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges given, enough to join the same nodes: each node with the least of its tree.

    Memory is in proportion to the edges given, in arrays alone; callers pass one batch at a time.
    """
    nodes, places = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = places[: len(left)], places[len(left) :]
    least = np.arange(len(nodes))
    while len(nodes):
        least_of = np.minimum(least[a], least[b])
        now = least.copy()
        np.minimum.at(now, a, least_of)
        np.minimum.at(now, b, least_of)
        np.minimum.at(now, least, now)  # the one that a node was joined to joins what the node meets
        now = now[now]
        if (now == least).all():
            break
        least = now
    led = least != np.arange(len(nodes))
    return nodes[led], nodes[least[led]]


#: A graph of so many edges at most (16 bytes each) is joined by one task; a larger one by rounds of all.
SMALL_GRAPH = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the least node reachable) for the nodes of ``edges`` (``a``, ``b``: long).

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until nothing changes;
    each step is one combined minimum by node and one equi-join, which AQE splits where a hub is hot. As soon
    as ``SMALL_GRAPH`` edges are left or fewer, one task finishes.
    Loops and repeated edges are ignored, null ends are dropped, and no edges give no rows.
    """
    pairs = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    pairs, before = cut(pairs), None
    while True:
        now = _digest(pairs)
        if 0 < now[0] <= SMALL_GRAPH:
            return cut(pairs.coalesce(1).transform(in_arrow, _joined_at_once, "node long, component long"))
        if now == before or now[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).groupBy("node").agg(F.min("component").alias("component"))
        before = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("w").alias("v")), F.struct("u", F.col("w").alias("v")))).alias("e")
        )
        pairs = cut(small.select("e.u", "e.v").where("u != v").distinct())


def _joined_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node``, ``component`` of all edges given."""
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not ends:
        return
    a, b = (np.concatenate(x) for x in zip(*ends))
    nodes, least = spanning_forest(a, b)
    # the least node of each component is not among those that were joined to it
    rows = np.concatenate([nodes, np.unique(least)]), np.concatenate([least, np.unique(least)])
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["node", "component"])


def _digest(pairs: DataFrame) -> tuple:
    """Count and order-free digest; equal digests of two rounds end the loop."""
    h = F.xxhash64("u", "v")
    return tuple(
        pairs.agg(
            F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)),
            F.coalesce(F.sum((h % 2147483647).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")),
        ).first()
    )


class Remembered(dict):
    """What a task remembers of strings it has met, bounded by bytes: beyond ``most`` it begins anew; long strings aren't kept."""

    def __init__(self, most: int, each: int, longest: int = 64):
        super().__init__()
        self.most, self.each, self.longest, self.bytes = most, each, longest, 0

    def keep(self, key: str, value, parts: int = 1):
        """Remember ``value``, which holds ``parts`` strings as long as ``key`` at most (4 bytes a character), and return it."""
        if len(key) <= self.longest:
            self.bytes += self.each + 4 * len(key) * parts
            if self.bytes > self.most:
                self.clear()
                self.bytes = 0
            self[key] = value
        return value


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_runs(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal values, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def texts_of(column: pa.Array) -> list[str]:
    """The strings of an Arrow column, null as the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]


def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows`` at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
