"""Exact top-k search by inner product as a Voronoi join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, in_arrow, key_runs

#: Least and greatest number of pivots, which are taken from the data by a hash of vec_id; between, as many as the root of the vectors' number.
PIVOTS = (16, 4096)
#: Vectors of one chunk. Cells around one of fewer pivots are a unit of about one chunk; a larger unit has several, so a hot cell is shared out.
CHUNK = 16_384
#: Queries of one group that travel in one row.
QUERIES = 256
#: Numbers that are held at once while bounds are worked out.
NUMBERS = 2_000_000

ROWS = "unit int, chunk int, query boolean, n int, ids binary, bounds binary, cells binary, v binary"


def integer_vectors(vectors: DataFrame, scale: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """``vec_id, dim, v``: floor(scale * x) of each component; vectors that are null or not finite throughout are left out. Columns of ``keep`` stay.

    A component whose integer doesn't fit into 62 bits is an error.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *keep,
    ).where("vec_id is not null and embedding is not null").where(finite)
    whole = lambda x: F.when(F.abs(x * scale) < float(1 << 62), F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for integer products")).cast("long"))
    return rows.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", whole).alias("v"), *keep)


class Cells:
    """Pivots, and of each Voronoi cell a summary: its number of vectors, the distance of the farthest from the pivot, and those of the nearest."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.counts = self.radii = np.zeros(len(pivots))
        self.nearest_distances = np.full((len(pivots), 1), np.inf)

    def units(self) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each cell, and the number of chunks of each unit."""
        n = max(1, math.ceil(self.counts.sum() / CHUNK))
        coarse = Cells(self.pivots[np.random.default_rng(0).permutation(len(self.pivots))[:n]])
        unit, _ = coarse.of(self.pivots)
        return unit, np.maximum(1, np.ceil(np.bincount(unit, self.counts, len(coarse.pivots)) / CHUNK)).astype(np.int64)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its distance from the pivot."""
        cell = np.empty(len(x), np.int64)
        for at in range(0, len(x), max(1, NUMBERS // len(self.pivots))):
            part = x[at : at + max(1, NUMBERS // len(self.pivots))]
            cell[at : at + len(part)] = np.argmax(part @ self.pivots.T - (self.pivots**2).sum(1) / 2, 1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))

    def bounds(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The score that each query's k-th best reaches at least, its own vector aside, and which cells may hold a vector that reaches it.

        A vector at distance d from its pivot p has a product with q of q.p - |q| d to q.p + |q| d. So
        the summaries' nearest distances promise scores, of which the (k + 1)-th best is reached by k
        others, and the radius bounds what a cell can hold.
        """
        least, need = np.empty(len(q)), np.empty((len(q), len(self.pivots)), bool)
        size = max(1, NUMBERS // (len(self.pivots) * (k + 1)))
        for a in range(0, len(q), size):
            part = q[a : a + size]
            at, norm = part @ self.pivots.T, np.linalg.norm(part, axis=1)[:, None]
            slack = 1e-9 * (np.abs(at) + norm * np.linalg.norm(self.pivots, axis=1)[None, :]) + 1e-6
            promised = (at[:, :, None] - norm[:, :, None] * self.nearest_distances[None] * (1 + 1e-9) - slack[:, :, None]).reshape(len(part), -1)
            promised[np.isnan(promised)] = -np.inf
            least[a : a + size] = -np.partition(-promised, k, 1)[:, k] if promised.shape[1] > k else -np.inf
            need[a : a + size] = (self.counts > 0) & (at + norm * self.radii * (1 + 1e-9) + slack >= least[a : a + size, None])
        return least, need


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows as integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors, some at a time, of rows (vec_id, v)."""
    rows = max(1, min(4096, NUMBERS // max(1, dim)))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0).to_numpy(), _matrix(part.column(1), dim)


def _rows_of(units, chunks, query: bool, ids: list[bytes], bounds: list, cells: list[bytes], vectors: list[bytes]) -> pa.RecordBatch:
    n = [len(i) // 8 for i in ids]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(units, pa.int32()), pa.array(chunks, pa.int32()), pa.array([query] * len(ids)), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(bounds, pa.binary()),
            pa.array(cells, pa.binary()), pa.array(vectors, pa.binary()),
        ],
        names=["unit", "chunk", "query", "n", "ids", "bounds", "cells", "v"],
    )


def _data(vectors: DataFrame, cells: Cells, dim: int, kind) -> DataFrame:
    """Each vector in a chunk of its cell's unit."""
    unit_of, chunks = cells.units()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _parts(batches, dim):
            cell, _ = cells.of(x.astype(np.float64))
            unit = unit_of[cell]
            chunk = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % chunks[unit]
            order = np.lexsort((cell, chunk, unit))
            runs = key_runs(unit[order] << 32 | chunk[order])
            groups = [order[a:b] for a, b in zip(runs[:-1], runs[1:])]
            yield _rows_of(
                [unit[g[0]] for g in groups], [chunk[g[0]] for g in groups], False, [ids[g].tobytes() for g in groups], [None] * len(groups), [cell[g].astype(np.int32).tobytes() for g in groups],
                [x[g].astype(kind).tobytes() for g in groups],
            )

    return vectors.select("vec_id", "v").transform(in_arrow, run, ROWS)


def _groups(queries: DataFrame, cells: Cells, dim: int, k: int, kind) -> DataFrame:
    """Groups of queries of one cell, each with its bounds, in one row for each chunk of each unit that has a cell which one of them needs."""
    unit_of, chunks = cells.units()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _parts(batches, dim):
            cell, _ = cells.of(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(ids), pa.array([v.tobytes() for v in x.astype(np.int64)], pa.binary())],
                names=["cell", "vec_id", "v"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = key_runs(batch.column(0).to_numpy())
            for begin, end in zip(runs[:-1].tolist(), runs[1:].tolist()):
                for at in range(begin, end, QUERIES):
                    part = batch.slice(at, min(QUERIES, end - at))
                    ids = part.column(1).to_numpy()
                    x = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int64).reshape(len(ids), dim)
                    least, need = cells.bounds(x.astype(np.float64), k)
                    for unit in np.unique(unit_of[need.any(0)]).tolist():
                        inside = need & (unit_of == unit)
                        some, n = inside.any(1), int(chunks[unit])
                        row = (
                            ids[some].tobytes(), least[some].tobytes(), np.flatnonzero(inside.any(0)).astype(np.int32).tobytes(),
                            x[some].astype(kind).tobytes(),
                        )
                        yield _rows_of([unit] * n, list(range(n)), True, *([c] * n for c in row))

    dealt = cut(queries.select("vec_id", "v").transform(in_arrow, placed, "cell int, vec_id long, v binary"))
    # a hot cell's queries are dealt out, some groups to a task
    hot = [r.cell for r in dealt.groupBy("cell").count().where(F.col("count") > 16 * QUERIES).collect()]  # a row for each pivot at most
    salt = F.when(F.col("cell").isin(hot), F.pmod(F.xxhash64("vec_id"), F.lit(64))).otherwise(F.lit(0)) if hot else F.lit(0)
    return dealt.repartition("cell", salt).sortWithinPartitions("cell", "vec_id").transform(in_arrow, run, ROWS)


def _solve(dim: int, k: int, kind):
    """The k best of each query among the vectors of one chunk that are in cells which its group needs; rows come chunk by chunk, data first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, data, ids, cell = None, [], np.zeros((0, dim)), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for row, key in enumerate(keys):
                query, n, own, least, cells, x = (batch.column(c)[row].as_py() for c in range(2, 8))
                own, cells, x = np.frombuffer(own, np.int64), np.frombuffer(cells, np.int32), np.frombuffer(x, kind).reshape(n, dim)
                if key != at:
                    at, held, data, ids, cell = key, [], np.zeros((0, dim)), np.zeros(0, np.int64), np.zeros(0, np.int32)
                if not query:
                    held.append((x, own, cells))
                    continue
                if held:
                    data, ids, cell = (np.concatenate(c) for c in zip(*held))
                    held = []
                needed = np.isin(cell, cells)
                if needed.all() and len(ids):
                    yield _best(x, own, np.frombuffer(least), data, ids, k)
                elif needed.any():
                    yield _best(x, own, np.frombuffer(least), data[needed], ids[needed], k)

    return run


def _best(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> pa.RecordBatch:
    most = int(np.abs(q).max(initial=0)) * int(np.abs(data).max(initial=0)) * q.shape[1]
    # whole numbers that are exact as doubles, as longs, or as Python's
    kind, none = (np.float64, -np.inf) if most < 2**53 else (np.int64, np.iinfo(np.int64).min) if most < 2**63 else (object, -math.inf)
    scores = q.astype(kind) @ data.astype(kind).T
    own = q_ids[:, None] == ids[None, :]
    if kind is object and np.abs(scores[~own]).max(initial=0) >= 2**63:
        raise ArithmeticError("a product doesn't fit into a long")
    scores[own] = none
    top = np.sort(scores, 1)[:, -min(k, len(ids))] if kind is object else np.partition(scores, -min(k, len(ids)), 1)[:, -min(k, len(ids))]
    out: tuple[list, list, list] = ([], [], [])
    for i, q_id in enumerate(q_ids):
        near = np.flatnonzero((scores[i] >= max(top[i], least[i])) & (scores[i] > none))
        near = near[np.lexsort((ids[near], -scores[i][near]))[:k]]
        out[0].append(np.full(len(near), q_id))
        out[1].append(ids[near])
        out[2].append(scores[i][near].astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products, ties to the smaller vec_id.

    ``vectors`` and ``queries`` have ``vec_id``, ``dim``, ``v`` (see :func:`integer_vectors`). A query meets
    vectors of its dimension with another vec_id; with fewer than k of them it gets all. Vectors without
    components have products of 0. Rows with the same vec_id and vector count once. Products that don't
    fit into a long are an error. No vectors or no queries give no rows.

    Data and queries are grouped by pivots. Summaries of the data's cells bound the k-th best score of
    each query from below and what a cell can hold from above, so a group of queries is copied only to
    cells that one of them needs, with those of it that do, and each chunk of a cell is solved in one
    task. Of equal vectors the k + 1 smallest vec_ids can be in a result at most, so only these are kept;
    that is done before the shuffle too.
    """
    vectors = cut(vectors.dropDuplicates(["vec_id", "v"]).withColumn(
        "nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")),
    ).where(F.col("nth") <= k + 1).drop("nth"))
    queries = cut(queries.dropDuplicates(["vec_id", "v"]))
    found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    largest = lambda v: F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0))
    asked = {r.dim: r.most for r in queries.groupBy("dim").agg(F.max(largest(F.col("v"))).alias("most")).collect()}
    rows = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(largest(F.col("v"))).alias("most")).collect()
    for at, r in enumerate(sorted((r for r in rows if r.dim in asked), key=lambda r: r.dim), 1):
        kind = np.int32 if max(r.most, asked[r.dim]) < 1 << 31 else np.int64
        n = pivots or min(max(math.isqrt(r.n), PIVOTS[0]), PIVOTS[1])
        found = found.unionByName(_of_dimension(vectors.where(F.col("dim") == r.dim), queries.where(F.col("dim") == r.dim), r.dim, k, n, kind))
        if at % 8 == 0:
            found = cut(found)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def cells_of(vectors: DataFrame, dim: int, k: int, pivots: int) -> Cells:
    """The Voronoi cells of vectors of one dimension, and their summaries."""
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(pivots).collect()  # ``pivots`` rows
    cells = Cells(np.unique(np.array([r.v for r in chosen], np.float64).reshape(len(chosen), dim), axis=0) if dim else np.zeros((1, 0)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(cells.pivots)
        counts, radii, near = np.zeros(m, np.int64), np.zeros(m), [np.zeros(0)] * m
        for _, x in _parts(batches, dim):
            cell, far = cells.of(x.astype(np.float64))
            counts += np.bincount(cell, minlength=m)
            np.maximum.at(radii, cell, far)
            order = np.lexsort((far, cell))
            runs = key_runs(cell[order])
            for a, b in zip(runs[:-1], runs[1:]):
                c = cell[order[a]]
                near[c] = np.sort(np.concatenate([near[c], far[order[a : min(b, a + k + 1)]]]))[: k + 1]
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(radii[some]), pa.array([near[c] for c in some], pa.list_(pa.float64()))],
            names=["cell", "n", "radius", "near"],
        )

    parts = vectors.select("vec_id", "v").transform(
        in_arrow, measure, "cell int, n long, radius double, near array<double>",
    ).withColumn("part", F.spark_partition_id() % 64)
    for key in (["cell", "part"], ["cell"]):  # in two steps, so that no row holds the distances of all tasks
        parts = parts.groupBy(*key).agg(
            F.sum("n").alias("n"), F.max("radius").alias("radius"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"),
        )
    cells.counts, cells.radii = np.zeros(len(cells.pivots)), np.zeros(len(cells.pivots))
    cells.nearest_distances = np.full((len(cells.pivots), k + 1), np.inf)
    for r in parts.collect():  # a row for each pivot
        cells.counts[r.cell], cells.radii[r.cell] = r.n, r.radius
        cells.nearest_distances[r.cell, : len(r.near)] = r.near
    return cells


def _of_dimension(vectors: DataFrame, queries: DataFrame, dim: int, k: int, pivots: int, kind) -> DataFrame:
    cells = cells_of(vectors, dim, k, pivots)
    rows = _data(vectors, cells, dim, kind).unionByName(_groups(queries, cells, dim, k, kind))
    dealt = rows.repartition("unit", "chunk").sortWithinPartitions("unit", "chunk", "query")
    return dealt.transform(in_arrow, _solve(dim, k, kind), "query_id long, vec_id long, score long")
