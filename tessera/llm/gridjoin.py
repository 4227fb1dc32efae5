"""Embedding near-duplicates by an epsilon grid order join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, in_arrow, key_runs

#: Principal dimensions that the grid is laid over.
AXES = 4
#: Vectors of the sample (by a hash of vec_id) that the principal dimensions are taken from, and of their
#: components those that are looked at; they decide how much is skipped, never what is found.
SAMPLE, COMPONENTS = 20_000, 1024
#: Vectors of a block, the leaf of the interval tree, and bytes of a block of long vectors.
BLOCK, BLOCK_BYTES = 1024, 1 << 22
#: So many consecutive blocks meet so many others in one task, a tile.
TILE = 8
#: Intervals joined into one of the next level: a power of two.
FAN_BITS = 3

BLOCKS = "label long, dim int, task long, seq long, reps array<long>, copies array<long>, data binary, " + ", ".join(f"lo{k} double, hi{k} double" for k in range(AXES))


def _axes(classes: DataFrame, dim: int) -> np.ndarray:
    """The leading principal directions of a bounded sample of unit vectors, from sums of products made by the executors; orthonormal in any case."""
    n, seen = max(1, classes.count()), min(dim, COMPONENTS)
    some = classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, SAMPLE / n)))).select("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, products = 0, np.zeros(seen), np.zeros((seen, seen))
        for batch in batches:
            x = _scaled(batch.column(0), dim)
            x = (x / np.linalg.norm(x, axis=1)[:, None])[:, :seen]
            count, total, products = count + len(x), total + x.sum(0), products + x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array([count], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([products.tobytes()], pa.binary())],
            names=["n", "total", "products"],
        )

    rows = some.repartition(8).transform(in_arrow, run, "n long, total binary, products binary").collect()  # eight matrices
    count = sum(r.n for r in rows)
    if count < 2:
        return np.eye(dim, min(AXES, dim))
    mean = sum(np.frombuffer(r.total) for r in rows) / count
    covariance = sum(np.frombuffer(r.products).reshape(seen, seen) for r in rows) / count - np.outer(mean, mean)
    out = np.zeros((dim, min(AXES, seen)))
    out[:seen] = np.linalg.eigh(covariance)[1][:, ::-1][:, :AXES]
    return out


def _scaled(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors, each times a power of two that brings its largest component to 0.5 to 1, so that no square leaves the doubles."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


def _placed(classes: DataFrame, axes: np.ndarray, dim: int, epsilon: float) -> DataFrame:
    """The coordinates of each class on the axes and its grid cell."""
    width = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _scaled(batch.column(3), dim)
            y = np.zeros((batch.num_rows, AXES))
            y[:, :width] = (data / np.linalg.norm(data, axis=1)[:, None]) @ axes
            cells = np.floor(y / epsilon).astype(np.int32)
            packed = pa.array([d.tobytes() for d in data], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], packed, *[pa.array(cells[:, k]) for k in range(AXES)], *[pa.array(y[:, k]) for k in range(AXES)]],
                names=["label", "rep", "copies", "data", *[f"c{k}" for k in range(AXES)], *[f"y{k}" for k in range(AXES)]],
            )

    schema = "label long, rep long, copies long, data binary, " + ", ".join([f"c{k} int" for k in range(AXES)] + [f"y{k} double" for k in range(AXES)])
    return classes.where(F.col("dim") == dim).select("label", "rep", "copies", "embedding").transform(in_arrow, run, schema)


def _blocks(placed: DataFrame, dim: int) -> DataFrame:
    """Consecutive vectors in epsilon grid order, ``BLOCK`` in a row, with their bounding box."""
    order, size = ["label", *[f"c{k}" for k in range(AXES)], "rep"], max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, dim))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held = TaskContext.get().partitionId(), 0, None

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            y = [t.column(f"y{k}").to_numpy() for k in range(AXES)]
            row = {
                "label": t.column("label")[0].as_py(), "dim": dim, "task": task, "seq": seq, "reps": t.column("rep").to_pylist(),
                "copies": t.column("copies").to_pylist(), "data": b"".join(t.column("data").to_pylist()),
            }
            row |= {f"lo{k}": float(v.min()) for k, v in enumerate(y)} | {f"hi{k}": float(v.max()) for k, v in enumerate(y)}
            seq += 1
            kinds = {
                "label": pa.int64(), "dim": pa.int32(), "task": pa.int64(), "seq": pa.int64(), "reps": pa.list_(pa.int64()),
                "copies": pa.list_(pa.int64()), "data": pa.binary(),
            }
            names = [*kinds, *[f"{s}{k}" for k in range(AXES) for s in ("lo", "hi")]]
            return pa.RecordBatch.from_arrays([pa.array([row[c]], kinds.get(c, pa.float64())) for c in names], names=names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None or not held.num_rows else pa.concat_tables([held, table])
            runs = key_runs(held.column("label").to_numpy())
            for a, b in zip(runs[:-1], runs[1:]):
                last = b == held.num_rows
                while b - a >= size or (b > a and not last):
                    yield block(held.slice(a, min(size, b - a)))
                    a += min(size, b - a)
                rest = a
            held = held.slice(rest).combine_chunks()
        if held is not None and held.num_rows:
            yield block(held)

    made = cut(placed.repartitionByRange(*order).sortWithinPartitions(*order).transform(in_arrow, run, BLOCKS))
    # blocks are numbered on from task to task, so that the tree goes over the whole sequence
    sizes = {r.task: r.n for r in made.groupBy("task").agg(F.max("seq").alias("n")).collect()}  # a row for each task
    before, shifts = 0, []
    for task in sorted(sizes):
        shifts.append((task, before))
        before += sizes[task] + 1
    shift = made.sparkSession.createDataFrame(shifts, "task long, _shift long")
    return made.join(F.broadcast(shift), "task").withColumn("seq", F.col("seq") + F.col("_shift")).drop("_shift", "task")


def _near(epsilon: float) -> Column:
    """The bounding boxes of two intervals are within epsilon."""
    gap = [F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")) for k in range(AXES)]
    return sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= epsilon * epsilon + 1e-9


def _leaf_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """``dim``, ``a``, ``b``: numbers of the pairs of blocks that can't be skipped, each pair once.

    The sequence of all blocks is a tree of intervals. From its root on, pairs of intervals with distant
    boxes are dropped and the others are replaced by the pairs of their children, so the work follows the
    pairs that stay, not all pairs of blocks. An interval has one row for each label in it.
    """
    boxes = [F.min(f"lo{k}").alias(f"lo{k}") for k in range(AXES)] + [F.max(f"hi{k}").alias(f"hi{k}") for k in range(AXES)]
    sides = [f"{s}{k}" for k in range(AXES) for s in ("lo", "hi")]
    leaves = cut(blocks.select("label", "dim", "seq", *sides))
    height = max(0, ((leaves.agg(F.max("seq")).first()[0] or 0).bit_length() + FAN_BITS - 1) // FAN_BITS)

    def level(h: int) -> DataFrame:
        nodes = leaves.groupBy("label", "dim", F.shiftright("seq", FAN_BITS * h).alias("seq")).agg(*boxes) if h else leaves
        return nodes.select(F.col("seq").alias("id"), F.shiftright("seq", FAN_BITS).alias("parent"), "label", "dim", *sides)

    same = (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim"))
    root = level(height)
    pairs = root.select("label", "dim", F.col("id").alias("a"), F.col("id").alias("b"))
    for h in reversed(range(height)):
        nodes = level(h)
        first = pairs.select("label", "dim", F.col("a").alias("pa"), F.col("b").alias("pb")).alias("p")
        left = first.join(nodes.alias("a"), (F.col("p.pa") == F.col("a.parent")) & (F.col("p.label") == F.col("a.label")) & (F.col("p.dim") == F.col("a.dim")))
        both = left.join(nodes.alias("b"), (F.col("p.pb") == F.col("b.parent")) & same & (F.col("a.id") <= F.col("b.id")) & _near(epsilon))
        pairs = both.select("a.label", "a.dim", F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    return pairs.select("dim", "a", "b")


def _tiles(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (dim, ta, tb, id, pairs, reps, copies, data), dealt and sorted by the first four: first a tile's pairs of blocks, then its blocks.

    A tile has the pairs of ``TILE`` consecutive blocks with ``TILE`` others, and each block travels once
    for each tile that it is in, not for each pair.
    """
    tiled = cut(pairs.withColumn("ta", F.floor(F.col("a") / TILE)).withColumn("tb", F.floor(F.col("b") / TILE)))
    lists = tiled.groupBy("dim", "ta", "tb").agg(F.flatten(F.collect_list(F.array("a", "b"))).alias("pairs"))  # twice TILE * TILE numbers at most
    members = tiled.select("dim", "ta", "tb", F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = members.join(blocks.select("dim", F.col("seq").alias("id"), "reps", "copies", "data"), ["dim", "id"])
    none = lambda t: F.lit(None).cast(t)
    rows = whole.select("dim", "ta", "tb", "id", none("array<long>").alias("pairs"), "reps", "copies", "data").unionByName(
        lists.select(
            "dim", "ta", "tb", F.lit(-1).cast("long").alias("id"), "pairs", none("array<long>").alias("reps"), none("array<long>").alias("copies"),
            none("binary").alias("data"),
        )
    )
    return rows.repartition("dim", "ta", "tb").sortWithinPartitions("dim", "ta", "tb", "id")


def _compare(cosine: float):
    """Links between the blocks of each tile's pairs, or within one: for each vector their number, and a forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple[int, int]] = []
        held: dict[int, tuple] = {}  # the blocks of the tile so far
        for batch in batches:
            for i in range(batch.num_rows):
                dim, number = batch.column(0)[i].as_py(), batch.column(3)[i].as_py()
                if number < 0:
                    listed = batch.column(4)[i].as_py()
                    pairs, held = list(zip(listed[::2], listed[1::2])), {}
                    continue
                reps, copies = (np.array(batch.column(c)[i].as_py(), np.int64) for c in (5, 6))
                x = np.frombuffer(batch.column(7)[i].as_py(), np.float64).reshape(-1, dim)
                held[number] = (reps, copies, x, np.linalg.norm(x, axis=1))
                # a pair is compared when its later block has come
                for a, b in pairs:
                    if b == number:
                        yield from _links(held[a], held[b], a == b, cosine)

    return run


def _links(left: tuple, right: tuple, alone: bool, cosine: float) -> Iterator[pa.RecordBatch]:
    (ra, ca, a, na), (rb, cb, b, nb) = left, right
    near = (a @ b.T) / (na[:, None] * nb[None, :]) >= cosine
    if alone:
        np.fill_diagonal(near, False)
    if not near.any():
        return
    rows, columns = near.any(1), near.any(0)
    # least rep over the links, until nothing changes
    of_a, of_b, before = ra.copy(), rb.copy(), -1
    top = np.iinfo(np.int64).max
    while (now := int(of_a[rows].sum(dtype=np.float64))) != before:
        before = now
        of_b = np.minimum(of_b, np.where(near, of_a[:, None], top).min(0))
        of_a = np.minimum(of_a, np.where(near, of_b[None, :], top).min(1))
        if alone:
            of_a = of_b = np.minimum(of_a, of_b)
    links = [near @ cb] if alone else [near @ cb, ca @ near]
    sides = [(ra, rows, of_a)] if alone else [(ra, rows, of_a), (rb, columns, of_b)]
    reps = np.concatenate([r[m] for r, m, _ in sides])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(reps), pa.array(np.concatenate([o[m] for _, m, o in sides])),
            pa.array(np.concatenate([n[m] for n, (_, m, _) in zip(links, sides)]), pa.int64()),
        ],
        names=["a", "b", "n"],
    )


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding, label``.

    Vectors with the same label, not null, are linked at ``cosine`` or more, worked out in double
    precision. Vectors that are null, zero, or hold null or non-finite components link with nothing,
    nor do those without label or of another dimension. Equal vectors are one class, linked with each
    other, and are compared with others once. ``component_id`` is the smallest vec_id reachable, and
    ``kept`` says whether it is the row's own. Rows without vec_id have no links and are not kept;
    different vectors under one vec_id count as one node. No rows give no rows.

    Classes are sorted by their grid cells (of the size of the greatest distance of linked unit
    vectors) along the leading principal dimensions, cut into blocks, and joined interval by interval.
    """
    epsilon = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("long").alias("label"),
    )
    finite = F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)),
    ) & F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = rows.withColumn("sound", sound).withColumn("key", F.when(F.col("sound"), F.xxhash64("label", "embedding")))
    classes = cut(rows.where("sound").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"),
    ).withColumn("dim", F.size("embedding")))
    blocks = None
    for at, dim in enumerate(sorted(r.dim for r in classes.select("dim").distinct().collect()), 1):
        part = cut(_blocks(_placed(classes, _axes(classes, dim), dim, max(epsilon, 1e-6)), dim))
        blocks = part if blocks is None else blocks.unionByName(part)
        if at % 8 == 0:
            blocks = cut(blocks)
    singles = rows.where("not sound").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"),
    )
    if blocks is None:
        return singles
    found = cut(_tiles(_leaf_pairs(blocks, epsilon), blocks).transform(in_arrow, _compare(cosine), "a long, b long, n long"))
    parts = connected_components(found.select("a", "b")).select(F.col("node").alias("rep"), "component")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    named = classes.select(
        "label", "embedding", "rep", "copies", F.xxhash64("label", "embedding").alias("key"),
    ).join(parts, "rep", "left").join(counts, "rep", "left")
    named = named.select(
        "key", "label", "embedding", F.coalesce("component", "rep").alias("component_id"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    linked = rows.where("sound").join(named, ["key", "label", "embedding"]).select(
        "vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"),
    )
    return linked.unionByName(singles)
