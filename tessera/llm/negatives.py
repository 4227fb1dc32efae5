"""Hard negatives of anchor vectors: a full sort of each anchor's integer scores, block by block."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, in_arrow, key_runs
from tessera.llm.knn import integer_vectors

#: Vectors of one block; a block is held by one task, which meets all anchors of its dimension, group by group.
BLOCK = 16_384
#: Vectors that travel in one row, and scores that a task holds at once.
GROUP, SCORES = 256, 1 << 20

_ROWS = "dim int, block int, anchors boolean, ids binary, labels binary, v binary, limits binary"
_FOUND = ["anchor_id", "positive_id", "positive_score"]
_MINED = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]


def labelled_vectors(vectors: DataFrame, scale: int, label: Column | None = None) -> DataFrame:
    """``vec_id, label, dim, v``: floor(scale * x) of each component, one row for each vec_id.

    Rows with a null id, label or vector, or with a component that is null or not finite, are left out.
    Of rows with one vec_id the one of the least label counts, and of those the one of the least vector.
    ``label`` is made from the columns of ``vectors``; the column ``label`` if not given.
    """
    said = (F.col("label") if label is None else label).cast("long").alias("label")
    whole = integer_vectors(vectors.select("vec_id", "embedding", said).where("label is not null"), scale, keep=("label",))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "dim", "v")).alias("least")).select("vec_id", "least.*")


def _in_groups(anchors: bool, blocks: dict[int, int], limits: int):
    """Vectors (dim, block, vec_id, label, v, limits) in groups, as rows of bytes: data once, in its block; anchors once for each block of their dimension.

    An anchor's limits are triples (positive id, positive score, 1), ``limits`` of them, zeros where it has fewer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, block = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int64)
            order = np.argsort(dims << 32 | block, kind="stable")
            batch = batch.take(pa.array(order))
            runs = key_runs((dims << 32 | block)[order])
            for begin, end in zip(runs[:-1].tolist(), runs[1:].tolist()):
                for at in range(begin, end, GROUP):
                    part = batch.slice(at, min(GROUP, end - at))
                    dim, own = part.column(0)[0].as_py(), part.column(1)[0].as_py()
                    v = part.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    v = v.astype(np.int32) if np.abs(v).max(initial=0) < 1 << 31 else v
                    told = np.zeros((part.num_rows, limits, 3), np.int64)
                    for i, of in enumerate(part.column(5).to_pylist() if limits else ()):
                        for j, p in enumerate(of):
                            told[i, j] = p["positive_id"], p["positive_score"], 1
                    ids, labels = (part.column(c).to_numpy().tobytes() for c in (2, 3))
                    for b in range(blocks.get(dim, 0)) if anchors else [own]:
                        row = [dim], [b], [anchors], [ids], [labels], [v.tobytes()], [told.tobytes()]
                        kinds = pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["dim", "block", "anchors", "ids", "labels", "v", "limits"])

    return run


def _vectors(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * n * dim else np.int64).reshape(n, dim)


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` and ``x``, exact; one that doesn't fit a long is an error."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a.astype(np.int64) @ x.astype(np.int64).T
    made = a.astype(object) @ x.astype(object).T
    if np.abs(made).max(initial=0) >= 2**63:
        raise ArithmeticError("a product doesn't fit into a long")
    return made.astype(np.int64)


def _sorted_scores(read: Callable, names: list[str], limits: int):
    """Rows of a block, data first and groups of anchors behind it: what ``read`` finds in each anchor's scores, sorted by score and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            for row in range(batch.num_rows):
                dim, b, anchors, ids, labels, v, told = (c[row].as_py() for c in batch.columns)
                ids, labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                v = _vectors(v, len(ids), dim)
                if (dim, b) != at:
                    at, parts, block = (dim, b), [], None
                if not anchors:
                    parts.append((ids, labels, v))
                    continue
                if block is None and parts:
                    block, parts = [np.concatenate(p) for p in zip(*parts)], []
                if block is None:
                    continue
                told = np.frombuffer(told, np.int64).reshape(len(ids), limits, 3)
                step = max(1, SCORES // len(block[0]))
                for begin in range(0, len(ids), step):
                    scores = _scores(v[begin : begin + step], block[2])
                    made = []
                    for i, s in enumerate(scores, begin):
                        order = np.lexsort((block[0], -s))
                        made.append(read(ids[i], labels[i], s[order], block[0][order], block[1][order], told[i]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*made)], names=names)

    return run


def _positives(n: int) -> Callable:
    """The first ``n`` other rows of the anchor's label."""

    def read(anchor, label, scores, ids, labels, _):
        near = np.flatnonzero((labels == label) & (ids != anchor))[:n]
        return np.full(len(near), anchor), ids[near], scores[near]

    return read


def _negatives(k: int, low: int, high: int) -> Callable:
    """Of each positive the first ``k`` rows of another label from its upper limit on, down to its lower limit."""

    def read(anchor, label, scores, ids, labels, told):
        others = np.flatnonzero(labels != label)
        falling, out = -scores[others], [(np.zeros(0, np.int64),) * len(_MINED)]
        for positive, score in told[told[:, 2] == 1, :2].tolist():
            # low * score <= 100 * s <= high * score, in whole numbers
            least, most = -(-low * score // 100), high * score // 100
            begin, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
            near = others[begin : min(begin + k, max(begin, end))]
            out.append((np.full(len(near), anchor), np.full(len(near), positive), ids[near], np.full(len(near), score), scores[near]))
        return tuple(np.concatenate(c) for c in zip(*out))

    return read


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: of each anchor's ``positives`` best rows of its label the first ``k`` hard negatives.

    ``vectors`` are :func:`labelled_vectors`; ``anchors`` says which of them are anchors. A row's score is
    its integer inner product with the anchor, ties go to the smaller vec_id, and a hard negative of a
    positive is a row of another label with low * positive_score <= 100 * score <= high * positive_score.
    So a positive of a negative score has none. Anchors meet vectors of their own dimension. An anchor
    without another row of its label, and a positive without hard negatives, give no rows; so does an empty
    table. Products that don't fit into a long are an error.

    The data is dealt out in blocks by a hash of vec_id, and groups of anchors visit each block. There each
    anchor's scores with the whole block are sorted by score and id. A first pass reads the best rows of
    its label off every block's order; the best of all blocks are its positives. A second pass finds each
    positive's limits in every block's order by binary search and reads k rows from the upper one on; the
    best k of all blocks are the answer. So an anchor's order is never whole in one place, a block never
    larger than ``BLOCK``, and of a block only those few rows are kept.
    """
    rows = cut(vectors)
    counts = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each dimension
    blocks = {dim: math.ceil(n / BLOCK) for dim, n in counts.items()}
    n_blocks = F.coalesce(*[F.when(F.col("dim") == dim, n) for dim, n in blocks.items()], F.lit(1))
    columns = "dim", "block", "vec_id", "label", "v", "limits"
    placed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int")).withColumn("limits", F.lit(None).cast("long"))
    data, asked = placed.select(*columns).transform(in_arrow, _in_groups(False, blocks, 0), _ROWS), placed.where(anchors)

    def met(groups: DataFrame, limits: int, read: Callable, names: list[str]) -> DataFrame:
        visits = groups.select(*columns).transform(in_arrow, _in_groups(True, blocks, limits), _ROWS)
        dealt = data.unionByName(visits).repartition("dim", "block").sortWithinPartitions("dim", "block", "anchors")
        return dealt.transform(in_arrow, _sorted_scores(read, names, limits), ", ".join(f"{n} long" for n in names))

    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = met(asked, 0, _positives(positives), _FOUND).withColumn("nth", nth).where(F.col("nth") <= positives)
    limits = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("limits"))  # ``positives`` at most
    mined = met(asked.drop("limits").join(limits, "vec_id"), positives, _negatives(k, low, high), _MINED)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = mined.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
