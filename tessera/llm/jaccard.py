"""Near copies by the Jaccard similarity of word shingles: multi-index hashing of SimHash, then of min-wise fingerprints; whole sets decide.

First 64-bit SimHash fingerprints of the shingles, by :mod:`tessera.llm.simhash`, link what is at most 4 bits apart
and similar enough. At a similarity of 0.8 two of them differ by some 10 bits, and by over 20 at times;
no segment of them is short enough to find such pairs. So what is left apart meets by fingerprints of 128 symbols of 16
bits (least hashes of the shingles under 128 permutations), in 32 segments of 4. The scheme is the same:
fetch the matches of each segment's table, verify the distance of the whole fingerprints, then the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import TEXTS, connected_components, cut, edge_batch, in_arrow, key_runs, pieces, texts_of
from tessera.llm.simhash import shingles

#: Words of a shingle, and the similarity (numerator, denominator) from which on texts are near copies.
SHINGLE, SEED, LEAST = 5, 42, (4, 5)
#: A pair is proposed when all symbols of a segment agree; at a similarity of 0.8 one pair in 20 million isn't: (1 - 0.8^4)^32.
SEGMENTS, SYMBOLS = 32, 4
#: Symbols of 128 that a proposed pair must share before its texts are compared: at 0.8 one pair in 30 thousand million has fewer.
AGREED = 70
#: About so many of a text's candidates are compared together, so that a text with many near copies is no single task's work.
MEMBERS = 1024
#: A bucket's table is split into blocks of about so many texts and shingles, each of which is met by the whole bucket.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 500_000
#: So many texts (16 bytes each) or buckets (16 bytes each) may be broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 63, SEGMENTS * SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, SEGMENTS * SYMBOLS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)

SIDED = "key long, block long, probe boolean, node long, component long"


def shingle_set(text: str) -> np.ndarray:
    """The different shingles' 64-bit hashes, sorted; none without words."""
    return np.unique(shingles(text, SHINGLE, SEED))


def node_of(found: np.ndarray) -> int:
    """The name of a set of shingles, a signed long."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).view(np.int64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The 128 symbols of a set, four to a signed long; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(SEGMENTS * SYMBOLS, ~np.uint64(0))
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[None, at : at + 4096] * _FACTORS[:, None] + _SHIFTS[:, None]).min(1), out=least)
    least *= _MIX
    return (least >> np.uint64(48)).astype(np.uint16).view(np.int64)


def signs(found: np.ndarray) -> int:
    """The SimHash of a set of shingles as a signed long; of different sets alone, so that a class has one."""
    return int(np.uint64(simhash.of_hashes(found)).view(np.int64))


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether two sorted sets reach ``LEAST``, in whole numbers."""
    common = len(np.intersect1d(left, right, assume_unique=True))
    return common * LEAST[1] >= LEAST[0] * (len(left) + len(right) - common)


def _sized(left, right) -> np.ndarray:
    """Whether sets of these sizes can reach ``LEAST``."""
    return np.minimum(left, right) * LEAST[1] >= LEAST[0] * np.maximum(left, right)


def _symbols(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, SEGMENTS)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values, and where each list of the column begins and ends in them."""
    return column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, TEXTS):
        sets = [shingle_set(t) for t in texts_of(batch.column(2))]
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2], pa.array([node_of(s) for s in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int32()),
                pa.array([fingerprint(s) for s in sets], pa.list_(pa.int64())),
                pa.array([signs(s) for s in sets], pa.int64()),
            ],
            names=["doc_id", "text_hash", "node", "size", "symbols", "fp"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, TEXTS):
        sets = [shingle_set(t).view(np.int64) for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (a, salt, member, node, shingles) sorted by the first three: the row of ``a`` itself comes first."""
    held = np.zeros(0, np.uint64)
    for batch in pieces(batches, 512):
        a, member, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
        (values, ends), linked = _lists(batch.column(4)), []
        for k in range(batch.num_rows):
            found = values[ends[k] : ends[k + 1]]
            if not member[k]:
                held = found.copy()
            elif similar(held, found):
                linked.append(k)
        yield edge_batch(a[linked], node[linked])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a``, ``b`` of the rows (a, size, symbols, b, size, symbols) whose fingerprints are near enough."""
    for batch in batches:
        left, right = (_symbols(batch.column(k)).view(np.uint16) for k in (2, 5))
        of_a, of_b = batch.column(1).to_numpy().astype(np.int64), batch.column(4).to_numpy().astype(np.int64)
        near = _sized(of_a, of_b) & (np.add.reduce(left == right, 1, np.uint8) >= AGREED)
        yield edge_batch(batch.column(0).to_numpy()[near], batch.column(3).to_numpy()[near])


@dataclass
class _Run:
    new: bool  # whether a block begins
    at: tuple[int, int]  # key and block
    probe: bool
    nodes: np.ndarray
    components: np.ndarray
    segments: np.ndarray
    sizes: np.ndarray
    symbols: np.ndarray
    aside: np.ndarray  # whether outside of the bucket's largest component
    rows: pa.RecordBatch


class _Block:
    """The table of one block of a bucket, held while the bucket's other texts pass."""

    def __init__(self) -> None:
        self.nodes = self.components = self.sizes = np.zeros(0, np.int64)
        self.symbols = np.zeros((0, SEGMENTS), np.int64)
        self.hit = np.zeros(0, bool)

    def add(self, run: _Run) -> None:
        mine, new = ("nodes", "components", "sizes", "symbols"), (run.nodes, run.components, run.sizes, run.symbols)
        for name, values in zip(mine, new):
            setattr(self, name, np.concatenate([getattr(self, name), values]))
        self.hit = np.concatenate([self.hit, np.zeros(len(run.nodes), bool)])

    def near(self, run: _Run, k: int, component: int) -> np.ndarray:
        """The rows of the table in other components that are near the run's text ``k``, where this is the first segment that they share.

        Two texts outside of the largest component pass by each other's block; the lesser node's block counts.
        """
        fits = (self.components != component) & _sized(self.sizes, run.sizes[k])
        if run.aside[k]:
            fits &= self.nodes < run.nodes[k]
        which = np.flatnonzero(fits)
        if not len(which):
            return which
        symbols, one = self.symbols[which], run.symbols[k]
        same = np.add.reduce(symbols.view(np.uint16) == one.view(np.uint16), 1, np.uint8) >= AGREED
        if segment := run.segments[k]:
            same &= ~(symbols[:, :segment] == one[:segment]).any(1)
        return which[same]


def _runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[_Run]:
    """Runs of rows (key, block, probe, node, component, segment, size, symbols, aside, ...) sorted by the first three, of one of each and at most so many ``rows``."""
    at = None
    for batch in pieces(batches, rows):
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2)], 1)
        bounds = key_runs(keys.view([("", np.int64)] * 3).ravel())
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            new, at = (keys[a, 0], keys[a, 1]) != at, (keys[a, 0], keys[a, 1])
            part = batch.slice(a, b - a)
            nodes, components, segments, sizes = (part.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5, 6))
            yield _Run(
                new, at, bool(keys[a, 2]), nodes, components, segments, sizes, _symbols(part.column(7)),
                part.column(8).to_numpy(zero_copy_only=False), part,
            )


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each block, and of those that pass, which a pair of near fingerprints in different components makes worth comparing."""
    out: list[list] = [[] for _ in range(5)]
    held, at = _Block(), (0, 0)

    def put(probe: bool, nodes, components) -> None:
        for column, values in zip(out, (np.full(len(nodes), at[0]), np.full(len(nodes), at[1]), np.full(len(nodes), probe), nodes, components)):
            column.append(values)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(c) if c else np.zeros(0, bool if k == 2 else np.int64)) for k, c in enumerate(out)],
            names=["key", "block", "probe", "node", "component"],
        )
        for c in out:
            c.clear()
        return batch

    for run in _runs(batches, 4096):
        if run.new:
            put(False, held.nodes[held.hit], held.components[held.hit])
            yield flush()
            held, at = _Block(), run.at
        if not run.probe:
            held.add(run)
            continue
        met = np.zeros(len(run.nodes), bool)
        for k, component in enumerate(run.components.tolist()):
            near = held.near(run, k, component)
            met[k] = len(near) > 0
            held.hit[near] = True
        put(True, run.nodes[met], run.components[met])
    put(False, held.nodes[held.hit], held.components[held.hit])
    yield flush()


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each block's rows, as :func:`_meet` has left them and with their shingles: a pair in one component by now is not compared."""
    held, sets, parent = _Block(), [], {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    for run in _runs(batches, 512):
        if run.new:
            held, sets, parent = _Block(), [], {}
        values, ends = _lists(run.rows.column(9))
        found = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
        if not run.probe:
            held.add(run)
            sets += [x.copy() for x in found]
            continue
        edges: list[tuple[int, int]] = []
        for k, component in enumerate(run.components.tolist()):
            own = root(component)
            near = held.near(run, k, own)
            if not len(near):
                continue
            some, size = np.concatenate([sets[i] for i in near]), len(found[k])
            there = found[k][np.minimum(np.searchsorted(found[k], some), size - 1)] == some
            common = np.add.reduceat(there, np.concatenate([[0], np.cumsum(held.sizes[near])[:-1]]), dtype=np.int64)
            for i in near[common * LEAST[1] >= LEAST[0] * (held.sizes[near] + size - common)].tolist():
                if (other := int(held.components[i])) != own:
                    low, high = min(own, other), max(own, other)
                    parent[high] = own = low
                    held.components[held.components == high] = low
                    edges.append((int(held.nodes[i]), int(run.nodes[k])))
        yield edge_batch(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int64))


def _joined(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """``left`` with what ``right``, a row for each ``on``, says of it; ``right`` is broadcast if it is small."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on)


def _sets_of(nodes: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``node``, ``shingles`` of the texts that ``nodes`` names, each once."""
    wanted = cut(nodes.distinct().join(classes.select("node", "least.doc_id", "least.text_hash"), "node"))
    few = wanted.count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).select("node", "text")
    return cut(texts.transform(in_arrow, _sets, "node long, shingles array<long>").dropDuplicates(["node"]))


def _signed_pairs(classes: DataFrame) -> DataFrame:
    """``a``, ``b``: sets whose SimHash fingerprints are linked, each fingerprint standing for its least set, and that one with the others of its fingerprint."""
    classes = classes.where("size > 0")
    of_fp = cut(classes.groupBy("fp").agg(F.min("node").alias("first")))
    ends = lambda x: of_fp.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}"))
    linked = simhash.links(of_fp).join(ends("a"), "a").join(ends("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    same = classes.select("fp", F.col("node").alias("b")).join(of_fp, "fp").where("b != first").select(F.col("first").alias("a"), "b")
    return linked.unionByName(same)


def _pivots(shared: DataFrame) -> DataFrame:
    """``a``, ``b``: each text of a bucket with that one of it which meets most texts in all its buckets, each pair once.

    A text that others were copied from shares more of their buckets than they do of each other's, so one
    comparison a copy links most of a group.
    """
    sizes = cut(shared.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    met = _joined(shared, sizes, "key").groupBy("node").agg(F.sum("n").alias("met"))
    best = shared.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("a"))
    return _joined(shared, cut(best), "key").where("node != a").select("a", F.col("node").alias("b")).distinct()


def _star_links(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose sets are similar; a set travels once for each pair that it is the second of, and once for each ``MEMBERS`` that it is compared with."""
    of = lambda x: classes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("symbols").alias(f"symbols_{x}"))
    near = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "size_a", "symbols_a", "b", "size_b", "symbols_b")
    near = cut(near.transform(in_arrow, _agreeing, "a long, b long"))
    sets = _sets_of(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))), rows, classes)
    groups = cut(near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("salts")))
    salt = F.pmod(F.xxhash64("b"), F.col("salts").cast("long")).cast("int")
    members = _joined(near, groups, "a").select("a", F.col("b").alias("node"), salt.alias("salt"), F.lit(1).alias("member"))
    own = groups.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    dealt = members.unionByName(own).join(sets, "node").select("a", "salt", "member", "node", "shingles").repartition("a", "salt")
    return dealt.sortWithinPartitions("a", "salt", "member").transform(in_arrow, _compare, "a long, b long")


def _rest_links(shared: DataFrame, parts: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between texts of a bucket that ``parts`` has in different components, as a forest of them.

    In each such bucket the texts outside of its largest component are the table, in blocks; all texts
    of the bucket pass by each block. First fingerprints meet, and only texts in pairs of near ones send
    their shingles. So the rows grow with the blocks, not with the pairs, and no pair is left out.
    """
    apart = shared.join(parts, "node", "left").select("key", "segment", "node", F.coalesce("component", "node").alias("component"))
    counted = apart.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counted.groupBy("key").agg(
        F.max(F.struct("n", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("parts"),
    ).where("parts > 1").select("key", "largest")
    apart = cut(_joined(apart, cut(mixed), "key").join(classes.select("node", "size", "symbols"), "node"))
    aside = apart.where("component != largest").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    aside = cut(aside.select("key", F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("s") / BLOCK_SHINGLES)).cast("long").alias("blocks")))
    apart = _joined(apart, aside, "key")
    apart = apart.withColumn("aside", F.col("component") != F.col("largest"))
    columns = ["key", "block", "probe", "node", "component", "segment", "size", "symbols", "aside"]
    table = apart.where("aside").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("probe", F.lit(False))
    passing = apart.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("probe", F.lit(True))
    dealt = table.select(*columns).unionByName(passing.select(*columns)).repartition("key", "block").sortWithinPartitions("key", "block", "probe")
    met = cut(dealt.transform(in_arrow, _meet, SIDED))
    sets = _sets_of(met.select("node"), rows, classes)
    full = met.join(apart.select("key", "node", "segment", "size", "symbols", "aside"), ["key", "node"]).join(sets, "node").select(*columns, "shingles")
    return full.repartition("key", "block").sortWithinPartitions("key", "block", "probe").transform(in_arrow, _decide, "a long, b long")


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text_hash, component_id, kept`` of every row, null doc_ids aside; texts are linked at a similarity of ``LEAST`` or more.

    Texts with the same shingles are one class, so copies cost nothing further; texts without words are
    one class too. All pairs that a segment proposes are decided by their whole sets, but for those that
    links have put into one component already. ``component_id`` is the smallest doc_id of the component;
    ``text_hash`` is XXH64 of the text (a null one is empty) and tells rows of one doc_id apart.
    ``kept`` is true for the row of the component with the least doc_id, then the least ``text_hash``;
    rows that repeat it have it too. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"),
    )
    sketches = cut(rows.transform(in_arrow, _sketches, "doc_id long, text_hash long, node long, size int, symbols array<long>, fp long"))
    classes = cut(sketches.groupBy("node").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("size").alias("size"), F.first("symbols").alias("symbols"), F.first("fp").alias("fp"),
    ))
    keyed = classes.select("node", F.posexplode("symbols").alias("segment", "value")).select("node", "segment", F.xxhash64("segment", "value").alias("key"))
    shared = cut(keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key"))
    shared = cut(_joined(keyed, shared, "key").select("key", "segment", "node"))
    # what SimHash links and what shares a segment with its bucket's pivot is compared in one pass
    links = cut(_star_links(_signed_pairs(classes).unionByName(_pivots(shared)).distinct(), rows, classes))
    links = links.unionByName(cut(_rest_links(shared, connected_components(links), rows, classes)))
    parts = connected_components(links).select("node", "component")
    named = classes.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("first"))
    of_class = named.join(names, "component").select("node", "first")
    return sketches.select("doc_id", "text_hash", "node").join(of_class, "node").select(
        "doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), (F.struct("doc_id", "text_hash") == F.col("first")).alias("kept")
    )
