"""SimHash near-duplicates, found by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import TEXTS, connected_components, cut, edge_batch, in_arrow, key_runs, pieces, spanning_forest, texts_of

SHINGLE, SEED, BITS = 4, 42, 64
#: Fingerprints at so many differing bits or fewer are linked.
RADIUS = 4
#: (lowest bit, width, radius of the ball) of each segment. By the pigeonhole principle two fingerprints
#: at 4 bits differ by 1 at most in one of the first two segments or agree in the third.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: A table entry with more fingerprints is split into so large blocks, each of which is met by all probes.
BLOCK = 256
#: Pairs that a task compares at once: 16 bytes each, twice that while they are put in order.
PAIRS = 200_000
#: So many hot entries may be broadcast (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ENTRIES = 100_000


def shingles(text: str, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Hashes of a text's lower-cased (A-Z) word shingles in order, repeats included; none without words.

    Bytes are split at the space and 0x09-0x0D, so words are any runs of other bytes.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n, joined = max(1, len(words) - shingle + 1), b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip((ends - lengths)[:n].tolist(), ends[-n:].tolist())], np.uint64)


def of_hashes(hashes: np.ndarray) -> int:
    """Fingerprint of hashes: a bit is set that over half of them have; 0 without any."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a text's shingles, repeats included; 0 without words."""
    return of_hashes(shingles(text, shingle, seed))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of each whole text; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, TEXTS):
            fps = np.array([simhash(t) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.transform(in_arrow, run, "doc_id long, fp long")


def _table_and_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint its entry in each segment's table, and its probes: the rest of its balls.

    Of two segments at one bit from each other, one has the bit unset; so it is enough that each
    fingerprint probes the values with one more bit set.
    """
    for batch in pieces(batches, 4096):
        fp = batch.column(0).to_numpy().view(np.uint64)
        keys, probes, which = [], [], []
        for k, (low, width, radius) in enumerate(SEGMENTS):
            value = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
            tag = np.uint64(k << 32)
            keys.append(value | tag)
            probes.append(np.zeros(len(fp), bool))
            which.append(np.arange(len(fp)))
            for bit in range(width if radius else 0):
                unset = np.flatnonzero((value >> np.uint64(bit)) & np.uint64(1) == 0)
                keys.append(value[unset] | np.uint64(1 << bit) | tag)
                probes.append(np.ones(len(unset), bool))
                which.append(unset)
        which = np.concatenate(which)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(probes)), pa.array(fp.view(np.int64)[which])],
            names=["key", "probe", "fp"],
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, block, probe, fp) sorted by those: every row meets the table rows of its block.

    Holds the table rows of one block, ``BLOCK`` or a few more, one batch, and ``PAIRS`` pairs. Writes a
    spanning forest of the links among so many pairs, so a dense block costs few more rows than it has.
    """
    held_key, held = None, np.zeros(0, np.uint64)
    for batch in pieces(batches, 8192):
        if not batch.num_rows:
            continue
        key, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        probe, fp = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy().view(np.uint64)
        runs = key_runs(np.stack([key, block], 1).view([("k", np.int64), ("b", np.int64)]).ravel())
        if (key[0], block[0]) != held_key:
            held = np.zeros(0, np.uint64)
        # the table rows of each run: those held from the batch before, then the run's own, which come first
        n_own = np.add.reduceat((~probe).astype(np.int64), runs[:-1])
        table = np.concatenate([held, fp[~probe]])
        own_from = len(held) + np.concatenate([[0], np.cumsum(n_own)[:-1]])
        begin, count = own_from.copy(), n_own.copy()
        begin[0], count[0] = 0, n_own[0] + len(held)
        run_of = np.repeat(np.arange(len(runs) - 1), np.diff(runs))
        held_key, held = (key[-1], block[-1]), table[begin[-1] : begin[-1] + count[-1]]
        each = count[run_of]
        busy = np.flatnonzero((each > 1) | ((each == 1) & probe))
        at = 0
        while at < len(busy):
            total = np.cumsum(each[busy[at:]])
            some = busy[at : at + max(1, int(np.searchsorted(total, PAIRS, "right")))]
            at += len(some)
            n = each[some]
            left = np.repeat(fp[some], n)
            right = table[np.repeat(begin[run_of[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            near = (np.bitwise_count(left ^ right) <= RADIUS) & (left != right)
            if near.any():
                yield edge_batch(*spanning_forest(left[near].view(np.int64), right[near].view(np.int64)))


def links(classes: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that join all linked fingerprints of ``classes`` (a row for each distinct ``fp``).

    Every link within ``RADIUS`` is found and verified; those which a chain of other links replaces
    in the same block are left out.
    """
    rows = classes.select("fp").transform(in_arrow, _table_and_probes, "key long, probe boolean, fp long")
    segment = lambda k, low, width: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(k << 32))
    entries = classes.select(F.explode(F.array(*[segment(k, low, width) for k, (low, width, _) in enumerate(SEGMENTS)])).alias("key"))
    hot = cut(entries.groupBy("key").count().where(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    small = hot.count() <= BROADCAST_ENTRIES
    rows = rows.join(F.broadcast(hot) if small else hot, "key", "left")
    # a table row is kept in one block of its entry and passes as a probe through the others
    own = F.pmod(F.xxhash64("fp"), F.col("blocks").cast("long"))
    rows = rows.withColumn("block", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = rows.select("key", F.col("block").cast("long"), (F.col("probe") | F.coalesce(own != F.col("block"), F.lit(False))).alias("probe"), "fp")
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "probe")
    return dealt.transform(in_arrow, _verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row, null doc_ids aside.

    Equal fingerprints are one class with its smallest doc_id, so copies cost nothing further. Classes
    are linked at ``RADIUS`` bits or fewer, and a component's name is the smallest doc_id in it. A text
    without words (null or empty among them) has fingerprint 0 and is linked like any other. Repeated
    rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    fps = cut(fingerprints(docs.where(F.col(id_column).isNotNull()), id_column, text_column))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(classes)).select(F.col("node").alias("fp"), "component")
    named = classes.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = named.join(names, "component").select("fp", "component_id")
    return fps.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
