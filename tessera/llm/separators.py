"""Token counts of documents in flat, unindexed token files, by a separator scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import TEXTS, cut, in_arrow, pieces, texts_of
from tessera.llm.tokens import byte_bpe, default_path

#: Bytes of one block; a multiple of every width of a token.
BLOCK_BYTES = 1 << 18
#: Blocks of one file whose sums are carried on together; the sums of such chunks are carried on next.
CHUNK = 1024
#: End-of-document identifier of the byte-level vocabulary.
END_ID = 50256
WIDTHS = {2: "<u2", 4: "<u4"}

BLOCKS = "file string, block long, payload binary"


def read_flat_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, block, payload`` of the flat binary files under ``path``, cut by the JVM.

    Files are read by Spark alone, one record a file, so a file is at most as long as Spark's binary
    records (2 GB) and a shard set has many of them. An empty file has no blocks.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))
    return files.select("path", "content", F.posexplode(starts).alias("block", "at")).select(
        F.col("path").alias("file"), F.col("block").cast("long"), F.expr(f"substring(content, cast(at as int) + 1, {block_bytes})").alias("payload")
    )


def flatten(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Flat 16-bit token stream of ``doc_id``, ``text``: one file a task, in blocks of ``block_bytes``.

    ``ended`` lists the doc_ids whose separator lies in the block, so that counts can be named later;
    the scan itself doesn't see it. Null texts are empty documents: their separator alone. A text that
    holds the separator's string is encoded as ordinary text, so no separator stands inside a document;
    an ``end_id`` that ordinary text has too is an error.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, block = byte_bpe(path), f"task-{TaskContext.get().partitionId():06d}", 0
        held, size, ends = [], 0, []  # parts of the stream, their bytes, and (position, doc_id) of separators in it
        end = np.array([end_id], "<u2").tobytes()

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, ends, block
            if size < block_bytes and not (last and size):
                return
            data = b"".join(held)
            cuts = range(0, size if last else size - size % block_bytes, block_bytes)
            rows = [(data[a : a + block_bytes], [d for p, d in ends if a <= p < a + block_bytes]) for a in cuts]
            used = len(rows) * block_bytes
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * len(rows)), pa.array(range(block, block + len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                ],
                names=["file", "block", "payload", "ended"],
            )
            block, held, size, ends = block + len(rows), [data[used:]], max(0, size - used), [(p - used, d) for p, d in ends if p >= used]

        for batch in pieces(batches, TEXTS):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = encoder.encode(text)
                if (ids == end_id).any():
                    ids = encoder.encode_ordinary(text)
                    if (ids == end_id).any():
                        raise ValueError(f"identifier {end_id} is no separator: the text of document {doc_id} has it")
                ids = ids.astype("<u2").tobytes() + end
                held.append(ids)
                size += len(ids)
                ends.append((size - 2, doc_id))
                yield from blocks(False)
        yield from blocks(True)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.transform(in_arrow, run, f"{BLOCKS}, ended array<long>")


def scan(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """One row a document end: ``file, ordinal, start, n_tokens``, and the block's other columns as arrays.

    Within a block the separators are found by one vectorised comparison. Blocks then exchange three
    numbers only (tokens, separators, the last separator's place), by a prefix scan in two levels:
    within chunks of ``CHUNK`` blocks, and over the chunks' sums. So a single file with a third of
    all tokens takes no more than its chunks' sums in one task. ``n_tokens`` leaves the separator out.
    Tokens behind a file's last separator are a document that isn't ended: ``ended`` is false for it.
    Blocks of one file have consecutive numbers from 0 and, but for the last, whole tokens. A trailing
    part of a token, an empty payload and a null one hold no tokens; no blocks give no rows.
    """
    summed = cut(summarise(blocks, end_id, width))  # a hundredth of the tokens; the prefix scan reads it twice
    return _documents(_stitch(summed))


def summarise(blocks: DataFrame, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """``file, block, tokens, ends`` (places of separators), and ``ended`` if the blocks have it."""
    names = ["file", "block", "payload"] + [c for c in ("ended",) if c in blocks.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ends = [], []
            for payload in batch.column(2):
                ids = np.frombuffer(payload.as_buffer() or b"", np.uint8) if payload.is_valid else np.zeros(0, np.uint8)
                ids = ids[: len(ids) - len(ids) % width].view(WIDTHS[width])
                tokens.append(len(ids))
                ends.append(np.flatnonzero(ids == end_id))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(ends, pa.list_(pa.int64())), *batch.columns[3:]],
                names=["file", "block", "tokens", "ends", *names[3:]],
            )

    rows = blocks.select(F.col("file").cast("string"), F.col("block").cast("long"), F.col("payload").cast("binary"), *names[3:])
    return rows.transform(in_arrow, run, "file string, block long, tokens long, ends array<long>" + (", ended array<long>" if names[3:] else ""))


def _stitch(summed: DataFrame) -> DataFrame:
    """Each block's first token, first ordinal, and the place behind the last separator before it."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = summed.withColumn("chunk", F.floor(F.col("block") / CHUNK)).withColumn("n_ends", F.size("ends").cast("long"))
    inside = Window.partitionBy("file", "chunk").orderBy("block")
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("at", F.coalesce(F.sum("tokens").over(before(inside)), zero)).withColumn(
        "nth", F.coalesce(F.sum("n_ends").over(before(inside)), zero),
    )
    rows = rows.withColumn("after", F.max(F.when(F.col("n_ends") > 0, F.col("at") + F.element_at("ends", -1) + 1)).over(before(inside)))
    last = F.max(F.when(F.col("n_ends") > 0, F.col("at") + F.element_at("ends", -1) + 1))
    chunks = rows.groupBy("file", "chunk").agg(
        F.sum("tokens").alias("tokens"), F.sum("n_ends").alias("n_ends"), last.alias("last"), F.max("block").alias("final"),
    )
    along = Window.partitionBy("file").orderBy("chunk")
    chunks = chunks.withColumn("chunk_at", F.coalesce(F.sum("tokens").over(before(along)), zero)).withColumn(
        "chunk_nth", F.coalesce(F.sum("n_ends").over(before(along)), zero),
    )
    chunks = chunks.select(
        "file", "chunk", "chunk_at", "chunk_nth", F.coalesce(F.max(F.col("chunk_at") + F.col("last")).over(before(along)), zero).alias("chunk_after"),
        F.max("final").over(Window.partitionBy("file")).alias("final"),
    )
    rows = rows.join(chunks, ["file", "chunk"])
    return rows.select(
        "file", "block", "tokens", "ends", *[c for c in ("ended",) if c in summed.columns], (F.col("chunk_at") + F.col("at")).alias("at"), (F.col("chunk_nth") + F.col("nth")).alias("nth"),
        F.coalesce(F.col("chunk_at") + F.col("after"), F.col("chunk_after")).alias("after"), (F.col("block") == F.col("final")).alias("is_last"),
    )


def _documents(stitched: DataFrame) -> DataFrame:
    """Rows of documents from the stitched blocks; a document belongs to the block of its separator."""
    named = "ended" in stitched.columns
    ends = F.transform("ends", lambda e: F.col("at") + e)
    # a document starts behind the separator before it; the block's first one where the carry says
    starts = F.concat(F.array("after"), F.transform("ends", lambda e: F.col("at") + e + 1))
    rest = F.when(
        F.col("is_last") & (F.element_at(starts, -1) < F.col("at") + F.col("tokens")), F.array(F.col("at") + F.col("tokens")),
    ).otherwise(F.array().cast("array<long>"))
    rows = stitched.select(
        "file", "nth", F.size("ends").alias("n_ends"), *(["ended"] if named else []), starts.alias("starts"), F.concat(ends, rest).alias("stops")
    ).select("file", "nth", "n_ends", *(["ended"] if named else []), "starts", F.posexplode("stops").alias("k", "stop"))
    start = F.col("starts")[F.col("k")]
    columns = [
        "file", (F.col("nth") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"),
        (F.col("k") < F.col("n_ends")).alias("is_ended"),
    ]
    if named:
        columns.append(F.get("ended", F.col("k")).alias("doc_id"))
    return rows.select(*columns)
