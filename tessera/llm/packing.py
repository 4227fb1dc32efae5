"""Hierarchical multi-length packing of documents into training sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import TEXTS, in_arrow, pieces, texts_of
from tessera.llm.tokens import byte_bpe, default_path

#: Context sizes; each is a power of two, and each is half of the one before.
TIERS = (1024, 512, 256, 128)
#: Tokens of one step of training; sequences of several sizes share a step.
STEP_TOKENS = 65_536
#: Tails that may wait in a task for a window of their tier.
WAITING = 4096
#: Task numbers of a sequence's identifier stand above so many bits.
TASK_BITS = 40

FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()), ("ids", pa.binary()),
]
SQL_TYPES = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


class Packer:
    """Packs one task's documents; holds ``WAITING`` tails and the open steps, nothing else.

    A document is first cut into whole windows of the longest tier. Its tail is routed to the
    shortest tier that holds it. Windows are filled from the longest waiting tail down: the gap
    behind it takes the longest shorter tails that fit, and only where none fits is a tail cut to
    close the gap. A window is written when it is full, so it is as long as its tier. What waits
    when the task ends is laid end to end and cut at powers of two, so nothing is padded at all.
    """

    def __init__(self, task: int, tiers=TIERS, step_tokens: int = STEP_TOKENS, keep_ids: bool = False):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
            raise ValueError("tiers are descending powers of two")
        self.base, self.tiers, self.step_tokens, self.keep_ids = task << TASK_BITS, tiers, max(step_tokens, tiers[0]), keep_ids
        self.sequences = self.steps = 0
        self.room: dict[int, deque[int]] = defaultdict(deque)  # open steps by the tokens that they still take
        self.waiting: dict[int, list[tuple]] = defaultdict(list)  # by length: (doc_id, start, ids, doc_tokens)
        self.lengths = self.count = 0  # a bit for each length that waits
        self.rows: list[list] = [[] for _ in FIELDS]

    def add(self, doc_id, ids: np.ndarray) -> None:
        data, total, longest = ids.astype("<u4", copy=False).tobytes(), len(ids), self.tiers[0]
        whole = total - total % longest
        for at in range(0, whole, longest):
            self._write([(doc_id, at, data[4 * at : 4 * (at + longest)], total)], longest)
        if whole < total:
            self._wait((doc_id, whole, data[4 * whole :], total))
            if self.count >= WAITING:
                self._fill(WAITING // 4)

    def finish(self) -> None:
        self._fill(0)
        rest = [x for n in sorted(self.waiting, reverse=True) for x in self.waiting[n]]
        self.waiting.clear()
        self.lengths = self.count = 0
        left = sum(len(x[2]) // 4 for x in rest)
        rest.reverse()
        while left:
            size = min(self.tiers[0], 1 << (left.bit_length() - 1))
            window, gap = [], size
            while gap:
                doc_id, start, data, total = rest.pop()
                n = min(gap, len(data) // 4)
                window.append((doc_id, start, data[: 4 * n], total))
                if 4 * n < len(data):
                    rest.append((doc_id, start + n, data[4 * n :], total))
                gap -= n
            self._write(window, size)
            left -= size

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.waiting[n].append(piece)
        self.lengths |= 1 << n
        self.count += 1

    def _take(self, n: int) -> tuple:
        piece = self.waiting[n].pop()
        if not self.waiting[n]:
            self.lengths ^= 1 << n
        self.count -= 1
        return piece

    def _fill(self, until: int) -> None:
        """Write full windows while more than ``until`` tails wait."""
        while self.count > until:
            n = self.lengths.bit_length() - 1
            tier = next(t for t in reversed(self.tiers) if t >= n)
            window, gap = [self._take(n)], tier - n
            while gap and self.lengths:
                if m := (self.lengths & ((2 << gap) - 1)).bit_length() - 1 if self.lengths & ((2 << gap) - 1) else 0:
                    window.append(self._take(m))
                    gap -= m
                else:  # every tail is longer than the gap: the shortest one is cut
                    doc_id, start, data, total = self._take((self.lengths & -self.lengths).bit_length() - 1)
                    window.append((doc_id, start, data[: 4 * gap], total))
                    self._wait((doc_id, start + gap, data[4 * gap :], total))
                    gap = 0
            if gap:
                for piece in window:
                    self._wait(piece)
                return
            self._write(window, tier)

    def _step(self, size: int) -> int:
        """The step that the next sequence of this size joins: the open one with least room, else a new one."""
        fits = [room for room, steps in self.room.items() if steps and room >= size]
        if fits:
            room = min(fits)
            step = self.room[room].popleft()
        else:
            room, step, self.steps = self.step_tokens, self.steps, self.steps + 1
        if room - size >= self.tiers[-1]:
            self.room[room - size].append(step)
        return self.base + step

    def _write(self, window: list[tuple], size: int) -> None:
        sequence, step, at = self.base + self.sequences, self._step(size), 0
        self.sequences += 1
        for doc_id, start, data, total in window:
            n = len(data) // 4
            for column, value in zip(self.rows, (doc_id, start, n, zlib.crc32(data), total, sequence, at, size, step, data if self.keep_ids else None)):
                column.append(value)
            at += n

    def batch(self) -> pa.RecordBatch:
        fields = FIELDS if self.keep_ids else FIELDS[:-1]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(self.rows, fields)], names=[n for n, _ in fields])
        self.rows = [[] for _ in FIELDS]
        return out


def pack(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None,
    end_id: int = 0, tiers=TIERS, step_tokens: int = STEP_TOKENS, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group``.

    ``keep_ids`` adds the piece's little-endian 32-bit ``ids``. Each document is its identifiers and
    then ``end_id``; a null text is an empty one, so even an empty document is one token, and a null
    doc_id is kept as null. Repeated rows are packed each for itself. An empty table gives no rows.
    Sequences are made inside a task, with no shuffle: they hold as many documents of one input split
    as fit, sequence and step numbers carry the task's number, and a task run again makes the same
    ones. A ``step_group`` gathers sequences of all tiers up to ``step_tokens`` tokens, the same for each
    step but a task's last ones. A document may be of any length; its whole windows are written as
    they are cut.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = byte_bpe(path), Packer(TaskContext.get().partitionId(), tiers, step_tokens, keep_ids)
        end = np.array([end_id], "<u4")
        for batch in pieces(batches, TEXTS):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                packer.add(doc_id, np.concatenate([encoder.encode(text), end]))
                if len(packer.rows[0]) >= 8192:
                    yield packer.batch()
            yield packer.batch()
        packer.finish()
        yield packer.batch()

    fields = FIELDS if keep_ids else FIELDS[:-1]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.transform(in_arrow, run, ", ".join(f"`{n}` {SQL_TYPES[t]}" for n, t in fields))
