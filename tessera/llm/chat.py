"""Chat formatting by columnar byte assembly, and the reader of its output."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import in_arrow, key_runs, pieces

START, BREAK, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Control strings of this and other common templates; each is broken up inside roles and texts.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Stands behind the first character of a control string inside a text; doubled where a text has it itself.
ESCAPE = "␛"
LOSS_ROLE = "assistant"
#: Rows and bytes put together at once; a longer text is put together alone.
ROWS, BYTES = 2048, 1 << 24
#: Longer segments are copied one by one, shorter ones by an index of all their bytes.
LONG = 1 << 16

_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(f"{ESCAPE}(.?)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    """Inverse of :func:`escape` and of :func:`escape_role`, for which n stands for a line feed."""
    return _ESCAPED.sub(lambda m: ESCAPE if m[1] == ESCAPE else m[1], text) if ESCAPE in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", f"{ESCAPE}n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: {ESCAPE: ESCAPE, "n": "\n"}.get(m[1], m[1]), role) if ESCAPE in role else role


def _escaped(column: pa.Array, how) -> pa.Array:
    """The column with ``how`` applied to the rows that hold a character where a control string may begin."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(column, f"[<\\[\n{ESCAPE}]" if how is escape_role else f"[<\\[{ESCAPE}]")
    if not pc.any(odd).as_py():
        return column
    return pa.array([how(x) if f else x for x, f in zip(column.to_pylist(), odd.to_pylist())], pa.large_string())


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and data of a large string column."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer of all formatted turns, the turns' offsets in it, and where each text begins.

    Lengths of the five segments of a turn give offsets by one cumulative sum; then every segment
    kind is scattered to its places with one indexed copy.
    """
    n = len(texts)
    segments: list = [START, _bytes_of(roles), BREAK, _bytes_of(texts), END]
    fixed = {k: np.frombuffer(s.encode(), np.uint8) for k, s in enumerate(segments) if isinstance(s, str)}
    lengths = np.stack([np.full(n, len(fixed[k]), np.int64) if k in fixed else np.diff(s[0]) for k, s in enumerate(segments)])
    offsets = np.concatenate([[0], np.cumsum(lengths.sum(0))])
    places = offsets[:-1] + np.concatenate([np.zeros((1, n), np.int64), np.cumsum(lengths, 0)[:-1]])
    out = np.empty(offsets[-1], np.uint8)
    for k, segment in enumerate(segments):
        if k in fixed:
            out[places[k][:, None] + np.arange(len(fixed[k]))] = fixed[k]
        else:
            begins, long = segment[0][:-1], lengths[k] > LONG
            for i in np.flatnonzero(long).tolist():
                out[places[k][i] : places[k][i] + lengths[k][i]] = segment[1][begins[i] : begins[i] + lengths[k][i]]
            short = np.where(long, 0, lengths[k])
            ends = np.cumsum(short)
            inside = np.arange(ends[-1]) if len(ends) else np.zeros(0, np.int64)
            inside -= np.repeat(ends - short, short)
            out[np.repeat(places[k], short) + inside] = segment[1] if not long.any() else segment[1][np.repeat(begins, short) + inside]
    return out, offsets, places[3]


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows (conv_id, role, text) in batches of ``BYTES`` at most, or of one row."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = max(1, int(np.searchsorted(ends, before + BYTES, "right")) - at)
        yield batch.slice(at, n)
        at += n


FORMATTED = "conv_id long, part long, formatted string, loss_start array<long>, loss_end array<long>"


def format_chat(turns: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, loss_start, loss_end`` of rows ``conv_id, turn, role, text``.

    A conversation is its ``formatted`` parts in order of ``part``; there is one part unless the
    conversation crosses a batch of ``ROWS`` rows or ``BYTES``, so even a conversation with a third of all rows is
    never held at once. ``loss_start`` and ``loss_end`` are byte positions of the assistant's texts in
    ``formatted``. Rows of a conversation are ordered by turn (nulls first), and at equal turns by role
    and text; repeated rows are turns of their own. Null roles and texts are empty; rows whose conv_id
    is null form one conversation. No rows give no rows; other columns are ignored.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = 0
        for batch in (small for whole in pieces(batches, ROWS) for small in _by_bytes(whole)):
            conv, role, text = batch.column(0), batch.column(1), batch.column(2)
            data, offsets, begins = assemble(_escaped(role, escape_role), texts := _escaped(text, escape))
            ends = begins + np.diff(_bytes_of(texts)[0])
            keys = np.stack([conv.is_null().to_numpy(zero_copy_only=False), pc.fill_null(conv, 0).to_numpy()])
            runs = key_runs(keys.T.copy().view([("", keys.dtype)] * 2).ravel())
            loss = pc.fill_null(pc.equal(role, LOSS_ROLE), False).to_numpy(zero_copy_only=False)
            first = np.repeat(offsets[runs[:-1]], np.diff(runs))
            per_run = np.concatenate([[0], np.cumsum(loss)])[runs].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    conv.take(pa.array(runs[:-1])), pa.array(np.arange(part, part + len(runs) - 1)),
                    pa.LargeStringArray.from_buffers(len(runs) - 1, pa.py_buffer(offsets[runs].astype(np.int64)), pa.py_buffer(data)).cast(pa.string()),  # far below 2 GB
                    pa.ListArray.from_arrays(pa.array(per_run, pa.int32()), pa.array((begins - first)[loss])),
                    pa.ListArray.from_arrays(pa.array(per_run, pa.int32()), pa.array((ends - first)[loss])),
                ],
                names=["conv_id", "part", "formatted", "loss_start", "loss_end"],
            )
            part += len(runs) - 1

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.transform(in_arrow, run, FORMATTED)


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted part."""
    turns = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(START).partition(BREAK)
        turns.append((unescape_role(role), unescape(text)))
    return turns


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from the output of :func:`format_chat` alone: digests of its turns and loss texts.

    Reads the parts in the order in which the formatter wrote them, so it needs no shuffle of its own
    and holds one part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        done: list[list] = []

        def close() -> None:
            if state:
                done.append([conv, state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]])

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )
            done.clear()
            return out

        for batch in batches:
            for key, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or key != conv:
                    close()
                    conv, state = key, {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                for role, said in parse_chat(text):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{said}\n".encode())
                data = text.encode()
                for a, b in zip(starts, ends):
                    said = unescape(data[a:b].decode())
                    state["chars"] += len(said)
                    state["loss"].update(said.encode())
                state["formatted"] += len(text)
            yield batch_of()
        close()
        yield batch_of()

    return formatted.select("conv_id", "formatted", "loss_start", "loss_end").transform(in_arrow, run, READ)
