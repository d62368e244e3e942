"""Chat formatting by columnar byte assembly, and reading the format back.

A turn is written as <|im_start|>role, a line end, the text, <|im_end|> and a line end. Inside texts and roles
one backslash more is put between < and | wherever only backslashes stand there, so a control string never
occurs and reading takes one away again. Roles also write backslash and line end as escapes.

Turns are put in order over all conversations by range, so a conversation with very many turns spreads over
tasks. A task takes rows in steps: it computes the segments' lengths, their cumulative offsets and the scatter
indices in numpy and copies headers and contents into one preallocated buffer that Arrow then owns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from lectern.llm.texts import arrow, steps

START, END = b"<|im_start|>", b"<|im_end|>\n"
#: Text bytes of a block: what a reader holds of a conversation at a time.
BLOCK_BYTES = 1 << 20


def escape_text(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape_text(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<\\(\\*)\|", r"<\1|")


def escape_role(roles: pa.Array) -> pa.Array:
    roles = pc.replace_substring(roles, "\\", "\\\\")
    return escape_text(pc.replace_substring(roles, "\n", "\\n"))


def unescape_role(roles: pa.Array) -> pa.Array:
    """Escaped backslashes stand aside as a byte no text can hold while line ends are put back."""
    roles = pc.replace_substring(pc.cast(unescape_text(roles), pa.binary()), b"\\\\", b"\xff")
    return pc.cast(pc.replace_substring(pc.replace_substring(roles, b"\\n", b"\n"), b"\xff", b"\\"), pa.string())


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(segments: list[pa.Array | bytes], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Row after row of the segments' bytes in one buffer, and where each segment of each row starts (rows x segments, and the end)."""
    lengths = np.empty((rows, len(segments)), np.int64)
    parts = []
    for k, s in enumerate(segments):
        parts.append((np.frombuffer(s, np.uint8), None) if isinstance(s, bytes) else _parts(s))
        lengths[:, k] = len(s) if isinstance(s, bytes) else np.diff(parts[k][1])
    starts = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(starts[-1], np.uint8)
    for k, (data, offsets) in enumerate(parts):
        at = starts[:-1].reshape(rows, -1)[:, k]
        if offsets is None:
            out[(at[:, None] + np.arange(len(data))).ravel()] = np.tile(data, rows)
        else:
            out[np.repeat(at - offsets[:-1], lengths[:, k]) + np.arange(len(data))] = data
    return out, starts


def _format(schema: pa.Schema, loss_role: str):
    """Rows come in order of conversation and turn; a block is a run of one conversation's turns within a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for step in steps(batch, "text", BLOCK_BYTES):
                n = step.num_rows
                roles, texts = (pc.fill_null(step.column(c), "") for c in ("role", "text"))
                data, starts = assemble([START, escape_role(roles), b"\n", escape_text(texts), END], n)
                turn = starts[:-1].reshape(n, 5)
                ids = step.column("conv_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                differ = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
                new = differ | (known[1:] != known[:-1])
                cuts = np.concatenate([[0], np.flatnonzero(new) + 1]).astype(np.int64)
                ends = np.append(cuts[1:], n)
                offsets = np.append(turn[cuts, 0], starts[-1])
                blocks = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())
                mask = pc.equal(roles, loss_role).to_numpy(zero_copy_only=False)
                spans = [np.stack([turn[s:e, 3], turn[s:e, 4]], 1)[mask[s:e]].ravel() - turn[s, 0] for s, e in zip(cuts, ends)]
                yield arrow(
                    schema, conv_id=step.column("conv_id").take(pa.array(cuts)), task=[task] * len(cuts), seq=list(range(seq, seq + len(cuts))),
                    turns=ends - cuts, formatted=blocks, loss_bytes=[x.tolist() for x in spans],
                )
                seq += len(cuts)

    return run


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """Blocks of formatted conversations: conv_id, task, seq, turns, formatted, loss_bytes.

    A conversation is its blocks in order of (task, seq). loss_bytes holds start, end, start, end ... of the
    loss role's texts within the block's bytes. Turns go by turn number, nulls first; equal ones by role, then
    text. Null roles and texts are empty, a null conversation is one of its own, repeated rows are turns each; a very long text is one
    block of its own; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    own = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    dealt = own.withColumn("lead", F.substring("text", 1, 32)).repartitionByRange("conv_id", "turn", "role", "lead")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "text").drop("lead", "turn")
    out = own.select("conv_id").schema
    for name, kind in (("task", "int"), ("seq", "long"), ("turns", "long"), ("formatted", "string"), ("loss_bytes", "array<long>")):
        out = out.add(name, DataType.fromDDL(kind))
    return ordered.mapInArrow(_format(to_arrow_schema(out), loss_role), out)


def read_block(formatted: str) -> tuple[list[str], list[str]]:
    """Roles and texts of a block, read from its control strings and unescaped."""
    turns = formatted.split(START.decode())[1:]
    cut = [t.index("\n") for t in turns]
    roles = unescape_role(pa.array([t[:c] for t, c in zip(turns, cut)], pa.string())).to_pylist()
    texts = unescape_text(pa.array([t[c + 1 : -len(END)] for t, c in zip(turns, cut)], pa.string())).to_pylist()
    return roles, texts


def _digest(schema: pa.Schema):
    """Blocks come in order of conversation, task and seq; hashes run on, one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv, state = nothing, None

        def row():
            turns, turns_sha, chars, loss_sha, formatted = state
            return arrow(schema, conv_id=pa.array([conv], schema.field("conv_id").type), n_turns=[turns], turns_sha256=[turns_sha.hexdigest()], loss_chars=[chars], loss_sha256=[loss_sha.hexdigest()], formatted_chars=[formatted])

        done: list[pa.RecordBatch] = []
        for batch in batches:
            for i, conv_id in enumerate(batch.column("conv_id").to_pylist()):
                if conv is nothing or conv_id != conv:
                    if state:
                        done.append(row())
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted, spans = batch.column("formatted")[i].as_py(), batch.column("loss_bytes")[i].as_py()
                roles, texts = read_block(formatted)
                state[0] += len(roles)
                state[1].update("".join(f"{r}\n{t}\n" for r, t in zip(roles, texts)).encode())
                data = formatted.encode()
                learnt = unescape_text(pa.array([data[s:e].decode() for s, e in zip(spans[::2], spans[1::2])], pa.string())).to_pylist()
                state[2] += sum(map(len, learnt))
                state[3].update("".join(learnt).encode())
                state[4] += len(formatted)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if state:
            yield row()

    return run


def chat_digests(blocks: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted blocks: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest over a whole conversation is sequential: its blocks, in order, go through one task with one of them in memory, however long it is.
    Blocks are taken as format_chats gives them, ties as it ordered them; a null conversation has a row of its own; repeated blocks would
    count twice; an empty table gives no rows; other columns are not read.
    """
    out = blocks.select("conv_id").schema
    for name, kind in (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")):
        out = out.add(name, DataType.fromDDL(kind))
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq")
    return ordered.select("conv_id", "formatted", "loss_bytes").mapInArrow(_digest(to_arrow_schema(out)), out)
