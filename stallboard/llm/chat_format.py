"""Operator 9: chat formatting by columnar byte assembly.

A turn is written as ``<|role|>``, newline, text, ``<|end|>``, newline. Inside roles and texts a
backslash is written twice, ``<|`` as ``<\\|`` and ``>`` in a role as ``\\>``, so neither can
ever hold a control string and ``parse`` gets every byte back. A batch is assembled without a loop over its turns: segment
lengths, their cumulative sums and scatter indices are computed in numpy, and headers, contents
and escapes are copied into one preallocated buffer, which becomes the Arrow column.

Conversations are cut into pieces: one row per conversation and Arrow batch, numbered by
``piece``, so a conversation of any length is never held whole. ``loss_start`` and ``loss_end``
are byte spans of the piece that count for training: the escaped assistant texts.

Nulls and empties: a null text or role is empty; null turns come first; a null conv_id is a
conversation of its own. Turns with the same number are ordered by role and text, so repeated
rows stand next to each other and all stay. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallboard.llm.common import byte_slices, parallelism, utf8

# The control strings of the template.
OPEN = b"<|"
ROLE_END = b"|>\n"
TURN_END = b"<|end|>\n"
LEARNED_ROLE = "assistant"
PIECES = "conv_id long, piece long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"
ESCAPE = re.compile(rb"\\(.)", re.S)


def _escapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """1 at the bytes of texts that get a backslash in front: a backslash, and the bar of ``<|``."""
    out = (data == 0x5C).astype(np.int64)
    if len(data) > 1:
        out[1:] |= (data[1:] == 0x7C) & (data[:-1] == 0x3C)
    first = offsets[:-1][np.diff(offsets) > 0]
    out[first] = data[first] == 0x5C  # a bar that begins a row follows no "<" of its own
    return out


def _place(out: np.ndarray, at: np.ndarray, offsets: np.ndarray, data: np.ndarray, extra: np.ndarray) -> None:
    """Scatters row contents to ``out`` from ``at`` on, a backslash before each byte marked in ``extra``."""
    rows = np.repeat(np.arange(len(at)), np.diff(offsets))
    added = np.cumsum(extra)
    before = np.concatenate(([0], added))[offsets[:-1]]
    target = at[rows] + (np.arange(len(data)) - offsets[rows]) + added - before[rows]
    out[target] = data
    out[target[extra > 0] - 1] = 0x5C


def _row_extras(extra: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(extra)))[offsets])


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffer of all formatted turns, and each turn's and each text's first byte in it
    (both with one closing entry: the buffer's length; the text's end is 8 bytes before the next turn)."""
    role_off, role = utf8(roles)
    text_off, text = utf8(texts)
    role_extra = _escapes(role, role_off) | (role == 0x3E)
    text_extra = _escapes(text, text_off)
    role_len = np.diff(role_off) + _row_extras(role_extra, role_off)
    text_len = np.diff(text_off) + _row_extras(text_extra, text_off)
    head = len(OPEN) + role_len + len(ROLE_END)
    turn = np.concatenate(([0], np.cumsum(head + text_len + len(TURN_END))))
    out = np.empty(int(turn[-1]), np.uint8)
    begin = turn[:-1]
    for string, at in ((OPEN, begin), (ROLE_END, begin + head - len(ROLE_END)), (TURN_END, turn[1:] - len(TURN_END))):
        out[at[:, None] + np.arange(len(string))] = np.frombuffer(string, np.uint8)
    _place(out, begin + len(OPEN), role_off, role, role_extra)
    _place(out, begin + head, text_off, text, text_extra)
    return out, turn, np.append(begin + head, turn[-1])


def format_conversations(turns: DataFrame) -> DataFrame:
    """Pieces of all conversations: formatted text and loss spans (see the module's head)."""
    ordered = (turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                            F.col("text").cast("string"))
               .repartition(parallelism(turns.sparkSession), F.xxhash64(F.col("conv_id")))
               .sortWithinPartitions("conv_id", "turn", "role", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = object(), 0
        for batch in byte_slices(batches, "text", 8 << 20):
            buffer, turn, content = assemble(batch.column(2), batch.column(3))
            conv = batch.column(0).to_pylist()
            learned = np.array([r == LEARNED_ROLE for r in batch.column(2).to_pylist()], bool)
            cuts = [0, *(k for k in range(1, len(conv)) if conv[k] != conv[k - 1]), len(conv)]
            pieces = []
            for a in cuts[:-1]:
                piece = piece + 1 if conv[a] == last else 0
                last = conv[a]
                pieces.append(piece)
            starts, ends, spans = [], [], [0]
            for a, b in zip(cuts, cuts[1:]):
                own = np.flatnonzero(learned[a:b]) + a
                starts.append(content[own] - turn[a])
                ends.append(turn[own + 1] - len(TURN_END) - turn[a])
                spans.append(spans[-1] + len(own))
            edge = turn[cuts].astype(np.int64)
            text = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(edge), pa.py_buffer(buffer)])
            span = pa.array(spans, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv[a] for a in cuts[:-1]], pa.int64()), pa.array(pieces, pa.int64()),
                 pa.array(np.diff(cuts), pa.int64()), text.cast(pa.string()),
                 pa.ListArray.from_arrays(span, pa.array(np.concatenate(starts), pa.int64())),
                 pa.ListArray.from_arrays(span, pa.array(np.concatenate(ends), pa.int64()))],
                ["conv_id", "piece", "n_turns", "formatted", "loss_start", "loss_end"])

    return ordered.mapInArrow(run, PIECES)


def unescape(data: bytes) -> bytes:
    return ESCAPE.sub(rb"\1", data)


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted piece."""
    out, at = [], 0
    while at < len(formatted):
        role_end = formatted.index(ROLE_END, at)
        text_end = formatted.index(OPEN, role_end + len(ROLE_END))
        if formatted[at:at + 2] != OPEN or formatted[text_end:text_end + len(TURN_END)] != TURN_END:
            raise ValueError("not a formatted conversation")
        out.append((unescape(formatted[at + len(OPEN):role_end]).decode(), unescape(formatted[role_end + len(ROLE_END):text_end]).decode()))
        at = text_end + len(TURN_END)
    return out


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation, from its formatted pieces in order: turns, digests, learned characters.

    Pieces stream through one running state, so memory does not grow with a conversation."""
    ordered = (pieces.repartition(parallelism(pieces.sparkSession), F.xxhash64(F.col("conv_id")))
               .sortWithinPartitions("conv_id", "piece"))
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: list | None = None

        def close() -> None:
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def batch_out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    close()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = row["formatted"].encode()
                for role, text in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for a, b in zip(row["loss_start"], row["loss_end"]):
                    learned = unescape(formatted[a:b])
                    state[3] += len(learned.decode())
                    state[4].update(learned)
                state[5] += len(row["formatted"])
            yield batch_out()
            done.clear()
        close()
        yield batch_out()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
