"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>` role `\\n` text `<|im_end|>\\n`. For a batch of turns the lengths of all segments, their cumulative offsets
and the place of every byte are worked out in numpy, and headers and contents are copied into one buffer that becomes the Arrow column.
`<|`, with any backslashes between, gets one more backslash inside texts and roles, so no marker can arise there and reading back drops
it again; in roles a backslash and a line feed are written as two characters. The loss mask is a list of byte spans: the texts of the assistant.

A conversation is written as numbered chunks of about CHUNK_BYTES in the order of its turns, so one of any length never has to fit into a
row, and beside a chunk's bytes memory only grows with BLOCK_BYTES.

Defined cases: null text and null role count as empty; rows of equal turn follow by role and text, repeated rows stay; a null
conv_id is one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmark.llm.common import steps, text_bytes

START, BREAK, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LOSS_ROLE = "assistant"
#: Text that one chunk takes, longer single texts alone, and bytes that are copied at a time.
CHUNK_BYTES, BLOCK_BYTES = 16 << 20, 1 << 20
FORMATTED = "conv_id long, chunk long, n_turns long, formatted binary, loss_starts array<long>, loss_ends array<long>"
_ESCAPED = re.compile(rb"<\\(\\*)\|")


def escape_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Indices of each '<' that backslashes or nothing, and then '|', follow in the same text."""
    bars = np.flatnonzero(data == ord("|"))
    before = bars - 1
    back = np.flatnonzero((before >= 0) & (data[before] == ord("\\")))
    while len(back):
        before[back] -= 1
        back = back[before[back] >= 0]
        back = back[data[before[back]] == ord("\\")]
    text = np.searchsorted(offsets, bars, "right") - 1
    return before[(before >= offsets[text]) & (data[before] == ord("<"))]


def _scatter(out: np.ndarray, data: np.ndarray, own: np.ndarray, places: np.ndarray, at: np.ndarray) -> None:
    """Copies text k, data[own[k]:own[k+1]], to out from at[k] on, with a backslash after each of `places`; some of the data at a time, so that a long text needs little beside itself."""
    before = np.searchsorted(places, own[:-1])
    for lo in range(0, len(data), BLOCK_BYTES):
        hi = min(len(data), lo + BLOCK_BYTES)
        first, last = np.searchsorted(own, (lo, hi - 1), "right") - 1
        rows = np.arange(first, last + 1)
        sizes = np.minimum(own[rows + 1], hi) - np.maximum(own[rows], lo)
        inner = places[slice(*np.searchsorted(places, (lo, hi)))]
        extra = np.zeros(hi - lo + 1, np.int64)
        extra[inner - lo + 1] = 1
        target = np.arange(lo, hi) + np.cumsum(extra)[:-1] + (np.searchsorted(places, lo) + np.repeat(at[rows] - own[rows] - before[rows], sizes))
        out[target] = data[lo:hi]
        out[target[inner - lo] + 1] = ord("\\")


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, end to end; the offset of each turn; starts and ends of the texts."""
    role_names = [(r or "").replace("\\", "\\\\").replace("\n", "\\n") for r in roles.to_pylist()]
    parts = []
    for column in (pa.array(role_names, pa.string()), texts):
        data, offsets = text_bytes(column)
        parts.append((data, offsets, escape_places(data, offsets)))
    added = [np.bincount(np.searchsorted(o, e, "right") - 1, minlength=len(o) - 1) if len(e) else np.zeros(len(o) - 1, np.int64) for _, o, e in parts]
    sizes = [np.diff(o) + a for (_, o, _), a in zip(parts, added, strict=True)]
    turn = len(START) + len(BREAK) + len(END) + sizes[0] + sizes[1]
    offsets = np.concatenate(([0], np.cumsum(turn))).astype(np.int64)
    out = np.empty(offsets[-1], np.uint8)
    role_at = offsets[:-1] + len(START)
    text_at = role_at + sizes[0] + len(BREAK)
    for at, constant in ((offsets[:-1], START), (role_at + sizes[0], BREAK), (text_at + sizes[1], END)):
        out[at[:, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)
    for (data, own, places), at in zip(parts, (role_at, text_at), strict=True):
        _scatter(out, data, own, places, at)
    return out, offsets, text_at, text_at + sizes[1]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of at most CHUNK_BYTES of text, or a single longer one."""
    sizes = np.asarray(pa.compute.binary_length(batch["text"]).fill_null(0)).astype(np.int64) + 64
    for first, last in steps(sizes, CHUNK_BYTES):
        yield batch.slice(first, last - first)


def format_chats(turns: DataFrame) -> DataFrame:
    """Chunks of formatted conversations, each conversation's in one partition and in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, begun = None, 0, False
        for batch in (part for whole in batches for part in _slices(whole)):
            out, offsets, text_starts, text_ends = assemble(batch["role"], batch["text"])
            ids = batch["conv_id"].to_pylist()
            first = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]]
            numbers = [0] * len(first)
            chunk = chunk + 1 if begun and ids[0] == at else 0
            numbers[0], begun, at = chunk, True, ids[-1]
            chunk = numbers[-1]
            cut = np.array([*first, len(ids)])
            loss = np.flatnonzero([r == LOSS_ROLE for r in batch["role"].to_pylist()])
            base = offsets[cut[:-1]][np.searchsorted(cut, loss, "right") - 1]
            lists = pa.array(np.searchsorted(loss, cut), pa.int32())
            formatted = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets[cut]), pa.py_buffer(out)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[k] for k in first], pa.int64()),
                    pa.array(numbers, pa.int64()),
                    pa.array(np.diff(cut), pa.int64()),
                    formatted,
                    pa.ListArray.from_arrays(lists, pa.array(text_starts[loss] - base, pa.int64())),
                    pa.ListArray.from_arrays(lists, pa.array(text_ends[loss] - base, pa.int64())),
                ],
                ["conv_id", "chunk", "n_turns", "formatted", "loss_starts", "loss_ends"],
            )

    own = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(write, FORMATTED)


def _plain(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", text)


def read_turns(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn, as they were before formatting."""
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix(START).partition(BREAK)
        yield re.sub(rb"\\([\\n])", lambda m: b"\n" if m[1] == b"n" else b"\\", _plain(role)), _plain(text)


def digest_chats(formatted: DataFrame) -> DataFrame:
    """Figures of each conversation, read back from its formatted chunks; formatted: the rows of format_chats() in their order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state: list = []

        def done() -> tuple:
            conv_id, n, turns, chars, loss, total = state
            return conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for batch in batches:
            rows = []
            for conv_id, chunk, data, starts, ends in zip(*(batch[c].to_pylist() for c in ("conv_id", "chunk", "formatted", "loss_starts", "loss_ends")), strict=True):
                if chunk == 0:
                    if state:
                        rows.append(done())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(data):
                    state[1] += 1
                    state[2].update(b"%b\n%b\n" % (role, text))
                for a, b in zip(starts, ends, strict=True):
                    text = _plain(data[a:b])
                    state[3] += len(text.decode())
                    state[4].update(text)
                state[5] += len(data.decode())
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_digests)
        if state:
            yield pa.RecordBatch.from_pylist([dict(zip(names, done(), strict=True))], schema=_digests)

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_digests = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
