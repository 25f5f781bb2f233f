"""Blocks of documents that ask parts of a hash space: one packed row for a block and part.

A block is a run of rows of a partition. What it asks of, or gets from, a part of the hash space
travels as one compressed row, so a shuffle carries no row for each word occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from .common import blocks

ROW = "block long, part int, payload binary"


def row(block: int, part: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([payload], pa.binary())], ["block", "part", "payload"])


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Several packed rows as one batch."""
    block, part, payload = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(part, pa.int32()), pa.array(payload, pa.binary())], ["block", "part", "payload"])


def spread_over(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the hash space that owns each key; ascending keys have ascending parts."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """From rows sorted by part and block: each part with its blocks and what they sent, one part at a time."""
    part, got = None, []
    for b, p, payload in rows_of(batches):
        if p != part and got:
            yield part, got
            got = []
        part = p
        got.append((b, payload))
    if got:
        yield part, got


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("block", "part", "payload")))


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned 32-bit arrays, by byte planes, compressed."""
    sizes = np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()
    planes = (np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays)
    return zstandard.compress(b"".join([sizes, *planes]), 3)


def unpack(payload: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(payload), np.uint8)
    n = int(raw[:4].view("<u4")[0])
    sizes = raw[4 : 4 + 4 * n].view("<u4").astype(np.int64)
    out, at = [], 4 + 4 * n
    for s in sizes.tolist():
        out.append(np.ascontiguousarray(raw[at : at + 4 * s].reshape(4, s).T).view("<u4").ravel())
        at += 4 * s
    return out


def pack64(*arrays: np.ndarray) -> bytes:
    """64-bit arrays, each as its low and high halves."""
    halves = (x for a in arrays for x in (np.ascontiguousarray(a).view(np.uint64) & np.uint64(0xFFFFFFFF), np.ascontiguousarray(a).view(np.uint64) >> np.uint64(32)))
    return pack(*halves)


def unpack64(payload: bytes) -> list[np.ndarray]:
    parts = unpack(payload)
    return [low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32) for low, high in zip(parts[::2], parts[1::2])]


def numbered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of about `limit` text bytes, with numbers that a rerun over the same partition (the last column) repeats."""
    for i, batch in enumerate(blocks(batches, "text", limit)):
        yield (batch.column(batch.num_columns - 1)[0].as_py() << 32) + i, batch


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """From rows sorted by block and part: each block with its own row (part -1) and what the parts sent, in order."""
    block, head, got = None, None, []
    for b, p, payload in rows_of(batches):
        if b != block:
            if head is not None:
                yield block, head, got
            if p != -1:
                raise RuntimeError("documents changed between two reads of the same partition")
            block, head, got = b, payload, []
        else:
            got.append((p, payload))
    if head is not None:
        yield block, head, got


def with_batch(batch: pa.RecordBatch, payload: bytes) -> bytes:
    """A payload with an Arrow batch, compressed, before it."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    head = sink.getvalue().to_pybytes()
    return len(head).to_bytes(8, "little") + head + payload


def batch_of(payload: bytes) -> tuple[pa.RecordBatch, bytes]:
    size = int.from_bytes(payload[:8], "little")
    return pa.ipc.open_stream(payload[8 : 8 + size]).read_next_batch(), payload[8 + size :]


def with_column(column: pa.Array, payload: bytes) -> bytes:
    """A payload with an Arrow column before it."""
    return with_batch(pa.RecordBatch.from_arrays([column], ["c"]), payload)


def column_of(payload: bytes) -> tuple[pa.Array, bytes]:
    batch, rest = batch_of(payload)
    return batch.column(0), rest


def joined(chunks: list[bytes]) -> bytes:
    """Several payloads as one."""
    return b"".join(len(x).to_bytes(8, "little") + x for x in chunks)


def split(payload: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(payload):
        size = int.from_bytes(payload[at : at + 8], "little")
        out.append(payload[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def together(sent: list[tuple[int, int, bytes]], of: int) -> list[tuple[int, int, bytes]]:
    """A block's rows for `of` neighbouring parts as one row for them all."""
    out: dict[int, list[bytes]] = {}
    for _, part, payload in sent:
        out.setdefault(part // of, [b""] * of)[part % of] = payload
    return [(sent[0][0], p, joined(x)) for p, x in out.items()]


def one_by_one(got: list[tuple[int, bytes]], of: int) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The parts of together() again: each with what the blocks sent it."""
    for i in range(of):
        mine = [(b, split(x)[i]) for b, x in got]
        if any(x for _, x in mine):
            yield i, [(b, x) for b, x in mine if x]
