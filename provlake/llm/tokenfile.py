"""Token-id output with Elias-Fano encoded document boundaries.

The ids of all documents, in ascending order of doc_id, are one concatenated array, kept in
segments of about `size` ids. Where each document of a segment ends is an Elias-Fano code: the
low bits of the ends are packed, their high bits stand in unary, and every 64th one bit of the
high part has its position noted, so select() finds any end without a table of offsets.
Segments know their place within their partition; only partition totals are summed over the
whole corpus.

A segment is one row of a Parquet table: part, seg, first (ids before it in its part),
doc_ids, width (bytes of an id), ids, n, low_bits, low, high, marks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blocks, utf8, written
from .tokens import encode_rows, tokenizer

_EVERY = 64


class EliasFano:
    """An ascending sequence of non-negative integers (repeats allowed) in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, marks: bytes):
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, bits, np.packbits(low.ravel()).tobytes(), np.packbits(high).tobytes(), ones[::_EVERY].astype("<u4").tobytes())

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at positions `i`: each one bit is sought from the nearest mark before it, a byte at a time for all at once."""
        i = np.asarray(i, np.int64)
        high, low = np.frombuffer(self.high, np.uint8), np.frombuffer(self.low, np.uint8)
        mark = np.frombuffer(self.marks, "<u4")[i // _EVERY].astype(np.int64)
        byte = mark // 8
        rest = i % _EVERY + np.bitwise_count(high[byte].astype(np.int64) >> 8 - mark % 8)  # with the ones of its byte before the mark
        on = np.arange(len(i))
        while len(on):
            ones = np.bitwise_count(high[byte[on]])
            further = rest[on] >= ones
            on, ones = on[further], ones[further]
            rest[on] -= ones
            byte[on] += 1
        bits = np.unpackbits(high[byte].reshape(-1, 1), axis=1)
        one = byte * 8 + (np.cumsum(bits, axis=1) > rest[:, None]).argmax(1)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (one - i << self.low_bits) + (low[at >> 3] >> (7 - at & 7).astype(np.uint8) & 1).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


def write(docs: DataFrame, path: str, end: int = 2, size: int = 1 << 20) -> DataFrame:
    """Write the ids of `docs` (doc_id, text; others ignored), `end` after each document, and return the table of segments.

    A null or empty text is just its end id. Null ids come first; rows that share an id stand
    together, ordered by text. An empty table gives no segments. A document longer than `size`
    ids is a segment of its own.
    """
    kind = docs.schema["doc_id"].dataType
    limit = 1 << 22

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        width = 2 if max(tokenizer(path).get_vocab_size(), end + 1) <= 1 << 16 else 4
        seg = first = held = 0
        names: list[pa.Array] = []
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            at = np.concatenate(ends)
            code = EliasFano.of(at)
            flat = np.concatenate(ids).astype(f"<u{width}").tobytes()
            doc_ids = pa.concat_arrays(names)
            row = [[part], [seg], [first], pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), [width], [flat], [code.n], [code.low_bits], [code.low], [code.high], [code.marks]]
            types = [pa.int32(), pa.int32(), pa.int64(), None, pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) if t else x for x, t in zip(row, types)], ["part", "seg", "first", "doc_ids", "width", "ids", "n", "low_bits", "low", "high", "marks"])

        for batch in batches:
            for rows in blocks(iter([batch]), "text", limit):
                got, at = encode_rows(path, *utf8(rows.column("text")))
                ends.append(at[1:] + np.arange(1, len(at)) + held)
                ids.append(np.insert(got, at[1:], end))
                names.append(rows.column("doc_id"))
                held += len(ids[-1])
                if held >= size:
                    yield segment()
                    seg, first, held, names, ids, ends = seg + 1, first + held, 0, [], [], []
        if held:
            yield segment()

    schema = f"part int, seg int, first long, doc_ids array<{kind.simpleString()}>, width int, ids binary, n int, low_bits int, low binary, high binary, marks binary"
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, schema), "tokens")


def read_back(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the segments."""
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    totals = segments.groupBy("part").agg(F.sum(F.octet_length("ids") / F.col("width")).cast("long").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["doc_ids"]).to_pylist()):
                ends = EliasFano(row["n"], row["low_bits"], row["low"], row["high"], row["marks"]).select(np.arange(row["n"]))
                starts = np.r_[0, ends[:-1]]
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids").slice(i, 1).flatten(), pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(starts + row["first"]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "start", "n_tokens", "ids_crc32"])

    found = segments.mapInArrow(run, f"doc_id {kind}, part int, start long, n_tokens long, ids_crc32 long")
    return found.join(bases, "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def query(docs: DataFrame, path: str) -> DataFrame:
    return read_back(write(docs, path))
