"""BPE encoding and decoding over a distinct-word table.

Blocks of documents are cut into words (pieces that the tokenizer encodes on their own). Each
block sends its distinct words, packed by hash range, to the part that owns the range, which
encodes every distinct word of the corpus once; the ids come back to the block and are joined to
its word positions. What is shuffled is one packed row for a block and part, never a row for a
word occurrence. Decoding joins ids with the id-to-piece table, whose size the vocabulary bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, distinct_spans, utf8
from .packed import ROW, by_block, column_of, numbered, pack, row, rows_of, unpack, with_column
from .tokens import decode_ids, encode_words, piece_starts, spread

def _distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes; starts and ends of the distinct words by ascending hash; hashes; words by position; words in each row."""
    data, off = utf8(column)
    starts = piece_starts(data, off)
    ends = np.r_[starts[1:], len(data)][: len(starts)]
    keys, first, which = distinct_spans(data, starts, ends)
    return data, starts[first], ends[first], keys, which, np.diff(np.searchsorted(starts, off))


def encode(docs: DataFrame, path: str, parts: int | None = None, limit: int = 1 << 22, decoded: bool = False) -> DataFrame:
    """(doc_id, ids), with `decoded` also text, what the ids decode to: one row for each row of `docs` (doc_id, text; others ignored).

    ids are little-endian unsigned 32-bit integers, as the tokenizers library gives them with
    add_special_tokens=False. A null or empty text has none. Null and repeated ids are kept as
    they are; an empty table gives no rows. `docs` is read twice and has to give the same
    partitions both times, as files do; a mismatch raises.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.spark_partition_id().alias("_part"))
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in numbered(batches, limit):
            data, a, b, keys, _, _ = _distinct(batch.column("text"))
            part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                i, j = cuts[p], cuts[p + 1]
                n = b[i:j] - a[i:j]
                at = np.arange(n.sum()) + np.repeat(a[i:j] - (np.cumsum(n) - n), n)
                yield row(block, p, _pack_words(n, data[at].tobytes()))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        here = None
        for block, part, payload in rows_of(batches):
            if part != here:  # rows come part by part, and no two parts share a word
                known, here = {}, part
            found = _unpack_words(payload)
            new = [w for w in found if w not in known]
            if new:
                known.update(zip(new, encode_words(path, new)))
            ids = [known[w] for w in found]
            yield row(block, part, pack(np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4")))

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in numbered(batches, limit):
            _, _, _, keys, which, n = _distinct(batch.column("text"))
            order = np.argsort(-np.bincount(which, minlength=len(keys)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(keys), np.int64)
            rank[order] = np.arange(len(keys))
            yield row(block, -1, with_column(batch.column("doc_id"), pack(n, order, rank[which])))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, head, got in by_block(batches):
            out = _assembled(head, [x for _, x in got])
            yield _decoded(out, path) if decoded else out

    sent = docs.mapInArrow(words, ROW).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(encoded, ROW)
    there = docs.mapInArrow(positions, ROW)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return sent.union(there).repartition("block").sortWithinPartitions("block", "part").mapInArrow(joined, f"doc_id {kind}, ids binary" + ", text string" * decoded)


def _pack_words(n: np.ndarray, flat: bytes) -> bytes:
    head = pack(n)
    return len(head).to_bytes(4, "little") + head + zstandard.compress(flat, 3)


def _unpack_words(payload: bytes) -> list[bytes]:
    size = int.from_bytes(payload[:4], "little")
    (n,) = unpack(payload[4 : 4 + size])
    flat = zstandard.decompress(payload[4 + size :])
    ends = np.cumsum(n.astype(np.int64))
    return [flat[a:b] for a, b in zip((ends - n).tolist(), ends.tolist())]


def _assembled(head: bytes, got: list[bytes]) -> pa.RecordBatch:
    """The ids of a block's rows: the words of its parts, in order of hash, joined to its positions."""
    doc_id, rest = column_of(head)
    n, order, rank = unpack(rest)
    found = [unpack(x) for x in got]
    counts = np.concatenate([x[0] for x in found] or [np.zeros(0, "<u4")]).astype(np.int64)
    if len(counts) != len(order):
        raise RuntimeError("documents changed between two reads of the same partition")
    ids, ends = spread(np.concatenate([x[1] for x in found] or [np.zeros(0, "<u4")]), counts, order[rank].astype(np.int64))
    offsets = np.r_[0, ends][np.r_[0, np.cumsum(n, dtype=np.int64)]] * 4
    raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
    return pa.RecordBatch.from_arrays([doc_id, raw.cast(pa.binary())], ["doc_id", "ids"])


def _decoded(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    texts = [decode_ids(path, np.frombuffer(x.as_py() or b"", "<u4")) for x in batch.column("ids")]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (doc_id, ids) with the decoded text beside it, special tokens included; null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "ids", 1 << 23):
            yield _decoded(batch, path)

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def query(docs: DataFrame, path: str) -> DataFrame:
    both = encode(docs, path, decoded=True)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )
