"""Exact substring dedup by bucket-pointer refinement over a sample of suffixes.

Every byte of a `size`-byte string that starts at two places or more is to be removed. Sorting
all suffixes is not needed for that: each window of `size` bytes designates one suffix within
it, the one whose initial bucket, its first `gram` bytes, has the least hash. Equal windows
designate suffixes of equal buckets at the same offset in the window. A suffix stands for the
run of windows that designate it, an interval of such offsets.

A bucket pointer is the identifier of the bucket that the bytes at some offset fall into. All
suffixes start in the bucket of their own q-gram; then each bucket is refined by the pointers of
the bytes at later offsets, once for each node of a tree over the offsets (all of them, about
sqrt(span) at a time, single ones):

* the pointer of a node is the bytes that all its windows have in common; suffixes that no other
  suffix joins there have no repeated window in the node and are done with;
* beside it each suffix shows the pointer of all the bytes under its own windows in the node. If
  another suffix has the same, all these windows are repeated;
* where a bucket holds several kinds of the latter, one suffix of each kind goes on to the
  node's children, where the pointers of the parts are made from the same running sums.

A refinement is a sort of pairs of pointers. It is dealt over the parts of the hash space:
a block of documents asks a part about its distinct pairs in one packed row, and the answer is a
few bits for each. So no bucket is ever gathered, a string in a third of all documents is one
entry for each block, and what is repeated whole ends in the first refinement.

The pointers of common bytes only say which suffixes meet: where two of them agree by chance, or by
design, there is more to do and nothing else. What counts as repeated is told by the other kind,
96 bits of a BLAKE2b digest over all bytes of the windows, under a salt drawn for each run, so that no
texts can be made to agree. Pointers are digests of the bytes themselves, made anew for each node, and
stand for the bucket numbers that refinement by sorting in memory would hand from round to round.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, eights, mixed, utf8, written, written_apart
from .packed import ROW, batch_of, by_block, by_part, numbered, pack, pack64, rows, spread_over, unpack, unpack64, with_batch

#: The base of the running sums.
_GRAM = 0x9FB21C651E98DF25
#: Of the pointers of common bytes, what is sent; and of the second part of a digest.
_SENT, _HALF = np.uint64((1 << 64) - (1 << 16)), np.uint64((1 << 64) - (1 << 32))
_STEP = 1 << 17
_POS = np.uint64((1 << 24) - 1)
#: Rows with spans have this part or more; a part of the hash space is below it.
_SPANS = 1 << 30
_REPEATED, _GOES_ON = 1, 2


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    power = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)], dtype=np.uint64)
    return power(base), power(pow(base, -1, 1 << 64))


def _running(part: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over the mixed 8 bytes from each position, and the factors that shift them to one origin."""
    up, back = _powers(base, 1 << max(16, (len(part) - 1).bit_length()))
    return np.r_[np.uint64(0), np.cumsum(mixed(eights(part).astype(np.uint64)) * up[: len(part)], dtype=np.uint64)], back


def pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit identifier of the bytes of each range of 8 bytes or more; other bytes can be made to share it."""
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(starts, kind="stable")
    cuts = np.r_[0, np.flatnonzero(np.diff(starts[order] // _STEP)) + 1, len(order)]
    for i, j in zip(cuts, cuts[1:]):
        if i < j:
            mine = order[i:j]
            first = starts[mine[0]]
            sums, back = _running(data[first : ends[mine].max()], base)
            a, b = starts[mine] - first, ends[mine] - first
            out[mine] = mixed((sums[b - 7] - sums[a]) * back[a] ^ mixed((b - a).astype(np.uint64)))
    return out


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for the bytes of each range, of 64 and of 32 bits (the upper ones), which no other bytes share."""
    bytes_ = memoryview(np.ascontiguousarray(data))
    found = b"".join([blake2b(bytes_[a:b], digest_size=16, salt=salt).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    out = np.frombuffer(found, "<u8").reshape(-1, 2)
    return out[:, 0].copy(), out[:, 1] & _HALF


def _designated(data: np.ndarray, off: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first window start, number of windows, position (both from the row's start) and bucket of the suffixes that windows designate."""
    span = size - gram + 1
    found = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)]
    for c in range(0, len(data) - size + 1, _STEP):
        part = data[c : c + _STEP + size - 1]
        sums, back = _running(part, _GRAM)
        n = len(part) - gram + 1
        bucket = mixed((sums[gram - 7 :][:n] - sums[:n]) * back[:n])
        tiles = np.full(-(-n // span) * span, np.uint64((1 << 64) - 1))
        tiles[:n] = bucket & ~_POS | np.arange(n, dtype=np.uint64)
        tiles = tiles.reshape(-1, span)
        ahead = np.minimum.accumulate(tiles, axis=1).ravel()
        behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
        many = min(_STEP, len(part) - size + 1)
        chosen = (np.minimum(behind[:many], ahead[span - 1 :][:many]) & _POS).astype(np.int64)
        # a run of windows ends where the suffix or the row changes; windows across rows are none
        starts = np.flatnonzero(np.r_[True, chosen[1:] != chosen[:-1]])
        lows = np.searchsorted(off, c, "right") - 1
        edges = off[lows : np.searchsorted(off, c + many, "left")] - c
        starts = np.union1d(starts, np.r_[edges[edges > 0], np.maximum(edges - size + 1, 0)])
        starts = starts[starts < many]
        ends = np.r_[starts[1:], many]
        row = np.searchsorted(off, starts + c, "right") - 1
        ends = np.minimum(ends, off[row + 1] - c - size + 1)
        ok = ends > starts
        starts, ends, row = starts[ok], ends[ok], row[ok]
        at = chosen[starts]
        found.append((row, starts + c - off[row], ends - starts, at + c - off[row], bucket[at]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _asks(block: int, one: np.ndarray, other: np.ndarray, rest: np.ndarray, parts: int) -> tuple[list[tuple[int, int, bytes]], np.ndarray, np.ndarray]:
    """The block's distinct pointers, of common bytes and of all bytes (other, rest), as packed rows for their parts; which of them each is; the first place of each."""
    order = np.lexsort((rest, other, one))
    a, b, c = one[order], other[order], rest[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]) if len(a) else np.zeros(0, np.int64)
    which = np.empty(len(a), np.int64)
    n = np.diff(np.r_[at, len(a)])
    which[order] = np.repeat(np.arange(len(at)), n)
    a, b, c = a[at], b[at], c[at]
    cuts = np.searchsorted(spread_over(a, parts), np.arange(parts + 1))
    sent = []
    for p in np.flatnonzero(np.diff(cuts)).tolist():
        s = slice(cuts[p], cuts[p + 1])
        sent.append((block, p, pack64(np.r_[a[s][:1], np.diff(a[s])], b[s] if b[s].any() else b[:0], c[s] | np.minimum(n[s], 2).astype(np.uint64))))
    return sent, which, order[at]


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One refinement of the buckets of each part: two bits for all that a block asked about."""
    for part, got in by_part(batches):
        asked = [unpack64(x) for _, x in got]
        size = [len(x[0]) for x in asked]
        one = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in asked])
        other = np.concatenate([x[1] if len(x[1]) else np.zeros(len(x[0]), np.uint64) for x in asked])
        last = np.concatenate([x[2] for x in asked])
        order = np.lexsort((last & _HALF, other, one))
        a, b, c = one[order], other[order], last[order]
        bucket = np.r_[True, a[1:] != a[:-1]]
        kind = bucket | np.r_[True, (b[1:] != b[:-1]) | (c[1:] & _HALF != c[:-1] & _HALF)]
        at = np.flatnonzero(kind)
        many = np.add.reduceat(c & ~_HALF, at) > 1
        kinds = np.add.reduceat(kind.astype(np.int64), np.flatnonzero(bucket))
        flags = np.repeat(many, np.diff(np.r_[at, len(a)])) * np.uint8(_REPEATED) | (kind & np.repeat(kinds > 1, np.diff(np.r_[np.flatnonzero(bucket), len(a)]))) * np.uint8(_GOES_ON)
        out = np.empty(len(a), np.uint8)
        out[order] = flags
        cuts = np.cumsum([0, *size])
        yield rows([(block, part, zstandard.compress(out[i:j].tobytes(), 3)) for (block, _), i, j in zip(got, cuts, cuts[1:])])


def _flags(got: list[tuple[int, bytes]], which: np.ndarray) -> np.ndarray:
    """The answer to each pair of a block."""
    flags = np.frombuffer(b"".join(zstandard.decompress(x) for _, x in got), np.uint8)
    if len(which) and len(flags) <= which.max():
        raise RuntimeError("an answer of the refinement is missing")
    return flags[which]


def _flat(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return data[np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)]


def _spans(block: int, level: int, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, bytes]]:
    return [(block, _SPANS + level, pack(row, a, b))] if len(row) else []


def repeats(docs: DataFrame, size: int = 200, gram: int = 64, limit: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` as packed blocks, and the packed spans of repeated bytes in them.

    Both are (block, part, payload). `docs` is read once.
    """
    spark = docs.sparkSession
    span = size - gram + 1
    width = max(1, round(span**0.5))
    salt = os.urandom(16)
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not 8 <= gram <= size:
        raise ValueError("a bucket takes 8 bytes at least, and no more than a window")

    def root(n: int) -> np.ndarray:
        return np.zeros(n, np.uint64)

    def initial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks, and each suffix's bucket."""
        for block, batch in numbered(batches, limit):
            batch = batch.select(range(batch.num_columns - 1))
            row, first, n, pos, bucket = _designated(*utf8(batch.column("text")), size, gram)
            sent, which, _ = _asks(block, mixed(bucket), root(len(row)), root(len(row)), parts)
            yield rows([(block, -1, with_batch(batch, pack(row, first, n, pos, which))), *sent])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffixes with company in their buckets, by all the bytes under their windows."""
        for block, head, got in by_block(batches):
            batch, rest = batch_of(head)
            row, first, n, pos, which = (x.astype(np.int64) for x in unpack(rest))
            ok = _flags(got, which) > 0
            row, first, n, pos = (x[ok] for x in (row, first, n, pos))
            data, off = utf8(batch.column("text"))
            at = off[row]
            one = mixed(pointers(data, at + pos, at + pos + gram, _GRAM)) & _SENT
            other, last = digests(data, at + first, at + first + n - 1 + size, salt)
            sent, which, kind = _asks(block, one, other ^ mixed((pos - first).astype(np.uint64)), last, parts)
            yield rows([(block, -1, with_batch(batch, pack(row, first, n, pos, which, kind))), *sent])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One suffix of each kind of a mixed bucket goes on to the nodes that its windows touch."""
        for block, head, got in by_block(batches):
            batch, rest = batch_of(head)
            row, first, n, pos, which, kind = (x.astype(np.int64) for x in unpack(rest))
            flags = _flags(got, which)
            hit = (flags & _REPEATED) > 0
            out = _spans(block, 0, row[hit], first[hit], (first + n - 1 + size)[hit])
            on = kind[(flags[kind] & _GOES_ON) > 0]
            row, first, n, pos = (x[on] for x in (row, first, n, pos))
            data, off = utf8(batch.column("text"))
            flat = _flat(data, off[row] + first, n - 1 + size)
            high = pos - first
            low = high - n + 1
            i = low // width
            many = high // width - i + 1
            which = np.repeat(np.arange(len(row)), many)
            node = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - i, many)
            yield rows([*out, *asked(block, 1, flat, row, first, n, pos, which, node * width, np.minimum(node * width + width, span) - 1)])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, head, got in by_block(batches):
            flat, row, first, n, pos, which, low, high, asks, kind = opened(head)
            flags = _flags(got, asks)
            hit = (flags & _REPEATED) > 0
            out = under(block, 1, row, first, n, pos, which[hit], low[hit], high[hit])
            on = kind[(flags[kind] & _GOES_ON) > 0]
            which, low, high = which[on], low[on], high[on]
            low = np.maximum(low, (pos - first - n + 1)[which])
            many = np.minimum(high, (pos - first)[which]) - low + 1
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - low, many)
            yield rows([*out, *asked(block, 2, flat, row, first, n, pos, np.repeat(which, many), offset, offset)])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, head, got in by_block(batches):
            _, row, first, n, pos, which, low, high, asks, _ = opened(head)
            hit = (_flags(got, asks) & _REPEATED) > 0
            yield rows(under(block, 2, row, first, n, pos, which[hit], low[hit], high[hit]))

    def asked(block, level, flat, row, first, n, pos, which, low, high) -> list[tuple[int, int, bytes]]:
        """Ask about nodes (suffix `which`, offsets low to high); what is needed to read the answer goes along."""
        if not len(which):
            return []
        begin = np.cumsum(n - 1 + size) - (n - 1 + size) - first  # of a row's byte 0 in `flat`, if it were there
        at = (begin + pos)[which]
        a, b = np.maximum(low, (pos - first - n + 1)[which]), np.minimum(high, (pos - first)[which])
        one = mixed(pointers(flat, at - low, at - high + size, _GRAM) ^ mixed((low + level * span).astype(np.uint64))) & _SENT
        other, rest = digests(flat, at - b, at - a + size, salt)
        sent, asks, kind = _asks(block, one, other ^ mixed((a * span + b).astype(np.uint64)), rest, parts)
        state = pack(row, first, n, pos, which, low, high, asks, kind)
        return [(block, -1, len(state).to_bytes(8, "little") + state + zstandard.compress(flat.tobytes(), 3)), *sent]

    def opened(head: bytes) -> list[np.ndarray]:
        size_ = int.from_bytes(head[:8], "little")
        return [np.frombuffer(zstandard.decompress(head[8 + size_ :]), np.uint8), *(x.astype(np.int64) for x in unpack(head[8 : 8 + size_]))]

    def under(block, level, row, first, n, pos, which, low, high) -> list[tuple[int, int, bytes]]:
        """The bytes under the windows that suffixes have in repeated nodes."""
        a, b = np.maximum(low, (pos - first - n + 1)[which]), np.minimum(high, (pos - first)[which])
        return _spans(block, level, row[which], pos[which] - b, pos[which] - a + size)

    def answered(heads: DataFrame, asks: DataFrame) -> DataFrame:
        """The heads of blocks with the answers to what they asked, block by block."""
        answers = asks.where(F.col("part") < _SPANS).repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(_refined, ROW)
        return heads.union(answers).repartition("block").sortWithinPartitions("block", "part")

    own = "_part" + "_" * max(map(len, docs.columns))
    given, asks = written_apart(docs.withColumn(own, F.spark_partition_id()).mapInArrow(initial, ROW), "buckets", "part = -1")
    blocks, more = written_apart(answered(given, asks).mapInArrow(whole, ROW), "whole", "part = -1")
    dropped(spark, given, asks)
    heads, first = written_apart(answered(blocks, more).mapInArrow(nodes, ROW), "nodes", "part = -1")
    dropped(spark, more)
    smaller, second = written_apart(answered(heads, first).mapInArrow(leaves, ROW), "leaves", "part = -1")
    dropped(spark, heads)
    third = written(answered(smaller, second).mapInArrow(last, ROW), "spans")
    dropped(spark, smaller)
    return blocks, first.union(second).union(third).where(F.col("part") >= _SPANS)


def _cut(docs: DataFrame, finish: Callable[[pa.RecordBatch, list[bytes], np.ndarray], pa.RecordBatch], schema, **how) -> DataFrame:
    """`finish` of each block: its rows, the bytes each keeps, and the runs cut from each."""
    blocks, spans = repeats(docs, **how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, head, got in by_block(batches):
            batch, _ = batch_of(head)
            data, off = utf8(batch.column("text"))
            row, a, b = (np.concatenate(x).astype(np.int64) for x in zip(*(unpack(x) for _, x in got))) if got else (np.zeros(0, np.int64),) * 3
            a, b = off[row] + a, off[row] + b
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
            row = row[order]
            new = np.flatnonzero(np.r_[True, (a[1:] > b[:-1]) | (row[1:] != row[:-1])]) if len(a) else np.zeros(0, np.int64)
            a, b, row = a[new], b[np.r_[new[1:], len(b)] - 1] if len(new) else b, row[new]
            edge = np.zeros(len(data) + 1, np.int8)
            np.add.at(edge, a, 1)
            np.add.at(edge, b, -1)
            keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
            n = np.r_[0, np.cumsum(keep)][off]
            flat = data[keep].tobytes()
            yield finish(batch, [flat[i:j] for i, j in zip(n.tolist(), n[1:].tolist())], np.bincount(row, minlength=batch.num_rows))

    return blocks.union(spans).repartition("block").sortWithinPartitions("block", "part").mapInArrow(run, schema)


def dedup(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): one row for each row of `docs` (doc_id, text; others ignored).

    kept are the bytes left, which may begin or end within a character. A null or short text
    has nothing removed; repeated rows are repeats of each other. Null ids are ids like any
    other; an empty table gives no rows.
    """

    def finish(batch: pa.RecordBatch, kept: list[bytes], runs: np.ndarray) -> pa.RecordBatch:
        size = np.diff(utf8(batch.column("text"))[1])
        left = np.fromiter(map(len, kept), np.int64, len(kept))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(size - left), pa.array(runs), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _cut(docs.select("doc_id", "text"), finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary", **how)


def cleaned(docs: DataFrame, **how) -> DataFrame:
    """`docs`, all columns and rows, with the repeated bytes cut from their texts; characters cut in two are dropped whole.

    A null text stays null, an empty or short one as it is; repeated rows are repeats of each
    other and are all cut. No column's name matters but that of text; an empty table gives no rows.
    """
    place = docs.columns.index("text")

    def finish(batch: pa.RecordBatch, kept: list[bytes], runs: np.ndarray) -> pa.RecordBatch:
        old = batch.column(place)
        new = pa.array([k.decode(errors="ignore") if n else t for k, n, t in zip(kept, runs.tolist(), old.to_pylist())], old.type)
        return batch.set_column(place, batch.schema.field(place), new)

    return _cut(docs, finish, docs.schema, **how)


def query(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
