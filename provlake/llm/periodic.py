"""Periodic runs of words by an all-lag vectorised scan.

A run is a stretch of consecutive words with a smallest period q, of `least` words and `times`
periods at least, that no neighbouring word extends keeping period q. The word-id array of a
document is compared with itself shifted by each lag q up to n/times; a run of period q shows as a
stretch of equal positions of max(least - q, (times - 1) * q) or more.

A stretch of m positions holds m // s positions that s divides. So at each lag only every s-th
position is compared, s being an eighth of the shortest stretch that counts, and only where enough
of these in a row are equal are all positions compared. Lag after lag, short documents are compared
all at once, laid end to end by descending length; the comparisons of all lags together come to
n log n for ordinary texts.

Long documents are dealt out: `share` lags of one are a row, and the rows are spread over the
machines. A stretch found at lag q is a run of the smallest period that divides q, so that shares
need nothing from each other: what several of them find of one run is the same row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, distinct_spans, utf8, word_spans, words_col
from .tokens import spread

_DENSE = 8  # compared positions in the shortest stretch that counts
_LONG = 4096  # words of a run that is remembered, so that multiples of its period don't compare it again


def _trues(flags: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal stretch of `least` or more trues."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False]))
    a, b = edges[::2], edges[1::2]
    ok = b - a >= least
    return a[ok], b[ok]


def _smallest(ids: np.ndarray, start: int, end: int, lag: int) -> int:
    """The smallest period of ids[start:end], which has period `lag` and three of it or more: a divisor of it."""
    part = ids[start:end]
    for q in range(1, int(lag**0.5) + 1):
        if lag % q == 0 and (part[q:] == part[:-q]).all():
            return q
    for q in range(int(lag**0.5), 0, -1):
        if lag % q == 0 and lag // q < lag and (part[lag // q :] == part[: -(lag // q)]).all():
            return lag // q
    return lag


def scan(ids: np.ndarray, ends: np.ndarray, low: int = 1, high: int | None = None, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs in documents laid end to end, found at lags `low` up to and without `high`.

    `ends` are where the documents end; they stand by descending length, and no id occurs in two of them.
    With all lags the runs are told once each; `times` is 3 or more.
    """
    if times < 3:
        raise ValueError("smallest periods divide the others only in runs of three periods or more")
    sizes = np.diff(np.r_[0, ends])
    high = min(int(sizes[0]) // times + 1 if len(sizes) else 0, high or 1 << 62)
    found: dict[tuple[int, int], int] = {}
    known: list[tuple[int, int, int]] = []
    live = len(ends)
    for q in range(low, high):
        need = max(least - q, (times - 1) * q)
        while live and sizes[live - 1] < q + need:
            live -= 1
        if not live:
            break
        n = int(ends[live - 1])
        s = max(1, need // _DENSE)
        a, b = _trues(ids[: n - q : s] == ids[q:n:s], need // s)
        for i, j in zip(a.tolist(), b.tolist()):
            todo = [(max(i * s - s + 1, 0), min(j * s, n - q))]
            if (j - i) * s >= _LONG:
                for start, end, p in known:
                    if q % p == 0 and end - start >= times * q:
                        todo = [(x, y) for u, v in todo for x, y in ((u, min(v, start)), (max(u, end - q), v)) if y > x]
            for u, v in todo:
                if v - u < need:
                    continue
                x, y = _trues(ids[u:v] == ids[u + q : v + q], need)
                for start, end in zip((x + u).tolist(), (y + u + q).tolist()):
                    if (start, end) not in found:
                        found[start, end] = p = _smallest(ids, start, end, q)
                        if end - start >= _LONG:
                            known.append((start, end, p))
    return sorted((a, b, p) for (a, b), p in found.items())


class Words:
    """The words of a text column, and the runs in them."""

    def __init__(self, column: pa.Array):
        self.data, off = utf8(column)
        self.starts, self.ends, self.row = word_spans(self.data, off)
        self.n = np.bincount(self.row, minlength=len(column))
        self.off, self.first = off, np.cumsum(self.n) - self.n

    def runs(self, least: int, times: int, low: int = 1, high: int | None = None) -> np.ndarray:
        """(row, start, end, period) of the runs, by row, start and period; starts and ends count the row's words."""
        order = np.argsort(-self.n, kind="stable")
        keys, _, which = distinct_spans(self.data, self.starts, self.ends)
        ids = self.row * np.int64(len(keys)) + which  # no two rows share one
        ids = ids.astype(np.int32) if len(self.n) * len(keys) < 1 << 31 else ids
        laid, ends = spread(ids, self.n, order)
        got = np.array(scan(laid, ends, low, high, least, times), np.int64).reshape(-1, 3)
        at = np.searchsorted(ends, got[:, 0], "right")
        base = (ends - self.n[order])[at]
        out = np.c_[order[at], got[:, 0] - base, got[:, 1] - base, got[:, 2]]
        return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]

    def collapsed(self, runs: np.ndarray) -> pa.Array:
        """The words but for those that a run has after its first period, joined by single blanks."""
        edge = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(edge, self.first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
        np.add.at(edge, self.first[runs[:, 0]] + runs[:, 2], -1)
        kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
        a, b, row = self.starts[kept], self.ends[kept], self.row[kept]
        inner = np.r_[row[1:] == row[:-1], False][: len(row)]
        data = self.data.copy()
        data[b[inner]] = 32  # the byte after a word that another one follows is white space
        size = b - a + inner
        flat = data[np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)]
        offsets = np.r_[0, np.cumsum(size)][np.searchsorted(row, np.arange(len(self.n) + 1))]
        return pa.Array.from_buffers(pa.large_binary(), len(self.n), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary()).cast(pa.string())


def _listed(runs: np.ndarray, rows: int) -> pa.Array:
    """The runs of each row as an array of structs."""
    fields = pa.StructArray.from_arrays([pa.array(runs[:, 1]), pa.array(runs[:, 2] - runs[:, 1]), pa.array(runs[:, 3])], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(rows + 1)), pa.int32()), fields)


#: As Spark has the runs of a row.
_RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic(docs: DataFrame, least: int = 24, times: int = 3, share: int = 1 << 14, limit: int = 1 << 21) -> DataFrame:
    """(doc_id, runs, collapsed): one row for each row of `docs` (doc_id, text; others ignored).

    runs are (start, length, period) in words, by start and period; words are maximal stretches of
    other bytes than white space (blank, \\x09 to \\x0D), numbered from 0. collapsed are the words joined
    by single blanks, without those that a run has after its first period. A null, empty or short
    text has no runs, and a null one an empty text left. Null and repeated ids are kept as they are,
    each row by itself; an empty table gives no rows.

    Texts that may have more than times * share words are dealt out: each distinct one in rows of
    `share` lags, with the text in each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > 2 * times * share  # a word and its gap are two bytes at least

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", limit):
            words = Words(batch.column("text"))
            runs = words.runs(least, times)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _listed(runs, batch.num_rows), words.collapsed(runs)], ["doc_id", "runs", "collapsed"])

    def lags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1):
            low = batch.column("low")[0].as_py()
            runs = Words(batch.column("text")).runs(least, times, low, low + share)
            if len(runs):
                yield pa.RecordBatch.from_arrays([batch.column("key"), _listed(runs, 1)], ["key", "runs"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1):
            runs = np.array([(0, r["start"], r["start"] + r["length"], r["period"]) for r in batch.column("runs")[0].as_py() or []], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _listed(runs, 1), Words(batch.column("text")).collapsed(runs)], ["doc_id", "runs", "collapsed"])

    out = f"doc_id {kind}, runs {_RUNS}, collapsed string"
    here = rows.where(~long).mapInArrow(whole, out)
    far = rows.where(long).withColumn("key", F.sha2("text", 256))
    dealt = far.select("key", "text").dropDuplicates(["key"]).withColumn("low", F.explode(F.sequence(F.lit(1), (F.octet_length("text") / (2 * times)).cast("int") + 1, F.lit(share))))
    found = dealt.repartition("key", "low").mapInArrow(lags, f"key string, runs {_RUNS}")
    found = found.select("key", F.explode("runs").alias("r")).distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r.start", "r.period", "r.length"))).alias("runs"))
    found = found.withColumn("runs", F.transform("runs", lambda x: F.struct(x["start"], x["length"], x["period"])))
    return here.union(far.join(found, "key", "left").select("doc_id", "text", "runs").mapInArrow(together, out))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of `docs`, with the text of every tenth crc32(doc_id) repeating itself from one of its words on, as its contract plants it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def again(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = (F.floor(h / 10) % n).cast("int")
        left = F.size(w) - a
        p = (1 + F.floor(left / (3 + F.floor(h / 10) % 8))).cast("int")
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(left / p).cast("int"))), F.lit(1), left)), " ")

    # as an argument of a function the words are made once, not for each use
    text = F.get(F.transform(F.array(words_col(F.col("text"))), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(F.col("text"))), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def _greatest(runs: Column) -> Column:
    """The run with the greatest exact length/period; of equal ones the first."""
    less = lambda x, y: x["length"] * y["period"] < y["length"] * x["period"]
    return F.aggregate(F.slice(runs, F.lit(2), F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda top, x: F.when(less(top, x), x).otherwise(top))


def query(docs: DataFrame) -> DataFrame:
    found = periodic(planted(docs)).withColumn("top", _greatest(F.col("runs")))
    told = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
