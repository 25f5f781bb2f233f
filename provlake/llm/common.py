"""Helpers that several operators share: shared storage, Arrow buffers, word hashing."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes of `[\x20\x09-\x0D]`.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Masks of the first 0 to 8 bytes of a little-endian 64-bit number.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only for a local session that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/checkpoints/provlake"
        os.makedirs(path, exist_ok=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: The tables that the innermost scratch() of this thread deletes.
_OPEN: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def _located(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def on_exit(spark: SparkSession, path: str) -> None:
    """Have `path` deleted when the driver ends."""
    fs, where = _located(spark, path)
    fs.deleteOnExit(where)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that `written` made and that nothing needs any more, and the shuffle files that led to them.

    Spark's cleaner removes shuffle files once the driver's garbage is collected, so that is asked
    for: twice, since the first time round only what names them goes.
    """
    for table in tables:
        for path in {os.path.dirname(f) for f in table.inputFiles()}:
            fs, where = _located(spark, path)
            fs.delete(where, True)
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.3)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that `written` makes within, once nothing needs them any more."""
    paths: list[str] = []
    token = _OPEN.set(paths)
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in paths:
            fs, where = _located(spark, path)
            fs.delete(where, True)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back, which cuts the lineage.

    Within scratch() the table goes when that ends, but for those with `keep`; the others go with
    the driver, since what a query returns may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    paths = _OPEN.get()
    if paths is not None and not keep:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def written_apart(df: DataFrame, name: str, apart: str) -> tuple[DataFrame, DataFrame]:
    """As `written`, the rows for which the condition `apart` holds in a table of their own: (they, the others)."""
    spark = df.sparkSession
    own = "_apart" + "_" * max(map(len, df.columns))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    paths = _OPEN.get()
    if paths is not None:
        paths.append(path)
    df.withColumn(own, F.coalesce(F.expr(apart), F.lit(False))).write.option("compression", "zstd").partitionBy(own).parquet(path)
    on_exit(spark, path)
    fs, _ = _located(spark, path)
    out = []
    for value in ("true", "false"):
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{own}={value}"))  # there are none of a kind at times
        out.append(spark.read.schema(df.schema).parquet(f"{path}/{own}={value}"))
    return out[0], out[1]


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of what is executed within as soon as each execution ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offsets of its rows; null is empty."""
    a = pc.fill_null(column, "").cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices of about `limit` bytes of `column`; a longer row is a slice."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def word_spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes outside `gap`; no run crosses rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[off[:-1]] = True
    before = np.r_[False, inside[:-1]]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.r_[inside[1:], False]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eights(data: np.ndarray) -> np.ndarray:
    """A view of the little-endian 64-bit number in the 8 bytes from each position; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data), "<u8", padded.data, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span.

    Eight bytes at a time are mixed in, each by a bijection, so spans of one length up to 8 never
    share a hash and no pattern of the bytes survives; long spans take XXH64.
    """
    n = ends - starts
    out = mixed(n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    words = eights(data)
    at = np.flatnonzero((n > 0) & (n <= _LONG))
    done = 0
    while len(at):
        chunk = words[starts[at] + done] & FIRST[np.minimum(n[at] - done, 8)]
        out[at] = mixed(out[at] ^ chunk)
        done += 8
        at = at[n[at] > done]
    for i in np.flatnonzero(n > _LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return out


def _alike(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each span has the bytes of the span `other`."""
    n = ends - starts
    ok = n == n[other]
    words = eights(data)
    at, done = np.flatnonzero(ok & (n > 8) & (n <= _LONG) & (other != np.arange(len(n)))), 0
    while len(at):
        last = FIRST[np.minimum(n[at] - done, 8)]
        ok[at] &= (words[starts[at] + done] & last) == (words[starts[other[at]] + done] & last)
        done += 8
        at = at[n[at] > done]
    for i in np.flatnonzero(ok & (n > _LONG) & (other != np.arange(len(n)))).tolist():
        ok[i] = np.array_equal(data[starts[i] : ends[i]], data[starts[other[i]] : ends[other[i]]])
    return ok


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct spans, ascending; a span with each; which of them each span is.

    Bytes are compared where hashes agree: spans that share a hash but not their bytes stay apart.
    """
    keys, first, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if not _alike(data, starts, ends, first[which]).all():
        names: dict[tuple[int, bytes], int] = {}
        mine = [names.setdefault((int(keys[w]), data[a:b].tobytes()), i) for i, (w, a, b) in enumerate(zip(which.tolist(), starts.tolist(), ends.tolist()))]
        order = {at: k for k, (_, at) in enumerate(sorted(names.items()))}
        keys, first = (np.array(x, t) for x, t in (([k for (k, _), _ in sorted(names.items())], np.uint64), ([at for _, at in sorted(names.items())], np.int64)))
        which = np.array([order[at] for at in mine], np.int64)
    return keys, first, which


def words_col(text, pattern: str = r"[^\x20\x09-\x0D]+"):
    """The words of a text as an array column, with built-in functions; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
