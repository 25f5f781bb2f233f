"""Verification that resumes: what files held when they were last read, kept beside the catalogue.

A refresh lists the pool without reading it. A file whose path, length and time are those of its
digest keeps it; only the others, and those read longer ago than `max_age`, are read. Folders have
digests of all that lies below them, so two refreshes are compared from the top down.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pictures import NoPicture, examined
from ..functions.storage import absolute, opened

_SCHEMA = "path string, length long, modified timestamp, sha256 string, corrupt boolean, checked double, was_read boolean"


def stamps(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of the files below `root`; no file is opened."""
    root = absolute(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("path"), "length", F.col("modificationTime").alias("modified"))


class Digests:
    """The digests of a pool's files, one folder for each refresh; a folder without _SUCCESS is none."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, absolute(place).rstrip("/")

    def _fs(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.place)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def refreshes(self) -> list[str]:
        """The names of the whole refreshes, the latest last."""
        fs, where = self._fs()
        names = sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []
        return [x for x in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(where, f"{x}/_SUCCESS"))]

    def read(self, name: str | None = None) -> DataFrame:
        """(path, length, modified, sha256, corrupt, checked, was_read) of a refresh, by default the latest; no rows before the first."""
        names = [name] if name else self.refreshes()[-1:]
        if not names:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.place}/{names[0]}")

    def refresh(self, root: str, max_age: float = float("inf"), now: float | None = None, keep: int = 2) -> DataFrame:
        """The digests of what is below `root` now; of the refreshes the last `keep` stay.

        Files are read in tasks of their own number, whatever folder they are in. One that is gone before it is read
        is left out. A change that keeps length and time is seen once the file is due by `max_age` (seconds).
        """
        root = absolute(root)
        now = time.time() if now is None else now
        known = self.read().select("path", "length", "modified", "sha256", "corrupt", "checked")
        rows = stamps(self.spark, root).join(known, ["path", "length", "modified"], "left")
        rows = rows.withColumn("was_read", F.col("sha256").isNull() | (F.col("checked") < now - max_age))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, base = opened(root)
            for frame in frames:
                gone = []
                for i in frame.index[frame["was_read"]]:
                    try:
                        with fs.open_input_stream(f"{base}/{frame.at[i, 'path']}") as f:
                            data = f.read()
                    except FileNotFoundError:
                        gone.append(i)
                        continue
                    try:
                        examined(data)
                        bad = False
                    except NoPicture:
                        bad = True
                    frame.loc[i, ["sha256", "corrupt", "checked"]] = [hashlib.sha256(data).hexdigest(), bad, now]
                yield frame.drop(index=gone)

        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        columns = [x.split()[0] for x in _SCHEMA.split(", ")]
        name = f"{int(now * 1000):015d}-{uuid.uuid4().hex[:8]}"
        rows.select(*columns).repartition(tasks).mapInPandas(run, _SCHEMA).write.parquet(f"{self.place}/{name}")
        fs, where = self._fs()
        for old in self.refreshes()[:-keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(where, old), True)
        return self.read(name)


def folders(known: DataFrame) -> DataFrame:
    """(folder, files, bytes, digest): every folder and all that lies below it; the pool itself is the empty name.

    The digest is of the set of files, 120 bits of sums over their own digests, so partial sums meet in any order
    and a folder of any size is no group to gather.
    """
    one = F.sha2(F.concat_ws("\n", "path", F.col("length").cast("string"), "sha256"), 256)
    part = lambda at: F.conv(F.substring("_one", at, 15), 16, 10).cast("decimal(38,0)")
    names = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))
    rows = known.withColumn("_one", one).select("length", part(1).alias("_a"), part(16).alias("_b"), F.explode(above).alias("folder"))
    sums = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    hex15 = lambda c: F.lpad(F.lower(F.hex((F.col(c) % F.lit(1 << 60)).cast("long"))), 15, "0")
    return sums.select("folder", "files", "bytes", F.concat(hex15("_a"), hex15("_b")).alias("digest"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(folder, change): the folders of two refreshes that are new, gone or hold other files."""
    a, b = (folders(x).select("folder", F.col("digest").alias(c)) for x, c in ((before, "_a"), (after, "_b")))
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").otherwise("other")
    return a.join(b, "folder", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("folder", change.alias("change"))
