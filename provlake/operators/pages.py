"""Pages by cursor over a listing that is in order: the last page costs what the first one costs.

A listing is made once for a version of the catalogue: its photographs in ranges of (category, subject,
id), a folder for each range, with a small table of the ranges' first keys and sizes, and one of the
counts for each combination of what can be filtered by. A page reads the range that its cursor falls
into, and the next ones only as far as the page reaches; its total is a sum over the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..schema import GROUP_COLUMNS, PAGE_MAX, PHOTOGRAPHS, WIRE
from ..state import Store
from .catalog import photo_scan, predicate

_ORDER = ("category", "subject", "id")
_CELL = ("subject", *GROUP_COLUMNS)
_ROWS = StructType([*PHOTOGRAPHS.fields, StructField("subject", StringType())])


def _place(values) -> tuple:
    """A cursor's place in the order: null before all else."""
    return tuple((False,) if v is None else (True, v) for v in values)


@dataclass
class Page:
    rows: DataFrame
    total: DataFrame
    cursor: list | None


class Listing:
    """The listing of a version, in a folder of its own; `of` makes it if it is not there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.ranges = [r.asDict() for r in spark.read.parquet(f"{path}/ranges").orderBy("part").collect()]

    @classmethod
    def of(cls, store: Store, version: int | None = None, rows: int = 100_000) -> Listing:
        """The listing of `version`, in ranges of about `rows` photographs. Photographs without a subject are left out, as in all lists."""
        version = store.version() if version is None else version
        path = f"{store.root}/listings/{version}"
        if not store._fs.exists(store._path(f"{path}/counts/_SUCCESS")):  # the last to be written
            about = sum(f["rows"] for f in store._entry(version)["tables"]["photographs"])  # not the largest id: ids may lie far apart
            make(photo_scan(store.read("photographs", version), store.read("subjects", version)), path, rows, about)
        return cls(store.spark, path)

    def page(self, limit: int, after: list | None = None, status: str | None = "complete", **filters) -> Page:
        """The `limit` matching photographs after the cursor `after` (none: the first), as clients see them, and how many match in all.

        The page's own cursor leads to the next one; null if the listing ends with this page.
        """
        if not 1 <= limit <= PAGE_MAX:
            raise ValueError(f"limit must be 1 to {PAGE_MAX}")
        wanted = predicate(status=status, **filters)
        total = self.spark.read.parquet(f"{self.path}/counts").where(wanted).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
        key = F.struct(*_ORDER)
        beyond = F.lit(True) if after is None else key > F.struct(*(F.lit(x).cast(_ROWS[c].dataType).alias(c) for c, x in zip(_ORDER, after)))
        starts = [_place(r[c] for c in _ORDER) for r in self.ranges]
        at = 0 if after is None else max(0, sum(s <= _place(after) for s in starts) - 1)
        found: list = []
        step = 1
        while at < len(self.ranges) and len(found) <= limit:  # most pages end in the first turn or the second
            paths = [f"{self.path}/rows/part={r['part']}" for r in self.ranges[at : at + step]]
            rows = self.spark.read.schema(_ROWS).parquet(*paths).where(wanted & beyond)
            found += rows.orderBy(*_ORDER).limit(limit + 1 - len(found)).collect()
            at, step = at + step, step * 2
        more = len(found) > limit
        found = found[:limit]
        rows = self.spark.createDataFrame(found, _ROWS).select(*WIRE)
        return Page(rows, total, [found[-1][c] for c in _ORDER] if more else None)


def make(scan: DataFrame, path: str, rows: int, about: int) -> None:
    """Write the listing of photographs with their `subject`; `about` is how many there are at most."""
    spark = scan.sparkSession
    parts = max(1, -(-about // rows))
    ordered = scan.select(*_ROWS.names).repartitionByRange(parts, *_ORDER).sortWithinPartitions(*_ORDER)
    ordered.withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(f"{path}/rows")
    written = spark.read.schema(StructType([*_ROWS.fields, StructField("part", IntegerType())])).parquet(f"{path}/rows")
    first = F.min(F.struct(*_ORDER)).alias("k")
    written.groupBy("part").agg(first, F.count(F.lit(1)).alias("n")).select("part", "k.*", "n").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
    written.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/counts")
