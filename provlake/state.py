"""Catalogue snapshots: bucketed Parquet folders, and a log of versions that writers claim one at a time.

A version is one small entry of the log: for each table the folders that make it up, oldest first, and
the totals that writers need (bytes of the pool, largest ids). Every folder is immutable and bucketed
by the table's key, so that Spark prunes a lookup to one bucket and joins a batch with a table
without shuffling the table. A batch adds a folder with its new and changed rows; of two rows with
one key that of the later folder counts. Folders are merged as soon as several are of a size, so there
are few of them, and a read costs what the table's size makes it cost, however many batches there were.

photographs are keyed by remote_url. by_id and by_sha256 lead from these values to remote_urls.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window

from .schema import PHOTOGRAPHS, SUBJECTS

TABLES = {"subjects": SUBJECTS, "photographs": PHOTOGRAPHS}
#: Tables that lead from a value of a photograph to its remote_url; rows with `gone` take back earlier ones.
INDEXES = {"by_id": "id", "by_sha256": "sha256"}
_INDEX = {n: StructType([StructField(c, PHOTOGRAPHS[c].dataType), StructField("remote_url", StringType()), StructField("gone", BooleanType())]) for n, c in INDEXES.items()}
_SCHEMAS = TABLES | _INDEX
#: What tells rows apart, and what they are bucketed by.
KEYS = {"subjects": ["name", "category"], "photographs": ["remote_url"]} | {n: [c, "remote_url"] for n, c in INDEXES.items()}
BUCKETED = {"subjects": ["name", "category"], "photographs": ["remote_url"]} | {n: [c] for n, c in INDEXES.items()}
BUCKETS = 8
#: A table written whole gets twice as many buckets, and again, until they hold about that many rows each.
BUCKET_ROWS = 500_000
#: That many folders in a row of which none outweighs four times what follows it are merged.
FAN = 4
_TOTALS = {"pool": 0, "subjects": 0, "photographs": 0}


class Conflict(Exception):
    """Another writer has committed since the version that changes were made from."""


class Store:
    """Versions of the catalogue below `root`.

    A reader pins the version it opened; it never creates or changes anything. Any number of
    writers may work at a time: each makes its changes from the version it read and claims the next
    number, which one of them gets; the others raise Conflict, and `transact` lets them try again from
    the new version. `root` is on a file system on which a file is created or renamed at once and
    never over another one, as HDFS and local ones are.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # the log

    def _versions(self) -> dict[int, int]:
        """The committed versions, ascending, with their time in milliseconds."""
        log = self._path(f"{self.root}/log")
        if not self._fs.exists(log):
            return {}
        found = ((s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(log))
        return dict(sorted((int(n.removesuffix(".json")), at) for n, at in found if n.endswith(".json") and not n.startswith(".")))

    def version(self) -> int | None:
        return max(self._versions(), default=None)

    def _entry(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        file = self._path(f"{self.root}/log/{version or 0:020d}.json")
        if version is None or not self._fs.exists(file):
            raise FileNotFoundError(f"no committed snapshot {'' if version is None else version} below {self.root}")
        stream = self._fs.open(file)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _claim(self, entry: dict, version: int) -> None:
        """Write the entry under that number unless there is one: its content appears at once, and for one writer only."""
        self._fs.mkdirs(self._path(f"{self.root}/log"))
        part, file = (self._path(f"{self.root}/log/{n}") for n in (f".{uuid.uuid4().hex}", f"{version:020d}.json"))
        stream = self._fs.create(part, False)
        stream.write(json.dumps(entry, sort_keys=True).encode())
        stream.close()
        try:
            if self._fs.getScheme() == "file":  # Hadoop's local rename looks first and then overwrites; a hard link does not
                files = self._jvm.java.nio.file.Files
                at = lambda p: self._jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri())
                files.createLink(at(file), at(part))
            else:
                rename = self._jvm.org.apache.hadoop.fs.Options.Rename
                how = self.spark.sparkContext._gateway.new_array(rename, 1)
                how[0] = rename.NONE
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, file, how)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {version} was taken by another writer") from None
            raise
        finally:
            self._fs.delete(part, False)

    # folders

    def _opened(self, table: str, folder: dict) -> DataFrame:
        """A folder as a bucketed relation. Its name in the session's catalogue is needed for that only, and goes at once."""
        name = f"provlake_{uuid.uuid4().hex}"
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _SCHEMAS[table])
        by = ", ".join(BUCKETED[table])
        self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {folder['buckets']} BUCKETS LOCATION '{self.root}/{folder['path']}'")
        try:
            return self.spark.table(name)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def _written(self, table: str, rows: DataFrame, about: int = 0) -> dict | None:
        """A new folder with the rows, of which there are `about` that many; None if there are none."""
        path, name, by = f"{table}/{uuid.uuid4().hex}", f"provlake_{uuid.uuid4().hex}", BUCKETED[table]
        buckets = self.buckets
        while buckets * BUCKET_ROWS < about:
            buckets *= 2
        key = F.coalesce(F.col(by[0]), F.raise_error(F.lit(f"{table} without {by[0]}")).cast(_SCHEMAS[table][by[0]].dataType)).alias(by[0])
        rows = rows.select(*(key if f.name == by[0] else F.col(f.name).cast(f.dataType) for f in _SCHEMAS[table]))
        out = rows.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*by).option("compression", "zstd")
        for c in {*by, "sha256"} & set(rows.columns):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.option("path", f"{self.root}/{path}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        n = self.spark.read.schema(_SCHEMAS[table]).parquet(f"{self.root}/{path}").count() if self._files(path) else 0  # from the files' footers
        if not n:
            self._delete([path])
            return None
        return {"path": path, "rows": n, "buckets": buckets}

    def _files(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{path}")) if s.getPath().getName().startswith("part-")]

    def _delete(self, paths: Iterable[str]) -> None:
        for path in paths:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)

    # reads

    def _latest(self, table: str, folders: list[DataFrame]) -> DataFrame:
        """The rows of several small folders, of each key the latest."""
        key, all_ = KEYS[table], [f.withColumn("_at", F.lit(i)) for i, f in enumerate(folders)]
        order = Window.partitionBy(*key).orderBy(F.desc("_at"))
        return reduce(DataFrame.unionAll, all_).withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn", "_at")

    def _rows(self, table: str, folders: list[dict]) -> DataFrame:
        """The rows that folders make up: those of the first without newer ones, and the newest of the others."""
        if not folders:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        first, *others = (self._opened(table, f) for f in folders)
        if not others:
            return first
        new = self._latest(table, others)
        keys = reduce(DataFrame.unionAll, (f.select(*KEYS[table]) for f in others))
        return first.join(keys, KEYS[table], "left_anti").select(*first.columns).unionAll(new)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self._rows(table, self._entry(version)["tables"][table])

    def lookup(self, table: str, column: str, values: DataFrame | list, version: int | None = None) -> DataFrame:
        """The rows whose `column` is among `values`: a list, or the column of that name of a DataFrame.

        `column` is what the table is bucketed by, or for photographs id or sha256. A listed value prunes
        each folder to its bucket; a DataFrame is dealt to the buckets, and the table stays where it is.
        """
        if table == "photographs" and column in INDEXES.values():
            index = next(n for n, c in INDEXES.items() if c == column)
            urls = self.lookup(index, column, values, version).where("not gone").select("remote_url")
            if isinstance(values, list):
                urls = [r[0] for r in urls.collect()]
            found = self.lookup(table, "remote_url", urls, version)
            return found.where(F.col(column).isin(values)) if isinstance(values, list) else found.join(values.select(column).distinct(), column, "left_semi").select(found.columns)
        if BUCKETED[table] != [column]:
            raise ValueError(f"{table} can't be looked up by {column}")
        folders = [self._opened(table, f) for f in self._entry(version)["tables"][table]]
        if not folders:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        if isinstance(values, list):
            hits = [f.where(F.col(column).isin(values) if values else F.lit(False)) for f in folders]
        else:
            hits = [f.join(values.select(column), column, "left_semi").select(f.columns) for f in folders]
        return hits[0] if len(hits) == 1 else self._latest(table, hits)

    def totals(self, version: int | None = None) -> dict[str, int]:
        """pool: bytes of the complete photographs; subjects, photographs: the largest id. Without a version all are 0."""
        version = self.version() if version is None else version
        return self._entry(version)["totals"] if version else dict(_TOTALS)

    def stream(self, name: str, version: int | None = None) -> dict:
        """What the stream of that name has noted with its last commit."""
        version = self.version() if version is None else version
        return self._entry(version).get("streams", {}).get(name, {}) if version else {}

    def ready(self) -> tuple[bool, str | None]:
        """Whether the tables can be read as they should be; one reason for all faults."""
        try:
            for name, folders in self._entry()["tables"].items():
                for folder in folders:
                    found = self.spark.read.parquet(f"{self.root}/{folder['path']}")
                    if {f.name for f in _SCHEMAS[name]} - set(found.columns):
                        return False, "catalogue unavailable"
                    found.limit(1).collect()
            return True, None
        except Exception:  # noqa: BLE001 - whatever is wrong, the answer is the same
            return False, "catalogue unavailable"

    # writes

    def _put(self, rows: dict[str, DataFrame], about: Callable[[DataFrame], int] = lambda _: 0) -> dict[str, dict | None]:
        with ThreadPoolExecutor(len(rows)) as pool:
            return dict(zip(rows, pool.map(lambda x: self._written(*x, about(x[1])), rows.items())))

    def _next(self, at: int | None, tables: dict[str, list[dict]], totals: dict[str, int], new: list[str], streams: dict | None = None) -> int:
        """Claim the version after `at`; what was written for it goes if another writer has it."""
        version = (at or 0) + 1
        try:
            if (self.version() or 0) != (at or 0):
                raise Conflict(f"version {at} is no longer the latest")
            known = self._entry(at).get("streams", {}) if at else {}
            self._claim({"tables": tables, "totals": totals, "streams": known | (streams or {})}, version)
        except Conflict:
            self._delete(new)
            raise
        return version

    def commit(self, subjects: DataFrame, photographs: DataFrame, at: int | None = None) -> int:
        """Write both tables whole as the version after `at`, by default after the latest."""
        at = self.version() if at is None else at
        put = self._put({"subjects": subjects, "photographs": photographs}, DataFrame.count)
        now = {t: self._rows(t, [f] if f else []) for t, f in put.items()}
        # from what was written: the photographs given may take a join to make
        index = {n: now["photographs"].where(F.col(c).isNotNull()).select(c, "remote_url", F.lit(False).alias("gone")) for n, c in INDEXES.items()}
        put |= self._put(index, DataFrame.count)
        tables = {t: [f] if f else [] for t, f in put.items()}
        complete = F.when(F.col("status") == "complete", F.col("file_size"))
        a, b = now["subjects"].agg(F.max("id")).first(), now["photographs"].agg(F.max("id"), F.sum(complete)).first()
        totals = {"subjects": a[0] or 0, "photographs": b[0] or 0, "pool": b[1] or 0}
        return self._next(at, tables, totals, [f["path"] for x in tables.values() for f in x])

    def commit_changes(self, subjects: DataFrame, photographs: DataFrame, at: int | None = None, before: DataFrame | None = None, streams: dict | None = None) -> int:
        """As `commit`, given only the rows that are new or changed since `at`; `before` are the photographs of these keys as they were, if they are at hand.

        `streams` is noted with the commit, by name, so that a stream knows which of its batches are in.
        """
        at = self.version() if at is None else at
        entry = self._entry(at) if at else {"tables": {t: [] for t in _SCHEMAS}, "totals": dict(_TOTALS)}
        put = self._put({"subjects": subjects, "photographs": photographs.select(*PHOTOGRAPHS.names)})
        now = {t: self._opened(t, f) if f else self.spark.createDataFrame([], TABLES[t]) for t, f in put.items()}
        if before is None:
            before = self.lookup("photographs", "remote_url", now["photographs"], at) if at else self.spark.createDataFrame([], PHOTOGRAPHS)
        was = before.select("remote_url", F.struct("id", "sha256", "status", "file_size").alias("was"))
        pairs = self.scratch(now["photographs"].select("remote_url", "id", "sha256", "status", "file_size").join(was, "remote_url", "left"))  # which both indexes and the totals take
        index = {}
        for n, c in INDEXES.items():
            old, new = F.col(f"was.{c}"), F.col(c)
            told = F.array(F.struct(old.alias(c), F.lit(True).alias("gone")), F.struct(new.alias(c), F.lit(False).alias("gone")))
            index[n] = pairs.where(~old.eqNullSafe(new)).select("remote_url", F.inline(told)).where(F.col(c).isNotNull())
        put |= self._put(index)
        bytes_ = lambda status, size: F.coalesce(F.sum(F.when(status == "complete", size)), F.lit(0))
        more = pairs.agg(bytes_(F.col("status"), F.col("file_size")) - bytes_(F.col("was.status"), F.col("was.file_size")), F.max("id")).first()
        top = now["subjects"].agg(F.max("id")).first()[0]
        self.drop(pairs)
        old = entry["totals"]
        totals = {"pool": old["pool"] + more[0], "photographs": max(old["photographs"], more[1] or 0), "subjects": max(old["subjects"], top or 0)}
        tables = {t: [*entry["tables"][t], *([put[t]] if put[t] else [])] for t in _SCHEMAS}
        version = self._next(at, tables, totals, [f["path"] for f in put.values() if f], streams)
        return self.compact(version)

    def compact(self, version: int | None = None, whole: bool = False) -> int:
        """Merge folders of a size (`whole`: all of them) into one each, as a version of the same content; a writer who is faster leaves it undone."""
        version = self.version() if version is None else version
        entry = self._entry(version)
        tables, new = dict(entry["tables"]), []
        for table, folders in tables.items():
            first = 0 if whole else _due([f["rows"] for f in folders])
            if len(folders) - first > 1:
                part = folders[first:]
                rows = self._rows(table, part)
                if first == 0 and table in INDEXES:
                    rows = rows.where("not gone")
                merged = self._written(table, rows, sum(f["rows"] for f in part))
                tables[table] = [*folders[:first], *([merged] if merged else [])]
                new += [merged["path"]] if merged else []
        if tables == entry["tables"]:
            return version
        with suppress(Conflict):
            return self._next(version, tables, entry["totals"], new)
        return version

    def transact(self, change: Callable[[int | None], tuple], tries: int = 20):
        """Commit what `change` makes of the version it is given: (subjects, photographs, before, result) and perhaps what its stream notes; the result.

        If another writer is faster, `change` is called again with the version that writer made, so it has
        to be free of other effects, or to repeat them without harm.
        """
        for turn in range(tries):
            at = self.version()
            subjects, photographs, before, result, *streams = change(at)
            try:
                self.commit_changes(subjects, photographs, at, before, *streams)
                return result
            except Conflict:
                if turn == tries - 1:
                    raise
                time.sleep(random.uniform(0, 0.1 * (turn + 1)))

    # what is no longer needed

    def scratch(self, rows: DataFrame) -> DataFrame:
        """`rows` as a table of their own until `drop`, or until the driver ends: what follows from them sees one state of them."""
        path = f"{self.root}/scratch/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        self._fs.deleteOnExit(self._path(path))
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that `scratch` made."""
        for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
            if path.rsplit("/", 2)[-2] == "scratch":
                self._fs.delete(self._path(path), True)

    def _stored(self) -> dict[str, int]:
        """All folders with the time they were last changed."""
        out = {}
        for table in (*_SCHEMAS, "scratch"):
            place = self._path(f"{self.root}/{table}")
            if self._fs.exists(place):
                out |= {f"{table}/{s.getPath().getName()}": s.getModificationTime() for s in self._fs.listStatus(place)}
        return out

    def uncommitted(self) -> list[str]:
        """Folders that belong to no version, scratch tables apart."""
        used = {f["path"] for v in self._versions() for x in self._entry(v)["tables"].values() for f in x}
        return sorted(f for f in set(self._stored()) - used if not f.startswith("scratch/"))

    def expire(self, age: float, keep: int = 1) -> list[int]:
        """Remove versions older than `age` seconds, but for the `keep` latest, and what no version needs; the versions removed.

        Folders without a version go once they are that old too, so `age` has to be more than a writer takes.
        """
        limit = time.time() * 1000 - age * 1000
        known = self._versions()
        old = [v for v, at in list(known.items())[: len(known) - max(1, keep)] if at < limit]
        self._delete(f"log/{v:020d}.json" for v in old)
        stored = self._stored()
        spare = [*self.uncommitted(), *(f for f in stored if f.startswith("scratch/"))]
        self._delete(f for f in spare if stored.get(f, limit) < limit)
        return old


def _due(rows: list[int]) -> int:
    """Where the folders to merge begin: the last ones of which none outweighs four times what follows it, if these are FAN or more."""
    first, held = len(rows), 0
    while first and (held == 0 or rows[first - 1] < 4 * held):
        first -= 1
        held += rows[first]
    return first if len(rows) - first >= FAN else len(rows)


