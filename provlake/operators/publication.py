"""Publishing in two phases: all files are staged, then named by a journal, then moved to their places.

Tasks of the `publication` sink put files under the staging folder and write a log each; the sink's
commit, at the driver, names the logs of the tasks that count in a journal, one small file. Up to there
nothing has changed at the destination and an abort deletes the staging folder; from there on the
moves are repeated until they are done, by `finish` or, after a lost driver, by `recover`.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileType, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.storage import absolute, opened
from .pool import export_summary

_STAGING = ".staging-"
_LOG = pa.schema([("id", pa.int64()), ("category", pa.string()), ("subject", pa.string()), ("staged", pa.string()), ("place", pa.string()), ("result", pa.string())])
_ROWS = 10_000


class Publication(DataSource):
    """df.write.format("publication"): rows of a manifest (id, category, subject, path, present).

    Options: root and dest (paths or URIs), mode (copy or symlink, the latter between local folders), run.
    """

    @classmethod
    def name(cls) -> str:
        return "publication"

    def writer(self, schema: StructType, overwrite: bool) -> PublicationWriter:
        return PublicationWriter(dict(self.options))


@dataclass
class Staged(WriterCommitMessage):
    log: str


class PublicationWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.dest, self.mode, self.run = (options[k] for k in ("root", "dest", "mode", "run"))

    def write(self, iterator: Iterator) -> Staged:
        (source, root), (fs, dest) = opened(self.root), opened(self.dest)
        task = TaskContext.get().taskAttemptId()  # an attempt's own, so that no two meet
        staging = f"{dest}/{_STAGING}{self.run}"
        fs.create_dir(f"{staging}/{task}")
        fs.create_dir(f"{staging}/logs")
        n = 0
        with pq.ParquetWriter(f"{staging}/logs/{task}.parquet", _LOG, filesystem=fs) as log:
            for rows in batched(iterator, _ROWS):
                told = []
                for row in rows:
                    n, name = n + 1, f"{task}/{n}"
                    result = self._staged(source, f"{root}/{row.path}", fs, f"{staging}/{name}") if row.present else "missing"
                    told.append({"id": row.id, "category": row.category, "subject": row.subject, "staged": name, "place": row.path, "result": result})
                log.write_table(pa.Table.from_pylist(told, _LOG))
        return Staged(f"{task}.parquet")

    def _staged(self, source, path: str, fs, staged: str) -> str:
        if source.get_file_info(path).type != FileType.File:
            return "missing"
        try:
            if self.mode == "symlink":
                os.symlink(os.path.realpath(path), staged)
            else:
                with source.open_input_stream(path) as a, fs.open_output_stream(staged) as b:
                    while chunk := a.read(1 << 20):
                        b.write(chunk)
        except OSError:
            return "skipped"
        return "published"

    def commit(self, messages: list[Staged | None]) -> None:
        fs, dest = opened(self.dest)
        staging = f"{dest}/{_STAGING}{self.run}"
        fs.create_dir(staging)
        with fs.open_output_stream(f"{staging}/journal.part") as f:
            f.write(json.dumps([m.log for m in messages if m]).encode())
        fs.move(f"{staging}/journal.part", f"{staging}/journal")

    def abort(self, messages: list[Staged | None]) -> None:
        fs, dest = opened(self.dest)
        staging = f"{dest}/{_STAGING}{self.run}"
        if fs.get_file_info(staging).type == FileType.Directory:
            fs.delete_dir(staging)


def stage(plan: DataFrame, root: str, dest: str, mode: str = "copy", run: str | None = None) -> str:
    """The first phase: the files of a manifest are staged and the journal is written; the run's name."""
    if mode not in ("symlink", "copy"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "symlink" and not all(isinstance(opened(x)[0], LocalFileSystem) for x in (root, dest)):
        raise ValueError("symlinks need local folders")
    run = run or uuid.uuid4().hex
    plan.sparkSession.dataSource.register(Publication)
    rows = plan.select("id", "category", "subject", "path", "present")
    rows.write.format("publication").mode("append").options(root=absolute(root), dest=absolute(dest), mode=mode, run=run).save()
    return run


def finish(spark: SparkSession, dest: str, run: str) -> dict[str, int]:
    """The second phase: what the journal of `run` names is moved to its place, and staging goes; (published, skipped, missing, subjects).

    A move that was done before, by a task or a driver that is lost, is found done. A file that stands in the place already is replaced.
    """
    dest = absolute(dest)
    fs, base = opened(dest)
    staging = f"{base}/{_STAGING}{run}"
    with fs.open_input_stream(f"{staging}/journal") as f:
        logs = json.loads(f.read())

    def moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(dest)
        for frame in frames:
            for staged, place in frame.loc[frame["result"] == "published", ["staged", "place"]].itertuples(index=False):
                fs.create_dir(f"{base}/{os.path.dirname(place)}")
                try:
                    fs.move(f"{staging}/{staged}", f"{base}/{place}")
                except FileNotFoundError:
                    if fs.get_file_info(f"{base}/{place}").type == FileType.NotFound:
                        raise
            yield frame[["category", "subject", "result"]]

    root = f"{dest.rstrip('/')}/{_STAGING}{run}"
    rows = spark.createDataFrame([], "id long, category string, subject string, staged string, place string, result string")
    if logs:
        rows = spark.read.schema(rows.schema).parquet(*(f"{root}/logs/{x}" for x in logs))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = rows.repartition(tasks, "place").mapInPandas(moved, "category string, subject string, result string")
    done.write.mode("overwrite").parquet(f"{root}/done")  # each file is moved once, however often the counts below read it
    out = export_summary(spark.read.schema(done.schema).parquet(f"{root}/done")).first().asDict()
    fs.delete_dir(staging)
    return out


def published(plan: DataFrame, root: str, dest: str, mode: str = "copy") -> dict[str, int]:
    """Both phases. With a task that fails for good nothing is published at all."""
    return finish(plan.sparkSession, dest, stage(plan, root, dest, mode))


def recover(spark: SparkSession, dest: str, age: float = 24 * 3600.0) -> list[str]:
    """Finish the runs below `dest` that have a journal, and delete what others left longer than `age` seconds ago; the runs finished."""
    fs, base = opened(dest)
    out = []
    for info in fs.get_file_info(FileSelector(base, allow_not_found=True)):
        if info.type != FileType.Directory or not info.base_name.startswith(_STAGING):
            continue
        run = info.base_name.removeprefix(_STAGING)
        if fs.get_file_info(f"{info.path}/journal").type == FileType.File:
            finish(spark, dest, run)
            out.append(run)
        elif info.mtime is not None and info.mtime.timestamp() < time.time() - age:
            fs.delete_dir(info.path)
    return sorted(out)
