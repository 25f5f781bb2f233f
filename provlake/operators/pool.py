"""The pool of landed files: publishing and verification, as joins of the catalogue with a file listing."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pictures import damaged
from ..functions.text import truthy
from ..state import Store


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256, corrupt) of the files below `root`, paths relative to it; corrupt ones are no whole pictures."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("path"), "length", F.sha2("content", 256).alias("sha256"), damaged("content").alias("corrupt"))


def pool_path(photos: DataFrame) -> DataFrame:
    """Complete photographs (with `subject`) that have a file, and its path below the pool's root."""
    found = photos.where("status = 'complete'").where(truthy(F.col("filename")).isNotNull())
    return found.withColumn("path", F.concat_ws("/", "category", "subject", "filename"))


def relocate(photos: DataFrame, root: str) -> DataFrame:
    """Move the files of the older layout, subject/filename below `root`, to category/subject/filename; (id, path, moved).

    `photos` have subject. A file that is there already in the new place is left alone, and so is its old
    one; a row without a file name or with no old file moves nothing. A repeated run moves nothing more.
    """
    named = photos.where(F.col("filename").isNotNull()).select("id", F.concat_ws("/", "subject", "filename").alias("old"), F.concat_ws("/", "category", "subject", "filename").alias("path"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            moved = []
            for old, path in zip(frame["old"], frame["path"]):
                src, dest = os.path.join(root, old), os.path.join(root, path)
                due = os.path.isfile(src) and not os.path.exists(dest)
                if due:
                    os.makedirs(os.path.dirname(dest), exist_ok=True)
                    os.replace(src, dest)
                moved.append(due)
            yield frame[["id", "path"]].assign(moved=moved)

    return named.dropDuplicates(["old", "path"]).mapInPandas(run, "id long, path string, moved boolean")


def migrated(store: Store, people: DataFrame, photographs: DataFrame, images: str) -> DataFrame:
    """Take over a store of the older layout: commit its tables in the present one and move its files to their new places; what was moved, as `relocate` tells it.

    The commit comes first: a file that is not moved yet is found by a repeated run, and verification tells it.
    """
    from .catalog import photo_scan
    from .ingest import migrate_legacy

    subjects, photos = migrate_legacy(people, photographs)
    version = store.commit(subjects, photos)
    moved = store.scratch(relocate(photo_scan(store.read("photographs", version), store.read("subjects", version)), images))
    return moved


def manifest(photos: DataFrame, files: DataFrame, dest: str) -> DataFrame:
    """(id, category, subject, path, dst, present): what publishing would do."""
    there = files.select("path", F.lit(True).alias("present"))
    out = pool_path(photos).join(there, "path", "left")
    return out.select("id", "category", "subject", "path", F.concat(F.lit(dest.rstrip("/") + "/"), "path").alias("dst"), F.coalesce("present", F.lit(False)).alias("present"))


def publish(plan: DataFrame, root: str, mode: str = "symlink") -> DataFrame:
    """Carry out a manifest and return (id, category, subject, result): published, missing or skipped.

    A file is put under a name of its own and renamed, so a task that runs twice does no harm.
    """
    if mode not in ("symlink", "copy"):
        raise ValueError(f"unknown mode: {mode}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            results = []
            for path, dst, present in zip(frame["path"], frame["dst"], frame["present"]):
                src = os.path.join(root, path)
                if not present or not os.path.exists(src):
                    results.append("missing")
                    continue
                part = f"{dst}.{os.getpid()}.part"
                try:
                    os.makedirs(os.path.dirname(dst), exist_ok=True)
                    shutil.copy2(src, part) if mode == "copy" else os.symlink(os.path.realpath(src), part)
                    os.replace(part, dst)
                    results.append("published")
                except OSError:
                    results.append("skipped")
            yield frame[["id", "category", "subject"]].assign(result=results)

    return plan.mapInPandas(run, "id long, category string, subject string, result string")


def export_summary(done: DataFrame) -> DataFrame:
    out = F.col("result") == "published"
    return done.agg(
        *(F.count_if(F.col("result") == r).alias(r) for r in ("published", "skipped", "missing")),
        F.count_distinct(F.when(out, F.concat_ws("/", "category", "subject"))).alias("subjects"),
    )


def verified(photos: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, verdict): missing, corrupt, mismatch or ok, the first that holds."""
    there = files.select("path", F.col("sha256").alias("found"), "corrupt")
    rows = pool_path(photos).join(there, "path", "left")
    verdict = F.when(F.col("found").isNull(), "missing").when(F.col("corrupt"), "corrupt").when(truthy(F.col("sha256")).isNotNull() & (F.col("sha256") != F.col("found")), "mismatch").otherwise("ok")
    return rows.select("id", "path", verdict.alias("verdict"))


def repaired(photos: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Photographs with the missing and corrupt ones marked failed; mismatches stay."""
    bad = verdicts.where(F.col("verdict").isin("missing", "corrupt")).select("id", F.lit("failed").alias("_now"))
    return photos.join(bad, "id", "left").withColumn("status", F.coalesce("_now", "status")).select(*photos.columns)


def verify_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("ok", "missing", "corrupt", "mismatch")))
