"""Streaming ingest: micro-batches of candidates through the batch ingest, one version with the changed rows for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import extension, normalise_licence, pool_filename, slugify
from ..operators.ingest import budgeted, classified, upsert_subjects
from ..operators.ordered import with_ids
from ..schema import PHOTOGRAPHS, SUBJECTS
from ..sources.fetch import land
from ..state import Store

#: What a run's outcome makes of a photograph's status; skipped ones stay as they are.
_LANDS = ("complete", "failed", "duplicate", "quarantined", "pending")


def ingest_batch(store: Store, batch: DataFrame, cap: int = 0, images: str | None = None, note: Callable[[DataFrame], dict] | None = None) -> DataFrame:
    """Ingest candidates (seq, subject, category, source, remote_url, source_url, licence, year, title, sha256, size, failure) and commit.

    Whatever else the batch has of the catalogue's columns is kept too: photographer, attribution, width
    and height of a photograph, wikidata_id, birth_year, death_year and occupation of a subject. With `images`, the files of complete ones (column cached) are landed there before the commit.

    Running a batch again changes nothing but failed and pending rows, which are tried again. If another
    writer commits meanwhile, the batch is judged anew by what that one left. A candidate without seq or
    remote_url is an error. `note` makes of the outcomes what the log is to hold of the stream they come from.
    """
    batch = store.scratch(batch.withColumn("subject", slugify(F.col("subject"))))  # hashing whole texts or the like, once
    made: list[DataFrame] = []

    def change(at: int | None) -> tuple:
        store.drop(*made)  # of an attempt that another writer overtook
        made[:] = []
        out = _changes(store, batch, at, cap, images, made)
        return (*out, note(out[-1])) if note else out

    done = store.transact(change)
    store.drop(batch, *(t for t in made if t is not done))
    return done


def _changes(store: Store, batch: DataFrame, at: int | None, cap: int, images: str | None, made: list[DataFrame]) -> tuple:
    """What the batch makes of version `at`: subjects, photographs, those as they were before, and the outcomes.

    Of the catalogue only the rows of the batch's urls and hashes are taken, and the log's totals.
    """
    near = batch.sparkSession.createDataFrame([], PHOTOGRAPHS)
    if at:
        twins = store.lookup("by_sha256", "sha256", batch.where("sha256 is not null"), at).where("not gone")
        urls = batch.select("remote_url").unionAll(twins.select("remote_url"))
        near = store.scratch(store.lookup("photographs", "remote_url", urls, at))
        made.append(near)
    told = store.scratch(classified(batch, near.select("remote_url", "status", "sha256")))  # which the running sums take twice
    made.append(told)
    done = budgeted(told, store.totals(at)["pool"], cap)
    return landed(store, done, near, at, images, made)


def landed(store: Store, done: DataFrame, near: DataFrame, at: int | None, images: str | None, made: list[DataFrame]) -> tuple:
    """What outcomes make of version `at`, whose photographs with these urls are `near`: as `_changes`. Of several for one url the last counts."""
    done = done.where(F.col("outcome").isin(*_LANDS))
    done = store.scratch(done.groupBy("remote_url").agg(F.max_by(F.struct("*"), F.col("seq")).alias("r")).select("r.*"))  # which both tables and the files need
    made.append(done)
    totals = store.totals(at)
    subjects = store.read("subjects", at) if at else done.sparkSession.createDataFrame([], SUBJECTS)

    given = lambda f: (F.col(f.name) if f.name in done.columns else F.lit(None)).cast(f.dataType).alias(f.name)
    new = done.select("seq", "category", F.col("subject").alias("name"), *(given(f) for f in SUBJECTS if f.name not in ("id", "name", "category")))
    changed = store.scratch(upsert_subjects(subjects, new, changed=True, top=totals["subjects"]))
    made.append(changed)
    only = lambda c: F.when(F.col("outcome") == "complete", c)
    fields = {
        "status": F.col("outcome"),
        "sha256": only(F.col("sha256")),
        "file_size": only(F.col("size")),
        "filename": only(pool_filename(F.col("subject"), F.col("year"), F.col("source"), F.col("sha256"), extension(F.col("remote_url")))),
        "downloaded_at": only(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")),
    }
    again = {f.name: only(given(f)) for f in PHOTOGRAPHS if f.name in ("width", "height", "phash")}  # what a download tells, the first one or a later one
    about = [given(f) for f in PHOTOGRAPHS if f.name in ("title", "photographer", "year", "attribution", "width", "height", "phash")]
    told = {**fields, **again}
    fresh = done.select("seq", "remote_url", "subject", "category", "source", "source_url", *about, F.coalesce(normalise_licence(F.col("licence")), "licence").alias("licence"), *(c.alias(f"new_{n}") for n, c in told.items()))
    kept = near.join(fresh.select("remote_url", *(f"new_{n}" for n in told)), "remote_url")
    kept = kept.select(*(F.coalesce(f"new_{n}", n).alias(n) if n in told else F.col(n) for n in PHOTOGRAPHS.names))
    added = fresh.join(near.select("remote_url"), "remote_url", "left_anti")
    named = changed.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"), "category")
    added = with_ids(added, "seq", totals["photographs"]).join(named, ["subject", "category"])
    added = added.select(*(F.col(f"new_{f.name}").alias(f.name) if f.name in fields else F.col(f.name) if f.name in added.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PHOTOGRAPHS))
    if images is not None:
        files = done.where("outcome = 'complete'").withColumn("filename", fields["filename"])
        land(files.withColumnRenamed("seq", "id"), images).count()
    return changed, kept.unionByName(added), near, done


def ingest_stream(store: Store, candidates: DataFrame, checkpoint: str, cap: int = 0) -> StreamingQuery:
    """Ingest a stream of candidates as far as it is there. A replayed micro-batch finds its rows landed and skips them."""

    def each(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.drop(ingest_batch(store, batch, cap))

    return candidates.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
