"""One acquisition run: seeds, search, licence gate, fetch, ingest, landing."""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.text import accepted
from .operators.ingest import resumed
from .schema import PHOTOGRAPHS
from .sources import archive, seeds
from .sources.fetch import fetch, lanes_of
from .state import Store
from .streaming.ingest import ingest_batch


#: What the seeds know of a subject besides.
_DETAILS = ["wikidata_id", "birth_year", "death_year", "occupation"]


def acquire(spark: SparkSession, home: str, search_url: str, source: str = "commons", category: str | None = None, limit: int = archive.SEARCH_MAX, cap: int = 0, max_bytes: int = 15 * 1024**2, rate: float = 2.0, max_megapixels: float = 12.0) -> DataFrame:
    """Search for the seed subjects and ingest what is found; the outcomes, one row for each candidate taken.

    Only candidates that are free to use and not settled by an earlier run are fetched. What a
    fetch yields is written down first, so the ingest sees one state of it.
    """
    subjects, wanted = _subjects(spark, category)
    reader = spark.read.format(archive.register(spark, source)).options(url=search_url, subjects=wanted, limit=limit, source=source, rate=rate)
    found = archive.candidates(reader.load(), limit).join(subjects, ["subject", "category"])
    found = found.withColumn("seq", (F.col("turn") * archive.SEARCH_MAX + F.col("pos")).cast("long")).drop("turn", "pos")
    return _ingested(Store(spark, f"{home}/metadata"), found, home, cap, max_bytes, rate, max_megapixels)


def _subjects(spark: SparkSession, category: str | None) -> tuple[DataFrame, str]:
    """The seed subjects (subject, category, turn, what else is known), and what a source is told of them."""
    subjects = seeds.load_subjects(spark, category=category).select(F.col("folder").alias("subject"), "category", "query", F.col("seq").alias("turn"), *_DETAILS)
    wanted = [{"subject": r.subject, "category": r.category, "query": r.query} for r in subjects.orderBy("turn").collect()]
    return subjects.drop("query"), json.dumps(wanted)


def _ingested(store: Store, found: DataFrame, home: str, cap: int, max_bytes: int, rate: float, max_megapixels: float, note: Callable[[DataFrame], dict] | None = None) -> DataFrame:
    """Fetch what is due of the candidates, and ingest them."""
    known = store.lookup("photographs", "remote_url", found) if store.version() else store.spark.createDataFrame([], PHOTOGRAPHS)
    state = resumed(found, known.select("remote_url", "status"))
    due = accepted(F.col("licence")) & ~F.col("skip")
    idle = [F.lit(None).cast(t).alias(n) for n, t in [("cached", "string"), ("sha256", "string"), ("size", "long"), ("failure", "string"), ("phash", "string")]]
    got = fetch(state.where(due).select(*found.columns), f"{home}/cache", max_bytes, rate, pictures=True, max_megapixels=max_megapixels).unionByName(state.where(~due).select(*found.columns, *idle), allowMissingColumns=True)
    batch = store.scratch(got)
    shutil.rmtree(lanes_of(f"{home}/cache"), ignore_errors=True)
    try:
        return ingest_batch(store, batch, cap, f"{home}/images", note)
    finally:
        store.drop(batch)


def acquire_stream(spark: SparkSession, home: str, search_url: str, source: str = "commons", category: str | None = None, limit: int = archive.SEARCH_MAX, cap: int = 0, max_bytes: int = 15 * 1024**2, rate: float = 2.0, max_megapixels: float = 12.0, pages: int = 8) -> StreamingQuery:
    """As `acquire`, but page by page: a run that was stopped goes on with the page after the last one it committed.

    Where it stands is kept below `home` and in the store's log; a page that was committed is not
    taken again even if the run ended before it could say so. Once the budget has stopped it, it takes
    nothing more. The query waits when all is done: processAllAvailable() returns then.
    """
    store, name = Store(spark, f"{home}/metadata"), f"{source} search"
    spark.dataSource.register(archive.ArchivePages)
    subjects, wanted = _subjects(spark, category)
    reader = spark.readStream.format("archive_pages").options(url=search_url, subjects=wanted, limit=limit, source=source, rate=rate, pages=pages)
    rows = archive.candidates(reader.load())
    per = -(-limit // archive.SEARCH_MAX)
    seq = ((F.col("turn") * per + F.col("page")) * archive.SEARCH_MAX + F.col("pos")).cast("long")

    def each(batch: DataFrame, number: int) -> None:
        known = store.stream(name)
        if known.get("stopped") or known.get("batch", -1) >= number or batch.isEmpty():
            return
        found = store.scratch(batch.withColumn("seq", seq).drop("turn", "page", "pos").join(subjects.drop("turn"), ["subject", "category"]))
        note = lambda done: {name: {"batch": number, "stopped": cap > 0 and not done.where("outcome = 'pending'").isEmpty()}}
        done = _ingested(store, found, home, cap, max_bytes, rate, max_megapixels, note)
        store.drop(found, done)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{home}/searches/{source}").start()
