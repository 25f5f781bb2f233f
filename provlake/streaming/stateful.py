"""Streaming ingest with its memory in Spark's state store.

What is known of a url and of a hash is state, keyed by each; a micro-batch costs what it holds, and no
look at the catalogue but for rows that it changes. The pool's size is a total of the store's log, and so
is which micro-batch of the stream is in: a batch that is replayed after a failure is not taken twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StringType, StructType

from ..functions.text import accepted, slugify
from ..operators.ingest import budgeted
from ..schema import PHOTOGRAPHS, TERMINAL
from ..state import Store
from .ingest import landed

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """The rows of a key in the order of seq. Spark loses the names of computed columns on their way here, so these are given."""

    def __init__(self, names: list[str]):
        self.names = names

    def handleInputRows(self, key, frames: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frames = [f for f in frames if len(f.columns) and len(f)]
        if frames:  # else it is a key of the initial state alone
            yield self.judged(pd.concat(frames).set_axis(self.names, axis=1).sort_values("seq"))

    def close(self) -> None:
        pass


class _ByUrl(_Ordered):
    """The part of a candidate's outcome that its url decides; the state is the url's status."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        self.status.update((str(initial["status"].iloc[0]),))

    def judged(self, rows: pd.DataFrame) -> pd.DataFrame:
        status = before = self.status.get()[0] if self.status.exists() else None
        kinds, priors = [], []
        for free, failure in zip(rows["_free"], rows["failure"]):
            priors.append(status)
            if status in TERMINAL:
                kinds.append("skipped")
                continue
            kinds.append("quarantined" if not free else "failed" if isinstance(failure, str) else "live")
            status = "complete" if kinds[-1] == "live" else kinds[-1]
        if status != before:
            self.status.update((status,))
        return rows.assign(prior_status=pd.Series(priors, rows.index, "object"), outcome=kinds)


class _ByHash(_Ordered):
    """Whether a live candidate is the first of its content; the state are the least and the greatest url with it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.urls = handle.getValueState("urls", "low string, high string")

    def handleInitialState(self, key, initial: pd.DataFrame, timers) -> None:
        self.urls.update((str(initial["low"].iloc[0]), str(initial["high"].iloc[0])))

    def judged(self, rows: pd.DataFrame) -> pd.DataFrame:
        held = self.urls.get() if (rows["outcome"] == "live").any() and self.urls.exists() else None
        out = []
        for kind, url in zip(rows["outcome"], rows["remote_url"]):
            if kind == "live":
                kind = "duplicate" if held and (held[0] != url or held[1] != url) else "complete"
                if not held:
                    held = (url, url)
                    self.urls.update(held)
            out.append(kind)
        return rows.assign(outcome=out).drop(columns="_key")


def classified_stream(candidates: DataFrame, known: DataFrame, hashes: DataFrame, strict: bool = False) -> DataFrame:
    """A stream of candidates with prior_status and outcome, as `operators.ingest.classified` has them, but from state.

    `known` (remote_url, status) and `hashes` (sha256, remote_url) are what was there when the stream
    began; they are read by its first micro-batch only. Rows are in order of seq within a micro-batch, and
    an earlier micro-batch comes first. The rows of one url, and those of one content, within a micro-batch
    meet in one task.
    """
    typed = candidates.withColumn("_free", F.coalesce(accepted(F.col("licence"), strict), F.lit(False)))
    told = StructType([*typed.schema.fields]).add("prior_status", StringType()).add("outcome", StringType())
    start = known.where("remote_url is not null").select("remote_url", "status").groupBy("remote_url")
    rows = typed.groupBy("remote_url").transformWithStateInPandas(_ByUrl(typed.columns), told, "Append", "None", start)
    # rows that no hash decides are dealt by their urls
    rows = rows.withColumn("_key", F.when((F.col("outcome") == "live") & F.col("sha256").isNotNull(), F.col("sha256")).otherwise(F.concat(F.lit("-"), "remote_url")))
    ends = hashes.where("sha256 is not null").groupBy(F.col("sha256").alias("_key")).agg(F.min("remote_url").alias("low"), F.max("remote_url").alias("high"))
    return rows.groupBy("_key").transformWithStateInPandas(_ByHash(rows.columns), told, "Append", "None", ends.groupBy("_key")).drop("_free")


def ingest_stateful(store: Store, candidates: DataFrame, checkpoint: str, name: str, cap: int = 0, images: str | None = None, now: bool = True) -> StreamingQuery:
    """Ingest a stream of candidates into the store, with the outcomes that one batch of all of them would have.

    `name` is the stream's, for the log. Once the budget has stopped it, the stream takes nothing more,
    after restarts too; to go on under another cap, begin one of another name with a checkpoint of its own.
    With `now` it ends when all that is there is taken, else it waits for more. seq has to ascend from one
    micro-batch to the next, and the store to have no other writer of the same urls meanwhile: what those
    commit is not in the state.
    """
    spark = candidates.sparkSession
    at = store.version()
    empty = spark.createDataFrame([], PHOTOGRAPHS)
    known = store.read("photographs", at) if at else empty
    candidates = candidates.withColumn("subject", slugify(F.col("subject")))
    rows = classified_stream(candidates, known, known)

    def each(batch: DataFrame, number: int) -> None:
        taken, made = store.scratch(batch), []  # whole, whatever becomes of it: so the state is committed

        def change(at: int | None) -> tuple:
            store.drop(*made)
            made[:] = []
            pool = store.totals(at)["pool"]
            near = store.scratch(store.lookup("photographs", "remote_url", taken.where("prior_status is not null"), at) if at else empty)
            made.append(near)
            *changes, done = landed(store, budgeted(taken, pool, cap), near, at, images, made)
            ended = cap > 0 and (pool > cap or not done.where("outcome = 'pending'").isEmpty())
            return *changes, done, {name: {"batch": number, "stopped": ended}}

        try:
            known = store.stream(name)
            if not (known.get("stopped") or known.get("batch", -1) >= number or taken.isEmpty()):
                store.transact(change)
        finally:
            store.drop(taken, *made)

    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # the query has the settings of the moment it starts
    try:
        out = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if now else out).start()
    finally:
        spark.conf.set(_PROVIDER, old)
