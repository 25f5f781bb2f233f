"""Ingest from state: restarts, replays and the budget."""

import os
import random

from provlake.operators.ingest import outcomes
from provlake.state import Store
from provlake.streaming.ingest import ingest_batch
from provlake.streaming.stateful import ingest_stateful
from tests.test_catalogue import CANDIDATE, candidate


def many(seed, n):
    r = random.Random(seed)
    urls = {f"https://a/{i}.png": (r.choice(["CC0", "CC0", "PD", "All rights reserved"]), f"{r.randrange(40):064d}", r.randrange(1, 9), r.choice([None, None, None, "timeout"])) for i in range(n // 2)}
    return [candidate(i, u, urls[u][0], urls[u][1], urls[u][2], urls[u][3]) for i, u in enumerate(r.choices(list(urls), k=n))]


def state_of(store):
    return sorted((r.remote_url, r.status, r.sha256, r.file_size, r.filename) for r in store.read("photographs").collect())


def test_restarts_give_what_one_batch_gives(spark, tmp_path):
    rows, source = many(3, 60), str(tmp_path / "in")
    first, rest = rows[:8], rows[8:]
    store, whole = Store(spark, str(tmp_path / "a"), 1), Store(spark, str(tmp_path / "b"), 1)
    for s in (store, whole):  # an earlier run
        ingest_batch(s, spark.createDataFrame(first, CANDIDATE))
    done = outcomes(spark.createDataFrame(rest, CANDIDATE), whole.read("photographs").select("remote_url", "status", "sha256"), whole.totals()["pool"])
    cap = max(r.pool for r in done.collect()) - 1  # only what ends the run is too much
    ingest_batch(whole, spark.createDataFrame(rest, CANDIDATE), cap)
    os.makedirs(source)
    stream = spark.readStream.schema(CANDIDATE).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: ingest_stateful(store, stream, str(tmp_path / "check"), "s", cap).awaitTermination()
    for i, part in enumerate((rest[:17], rest[17:])):  # begun, and started again
        spark.createDataFrame(part, CANDIDATE).coalesce(1).write.mode("append").parquet(source)
        run()
        if i == 0:  # the log has the batch, the checkpoint does not: as after a crash in between
            version = store.version()
            os.remove(tmp_path / "check/commits/0")
            os.remove(tmp_path / "check/commits/.0.crc")
            run()
            assert store.version() == version and store.stream("s") == {"batch": 0, "stopped": False}
    assert state_of(store) == state_of(whole) and store.totals()["pool"] == whole.totals()["pool"] <= cap
    assert sorted(r.id for r in store.read("photographs").collect()) == sorted(r.id for r in whole.read("photographs").collect())
    assert any(s == "pending" for _, s, *_ in state_of(store)) and store.stream("s") == {"batch": 1, "stopped": True}
    version = store.version()
    spark.createDataFrame([candidate(99, size=1)], CANDIDATE).coalesce(1).write.mode("append").parquet(source)
    run()
    assert store.version() == version  # nothing after the budget's stop
