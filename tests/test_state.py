"""The versioned store: writers that meet, keyed reads, merged folders, old versions."""

import threading

import pytest
from pyspark.sql import functions as F

from provlake import state
from provlake.schema import PHOTOGRAPHS, SUBJECTS
from provlake.state import Conflict, Store
from provlake.streaming.ingest import ingest_batch
from tests.test_catalogue import CANDIDATE, candidate, photo


def photos(spark, *rows):
    return spark.createDataFrame(list(rows), PHOTOGRAPHS)


def people(spark, *names):
    return spark.createDataFrame([(i, n, "identity", None, None, None, None) for i, n in names], SUBJECTS)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_of_two_writers_gets_the_version(spark, tmp_path):
    a, b = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    a.commit(people(spark, (1, "Ann")), photos(spark, photo(1, 1, file_size=5)))
    at = a.version()
    a.commit_changes(people(spark), photos(spark, photo(2, 1, file_size=7)), at)
    with pytest.raises(Conflict):
        b.commit_changes(people(spark), photos(spark, photo(3, 1)), at)
    assert b.version() == at + 1 and b.uncommitted() == []  # what the loser wrote is gone
    assert sorted(r.id for r in b.read("photographs").collect()) == [1, 2] and b.totals() == {"pool": 12, "subjects": 1, "photographs": 2}
    with pytest.raises(Conflict):  # even if both looked before either claimed
        b._claim({"tables": {}, "totals": {}}, at + 1)
    assert b.read("photographs").count() == 2


def test_writers_at_a_time_lose_nothing(spark, tmp_path):
    root, errors = str(tmp_path / "s"), []
    batches = [[candidate(100 * w + i, sha=f"{i:064d}") for i in range(3)] + [candidate(900, url="https://a/same.png", sha="e" * 64)] for w in range(3)]

    def work(rows):
        try:
            ingest_batch(Store(spark, root), spark.createDataFrame(rows, CANDIDATE))
        except Exception as e:  # noqa: BLE001
            errors.append(str(e)[:3000])

    threads = [threading.Thread(target=work, args=(b,)) for b in batches]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors, errors[0]
    store = Store(spark, root)
    got = store.read("photographs").collect()
    assert sorted(r.id for r in got) == list(range(1, 11)) and len({r.remote_url for r in got}) == 10
    assert sorted(r.sha256 for r in got if r.status == "complete") == sorted([*(f"{i:064d}" for i in range(3)), "e" * 64])  # each content once
    assert sum(r.status == "duplicate" for r in got) == 6 and store.totals() == {"pool": 40, "subjects": 1, "photographs": 10} and store.uncommitted() == []


def test_lookups_read_one_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = [photo(i, 1, sha256=f"{i:064d}", remote_url=f"https://a/{i}") for i in range(200)]
    store.commit(people(spark, (1, "Ann")), photos(spark, *rows))
    for column, value in (("remote_url", "https://a/77"), ("sha256", f"{77:064d}"), ("id", 77)):
        found = store.lookup("photographs", column, [value])
        assert [r.id for r in found.collect()] == [77]
        leaves = found._jdf.queryExecution().sparkPlan().collectLeaves()
        (scan,) = (leaves.apply(i) for i in range(leaves.size()))
        files = scan.inputRDD().filePartitions()
        assert scan.optionalBucketSet().get().cardinality() == 1 and sum(len(files.apply(i).files()) for i in range(files.size())) == 1
    assert store.lookup("photographs", "remote_url", []).count() == 0 == store.lookup("photographs", "sha256", ["x"]).count()
    with pytest.raises(ValueError, match="looked up"):
        store.lookup("photographs", "title", ["x"])


def test_the_resume_join_leaves_the_catalogue_where_it_is(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit(people(spark, (1, "Ann")), photos(spark, *(photo(i, 1, sha256=f"{i:064d}") for i in range(50))))
    store.commit_changes(people(spark), photos(spark, photo(7, 1, status="failed"), photo(60, 1)))
    wanted = spark.range(5, 80).select(F.concat(F.lit("u"), "id").alias("remote_url"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for folder in store._entry()["tables"]["photographs"]:
            found = store._opened("photographs", folder).join(wanted, "remote_url", "left_semi")
            (scan,) = [x for x in plan(found).split("\n") if "FileScan" in x]
            above = plan(found).split(scan)[0]
            assert "Bucketed: true" in scan and above.count("Exchange") == 0 and plan(found).count("Exchange") == 1  # the batch's only
        got = {r.id: r.status for r in store.lookup("photographs", "remote_url", wanted).collect()}
        assert got == {i: "failed" if i == 7 else "complete" for i in [*range(5, 50), 60]}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_changed_rows_take_their_keys_along(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.commit(people(spark, (1, "Ann")), photos(spark, photo(1, 1, sha256="a", file_size=3), photo(2, 1, sha256="b", file_size=4)))
    first = store.version()
    store.commit_changes(people(spark, (2, "Bob")), photos(spark, photo(1, 1, sha256="c", file_size=9), photo(2, 1, status="failed", sha256=None)))
    assert [r.id for r in store.lookup("photographs", "sha256", ["c"]).collect()] == [1]
    assert store.lookup("photographs", "sha256", ["a", "b"]).count() == 0 and store.lookup("photographs", "id", [1, 2]).count() == 2
    assert store.totals() == {"pool": 9, "subjects": 2, "photographs": 2} and store.totals(first)["pool"] == 7
    assert store.lookup("photographs", "sha256", ["a", "b"], first).count() == 2  # pinned
    whole = store.compact(whole=True)
    assert store.lookup("photographs", "sha256", ["a", "b"]).count() == 0 and store.read("by_sha256").count() == 1 and store.totals(whole) == store.totals(first + 1)


def test_reads_do_not_grow_with_the_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    want = {}
    for i in range(14):
        new = [photo(i, 1, title=f"t{i}"), photo(i // 2, 1, title=f"again{i}")] if i else [photo(0, 1, title="t0")]
        want |= {r[0]: r[3] for r in new}
        store.commit_changes(people(spark, (1, "Ann")), photos(spark, *new))
        assert {r.id: r.title for r in store.read("photographs").collect()} == want
        folders = store._entry()["tables"]["photographs"]
        assert len(folders) <= 2 * state.FAN and sum(f["rows"] for f in folders) <= 3 * len(want) + 2
        assert plan(store.read("photographs")).count("LeftAnti") <= 1
    assert store.read("subjects").count() == 1


def test_which_folders_are_merged():
    assert state._due([100, 1, 1]) == 3 and state._due([100, 1, 1, 1, 1]) == 1
    assert state._due([4, 1, 1, 1]) == 0 and state._due([]) == 0 and state._due([5]) == 1
    folders, most, work = [], 0, 0
    for _ in range(5000):
        folders.append(1)
        first = state._due(folders)
        if first < len(folders):
            work += sum(folders[first:])
            folders[first:] = [sum(folders[first:])]
        most = max(most, len(folders))
    assert most <= 30 and work <= 12 * 5000


def test_old_versions_go_by_age(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=1)
    store.commit(people(spark, (1, "Ann")), photos(spark, photo(1, 1)))
    for i in (2, 3):
        store.commit(people(spark, (1, "Ann")), photos(spark, *(photo(k, 1) for k in range(1, i + 1))))
    (tmp_path / "s/photographs/begun").mkdir()
    assert store.expire(3600) == [] and store.read("photographs", 1).count() == 1 and store.uncommitted() == ["photographs/begun"]
    assert store.expire(-1, keep=2) == [1] and store.uncommitted() == []
    with pytest.raises(FileNotFoundError):
        store.read("photographs", 1)
    assert store.read("photographs", 2).count() == 2 and store.read("photographs").count() == 3
    assert store.expire(-1) == [2] and store.read("photographs").count() == 3 and store.ready() == (True, None)
    ingest_batch(store, spark.createDataFrame([candidate(1)], CANDIDATE))
    assert store.read("photographs").count() == 4


def test_a_photograph_without_a_url_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(Exception, match="without remote_url"):
        store.commit(people(spark, (1, "Ann")), photos(spark, photo(1, 1, remote_url=None)))
    assert store.version() is None


def test_a_retry_brings_what_the_download_tells(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    schema = CANDIDATE + ", width int, height int"
    ingest_batch(store, spark.createDataFrame([(*candidate(1, failure="timeout"), None, None)], schema))
    ingest_batch(store, spark.createDataFrame([(*candidate(1), 800, 600)], schema))
    (row,) = store.read("photographs").collect()
    assert (row.status, row.width, row.height, row.id) == ("complete", 800, 600, 1)
    with pytest.raises(Exception, match="without seq"):
        ingest_batch(store, spark.createDataFrame([(None, *candidate(2)[1:], 1, 1)], schema))


def test_large_tables_get_more_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "BUCKET_ROWS", 10)
    store = Store(spark, str(tmp_path / "s"), buckets=2)
    rows = [photo(i, 1, sha256=f"{i:064d}", remote_url=f"https://a/{i}") for i in range(60)]
    store.commit(people(spark, (1, "Ann")), photos(spark, *rows))
    buckets = lambda: {t: [f["buckets"] for f in x] for t, x in store._entry()["tables"].items()}
    assert buckets() == {"subjects": [2], "photographs": [8], "by_id": [8], "by_sha256": [8]}
    store.commit_changes(people(spark), photos(spark, photo(7, 1, status="failed", sha256="x", remote_url="https://a/7"), photo(60, 1, sha256="y", remote_url="https://a/60")))
    assert buckets()["photographs"] == [8, 2]
    for _ in range(2):
        got = {r.remote_url: r.status for r in store.lookup("photographs", "remote_url", spark.range(5, 80).select(F.concat(F.lit("https://a/"), "id").alias("remote_url"))).collect()}
        assert got == {f"https://a/{i}": "failed" if i == 7 else "complete" for i in range(5, 61)} and store.read("photographs").count() == 61
        assert [r.id for r in store.lookup("photographs", "sha256", ["x", f"{7:064d}"]).collect()] == [7] and [r.id for r in store.lookup("photographs", "id", [60]).collect()] == [60]
        store.compact(whole=True)
    assert buckets()["photographs"] == [8] == buckets()["by_sha256"]


def test_a_batch_is_made_once(spark, tmp_path):
    store, made = Store(spark, str(tmp_path / "s")), spark.sparkContext.accumulator(0)
    store.commit(people(spark, (1, "Ann")), photos(spark, photo(1, 1, sha256=f"{3:064d}")))

    @F.udf("string")
    def hashed(x):
        made.add(1)
        return x

    rows = spark.createDataFrame([candidate(i, sha=f"{i:064d}") for i in range(5)], CANDIDATE).withColumn("sha256", hashed("sha256"))
    store.drop(ingest_batch(store, rows))
    assert made.value == 5 and store.read("photographs").where("status = 'duplicate'").count() == 1
    scratch = tmp_path / "s" / "scratch"
    assert list(scratch.iterdir()) == []  # nothing is left of what the batch was kept in
