import pytest
from pyspark.sql import functions as F

from provlake.operators import catalog, ingest, ordered, pool
from provlake.schema import PHOTOGRAPHS, SUBJECTS
from provlake.sources import archive, seeds
from provlake.state import Store
from provlake.streaming.ingest import ingest_batch, ingest_stream


def photo(i, subject, **k):
    row = dict.fromkeys(PHOTOGRAPHS.names)
    return tuple((row | {"id": i, "subject_id": subject, "category": "identity", "source": "commons", "licence": "CC0", "status": "complete", "remote_url": f"u{i}"} | k).values())


@pytest.fixture(scope="module")
def tables(spark):
    subjects = spark.createDataFrame([(1, "Ann", "identity", None, None, None, None), (2, "Kimono", "wardrobe", None, None, None, None), (3, "Zoe", "identity", None, None, None, None)], SUBJECTS)
    rows = [photo(1, 1, file_size=100, filename="a.jpg"), photo(2, 1, file_size=200, licence="PD", filename=""), photo(3, 2, category="wardrobe", source="loc", file_size=50), photo(4, 1, status="pending", licence="PD"), photo(5, 9, licence=None), photo(6, 1, licence="")]
    return spark.createDataFrame(rows, PHOTOGRAPHS), subjects


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_lists(tables):
    assert [r.id for r in catalog.list_photographs(*tables).collect()] == [1, 2, 6, 3]  # the orphan is left out
    assert [r.id for r in catalog.list_photographs(*tables, limit=2, offset=1).collect()] == [2, 6]
    assert len(catalog.list_photographs(*tables, offset=3).collect()) == 4  # an offset alone does nothing
    assert len(catalog.list_photographs(*tables, status="").collect()) == 5
    assert [r.id for r in catalog.list_photographs(*tables, category=" ", subject="Ann", licences=[]).collect()] == [1, 2, 6]
    assert not catalog.list_photographs(*tables, licences=["cc0"]).collect()
    assert catalog.orphans(*tables).first().id == 5
    with pytest.raises(ValueError, match="limit"):
        catalog.page(*tables, limit=501)
    assert catalog.page(*tables, limit=1).columns == list(catalog.WIRE)


def test_counts(tables):
    assert rows(catalog.subjects_with_counts(*tables)) == [("Ann", "identity", 3), ("Zoe", "identity", 0), ("Kimono", "wardrobe", 1)]
    assert dict(rows(catalog.counts_by(tables[0], "licence"))) == {"CC0": 2, "PD": 1, "?": 2}
    with pytest.raises(ValueError, match="unsupported"):
        catalog.counts_by(tables[0], "title")
    got = {(s, k): n for s, k, n in rows(catalog.stats(*tables))}
    assert got[("subjects", "")] == 3 and got[("photographs", "")] == 6 and got[("total_bytes", "")] == 350
    assert got[("by_status", "pending")] == 1 and got[("by_licence", "?")] == 2 and ("by_status", "failed") not in got


def test_empty_statistics(spark):
    empty = spark.createDataFrame([], PHOTOGRAPHS), spark.createDataFrame([], SUBJECTS)
    assert sorted(rows(catalog.stats(*empty))) == [("photographs", "", 0), ("subjects", "", 0), ("total_bytes", "", 0)]


def test_pages_push_their_filters(spark, tables, tmp_path):
    tables[0].write.parquet(str(tmp_path / "p"))
    plan = catalog.list_photographs(spark.read.parquet(str(tmp_path / "p")), tables[1], source="loc", limit=5)._jdf.queryExecution().toString()
    assert "EqualTo(source,loc)" in plan and "TakeOrderedAndProject" in plan


def fold(candidates, known, pool_, cap):
    """The rules one record at a time."""
    state = {u: [s, h] for u, s, h in known}
    out, stopped = [], False
    for seq, url, licence, sha, size, failure in candidates:
        old = state.get(url)
        if old and old[0] in ("complete", "duplicate", "quarantined"):
            out.append((seq, "skipped"))
        elif licence == "no":
            state[url] = ["quarantined", old[1] if old else None]
            out.append((seq, "quarantined"))
        elif cap and pool_ > cap:
            break
        else:
            entry = state.setdefault(url, ["downloading", None])
            if failure:
                entry[0] = "failed"
                out.append((seq, "failed"))
            elif any(h == sha for u, (_, h) in state.items() if u != url):
                entry[0] = "duplicate"
                out.append((seq, "duplicate"))
            elif cap and pool_ + size > cap:
                out.append((seq, "pending"))
                break
            else:
                state[url] = ["complete", sha]
                pool_ += size
                out.append((seq, "complete"))
    return out


def test_outcomes_equal_a_fold(spark):
    import random

    r = random.Random(1)
    for pool_, cap in [(0, 0), (0, 40), (10, 25), (50, 30), (0, 1)]:
        urls = {f"u{i}": (r.choice(["CC0", "CC0", "no"]), f"h{r.randrange(12)}", r.randrange(9), r.choice([None, None, None, "x"])) for i in range(25)}
        cands = [(i, u, *urls[u]) for i, u in enumerate(r.choices(list(urls), k=45))]
        known = [(u, r.choice(["complete", "duplicate", "quarantined", "failed", "pending"]), r.choice([None, urls[u][1]])) for u in r.sample(list(urls), 6)]
        known = [(u, s, h if s in ("complete", "failed") else None) for u, s, h in known]
        c = spark.createDataFrame(cands, "seq long, remote_url string, licence string, sha256 string, size long, failure string")
        k = spark.createDataFrame(known, "remote_url string, status string, sha256 string")
        got = sorted((x.seq, x.outcome) for x in ingest.outcomes(c, k, pool_, cap).collect())
        assert got == fold(cands, known, pool_, cap), (pool_, cap)


def test_prefix_in_two_levels(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("seq"), (F.col("id") % 4).alias("x"))
    got = {r.seq: r.s for r in ordered.with_prefix(df, "seq", F.col("x"), "s", width=10).collect()}
    total = 0
    for i in range(50):
        total += i % 4
        assert got[i * 3] == total


def test_prefix_of_scattered_numbers(spark):
    import random

    r = random.Random(2)
    seqs = sorted({*(r.randrange(-(1 << 62), 1 << 62) for _ in range(60)), *range(-15, 15), -20, 20})
    df = spark.createDataFrame([(q, i % 5) for i, q in enumerate(seqs)] + [(None, 7)], "seq long, x long")
    got = {row.seq: row.s for row in ordered.with_prefix(df, "seq", F.col("x"), "s", width=10, group=3).collect()}
    total, want = 0, {}
    for i, q in enumerate(seqs):
        total += i % 5
        want[q] = total
    assert got == want


def test_upsert(spark):
    old = spark.createDataFrame([(7, "Ann", "identity", "Q1", None, None, None)], SUBJECTS)
    new = spark.createDataFrame([(2, "Bob", "identity", None, 1900, None, None), (1, "Ann", "wardrobe", None, None, None, None), (3, "Ann", "identity", None, 1850, None, "x"), (4, "Bob", "identity", "Q2", None, None, None)], "seq long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SUBJECTS.fields[1:]))
    got = {(r.name, r.category): (r.id, r.wikidata_id, r.birth_year, r.occupation) for r in ingest.upsert_subjects(old, new).collect()}
    assert got == {("Ann", "identity"): (7, "Q1", 1850, "x"), ("Ann", "wardrobe"): (8, None, None, None), ("Bob", "identity"): (9, "Q2", 1900, None)}


def test_pool(spark, tables, tmp_path):
    from tests.test_pictures import png

    root, picture = tmp_path / "pool", png()
    (root / "identity/Ann").mkdir(parents=True)
    (root / "identity/Ann/a.jpg").write_bytes(picture)
    scan = catalog.photo_scan(*tables)
    for mode in ("copy", "symlink"):
        plan = pool.manifest(scan, pool.listing(spark, str(root)), str(tmp_path / mode))
        done = pool.publish(plan, str(root), mode)
        assert pool.export_summary(done).first().asDict() == {"published": 1, "skipped": 0, "missing": 0, "subjects": 1}
        assert (tmp_path / mode / "identity/Ann/a.jpg").read_bytes() == picture
    assert (tmp_path / "symlink/identity/Ann/a.jpg").is_symlink()
    with pytest.raises(ValueError, match="mode"):
        pool.publish(plan, str(root), "move")
    found = pool.verified(scan.withColumn("sha256", F.lit("other")), pool.listing(spark, str(root)))
    assert found.first().verdict == "mismatch"
    assert pool.repaired(tables[0], found).where("id = 1").first().status == "complete"  # a mismatch is never repaired
    (root / "identity/Ann/a.jpg").unlink()
    (root / "identity/Ann/b.jpg").write_bytes(b"y")
    found = pool.verified(scan, pool.listing(spark, str(root)))
    assert found.first().verdict == "missing" and pool.repaired(tables[0], found).where("id = 1").first().status == "failed"


def test_seeds(spark, tmp_path):
    assert seeds.load_subjects(spark).count() == 12
    (tmp_path / "s.yaml").write_text("subjects: [{name: A b, category: ' X '}, {name: C}]")
    assert [(r.folder, r.category) for r in seeds.load_subjects(spark, seed_path=str(tmp_path / "s.yaml"), category="Y").orderBy("seq").collect()] == [("A_b", "x"), ("C", "y")]
    with pytest.raises(NotImplementedError):
        seeds.load_subjects(spark, from_wikidata=True)


def test_archive_responses(spark):
    import json

    image = {"url": "https://a/1.jpg", "mime": "image/jpeg", "extmetadata": {"LicenseShortName": {"value": ""}, "UsageTerms": {"value": " Public domain "}, "Artist": {"value": "<b>Ann</b>"}, "DateTimeOriginal": {"value": "taken 1921"}}}
    body = {"query": {"pages": {"1": {"title": "File:One", "imageinfo": [image]}, "2": {"title": "File:Two", "imageinfo": [image | {"mime": "application/pdf"}]}, "3": {"title": "File:"}, "4": {"imageinfo": [image | {"url": "", "mime": "image/png"}]}}}}
    df = spark.createDataFrame([("commons", "Ann", "identity", json.dumps(body)), ("commons", "Bob", "identity", "{}")], "source string, subject string, category string, response string")
    (got,) = archive.candidates(df).collect()
    assert (got.title, got.photographer, got.year, got.licence, got.source_url, got.attribution) == ("One", "Ann", 1921, "Public domain", "https://a/1.jpg", "Ann")


def test_archive_source(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Search(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"query": {"pages": {"1": {"title": self.path}}}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Search)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with pytest.raises(KeyError, match="commons"):
        archive.register(spark, "other")
    wanted = json.dumps([{"subject": "A_b", "category": "identity", "query": "A b"}])
    (row,) = spark.read.format(archive.register(spark, "commons")).option("url", f"http://127.0.0.1:{server.server_port}/").option("subjects", wanted).option("limit", "90").load().collect()
    server.shutdown()
    assert row.subject == "A_b" and "gsrlimit=50" in row.response and "gsrsearch=A+b" in row.response


def test_rate_and_retries():
    from urllib.error import HTTPError, URLError

    now, slept = [0.0], []
    bucket = archive.Bucket(2.0, 2, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(4):
        bucket.take()
    assert slept == [0.5, 0.5]
    answers = [HTTPError("u", 503, "", {}, None), URLError("x"), b"ok"]

    def ask():
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert archive.fetched(ask, sleep=lambda s: None) == b"ok"
    answers[:] = [HTTPError("u", 404, "", {}, None), b"never"]
    with pytest.raises(HTTPError):
        archive.fetched(ask, sleep=lambda s: None)


CANDIDATE = "seq long, subject string, category string, source string, remote_url string, source_url string, licence string, year int, title string, sha256 string, size long, failure string"


def candidate(i, url=None, licence="CC0", sha=None, size=10, failure=None):
    return (i, "Ann B", "identity", "commons", url or f"https://a/{i}.png", "s", licence, 1900, "t", sha or f"{i:064d}", size, failure)


def test_store_and_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.ready() == (False, "catalogue unavailable") and not (tmp_path / "store").exists()
    batch = spark.createDataFrame([candidate(1), candidate(2, sha=f"{1:064d}"), candidate(3, licence="All rights reserved"), candidate(4, failure="timeout"), candidate(5, size=95)], CANDIDATE)
    done = ingest_batch(store, batch, cap=100)
    assert sorted((r.seq, r.outcome) for r in done.collect()) == [(1, "complete"), (2, "duplicate"), (3, "quarantined"), (4, "failed"), (5, "pending")]
    photos = {r.remote_url: r for r in store.read("photographs").collect()}
    assert len(photos) == 5 and sorted(r.id for r in photos.values()) == [1, 2, 3, 4, 5]
    first = photos["https://a/1.png"]
    assert first.filename == "ann_b_1900_commons_00000000.png" and first.file_size == 10 and photos["https://a/2.png"].sha256 is None and photos["https://a/3.png"].licence == "All rights reserved"
    assert store.ready() == (True, None) and store.read("subjects").count() == 1
    version = store.version()
    ingest_batch(store, batch, cap=200)  # a second run lands what was pending and changes nothing else
    again = {r.remote_url: r for r in store.read("photographs").collect()}
    assert {u: r.status for u, r in again.items()} == {u: r.status for u, r in photos.items()} | {"https://a/5.png": "complete"}
    assert store.read("photographs", version).where("status = 'pending'").count() == 1  # pinned readers see what they opened
    (tmp_path / "store" / "photographs" / "begun").mkdir()
    assert store.uncommitted() == ["photographs/begun"] and store.version() == version + 1


def test_stream_equals_batch(spark, tmp_path):
    rows_ = [candidate(i, sha=f"{i % 7:064d}") for i in range(20)]
    source = tmp_path / "in"
    for i in range(0, 20, 5):
        spark.createDataFrame(rows_[i : i + 5], CANDIDATE).coalesce(1).write.mode("append").parquet(str(source))
    store, whole = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    stream = spark.readStream.schema(CANDIDATE).option("maxFilesPerTrigger", 1).parquet(str(source))
    for _ in range(2):  # started again, it has nothing left to do
        ingest_stream(store, stream, str(tmp_path / "check")).awaitTermination()
    ingest_batch(whole, spark.createDataFrame(rows_, CANDIDATE))
    count = lambda s: sorted(tuple(r) for r in s.read("photographs").groupBy("status").count().collect())
    assert count(store) == count(whole) == [("complete", 7), ("duplicate", 13)]
