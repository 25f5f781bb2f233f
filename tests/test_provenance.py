"""What a candidate says of itself and its subject reaches the store."""

import io
import json

from provlake.operators.catalog import list_photographs
from provlake.schema import PHOTOGRAPHS
from provlake.sources import archive
from provlake.state import Store
from provlake.streaming.ingest import ingest_batch


def test_ingest_keeps_provenance(spark, tmp_path):
    schema = "seq long, subject string, category string, source string, remote_url string, source_url string, licence string, year int, title string, sha256 string, size long, failure string, photographer string, attribution string, width int, height int, wikidata_id string, birth_year int, death_year int, occupation string"
    row = (1, "Albert Einstein", "identity", "commons", "https://img/a.jpg", "https://page", "Public domain", 1921, "A portrait", "ab" * 32, 10, None, "Someone", "Someone else", 800, 600, "Q937", 1879, 1955, "physicist")
    store = Store(spark, str(tmp_path / "metadata"))
    batch = spark.createDataFrame([row], schema)
    for _ in range(2):  # a second run changes nothing
        ingest_batch(store, batch)
        photos, subjects = store.read("photographs"), store.read("subjects")
        got = list_photographs(photos, subjects).first()
        assert (got.photographer, got.attribution, got.width, got.height, got.year, got.title) == ("Someone", "Someone else", 800, 600, 1921, "A portrait")
        assert tuple(subjects.first())[1:] == ("Albert_Einstein", "identity", "Q937", 1879, 1955, "physicist")
    less = batch.drop("photographer", "width", "wikidata_id").withColumnsRenamed({}).replace("https://img/a.jpg", "https://img/b.jpg").replace("ab" * 32, "cd" * 32)
    ingest_batch(store, less)
    assert store.read("photographs").count() == 2 and set(store.read("photographs").columns) == set(PHOTOGRAPHS.names)
    assert store.read("subjects").first().wikidata_id == "Q937"  # what is not said does not erase what is known


def test_search_keeps_its_rate(monkeypatch):
    subjects = [{"subject": f"s{i}", "category": "identity", "query": f"q{i}"} for i in range(10)]
    monkeypatch.setattr(archive, "urlopen", lambda *a, **k: io.BytesIO(b"{}"))
    reader = archive.ArchiveReader({"url": "http://x", "subjects": json.dumps(subjects), "rate": "2"})
    slept, found = [], []
    for lane in reader.partitions():
        found += [r[1] for r in reader.read(lane, sleep=slept.append)]
    assert sorted(found) == sorted(s["subject"] for s in subjects)
    assert len(reader.partitions()) == archive.LANES and len(slept) == 10 - archive.LANES
    assert all(1.9 < x <= 2 for x in slept)  # each of four lanes sends one search in two seconds
