"""Verification that resumes, and publishing in two phases."""

import os

import pytest
from pyspark.sql import functions as F

from provlake.operators import pool, publication
from provlake.operators.digests import Digests, changed, folders, stamps
from tests.test_pictures import png

PLAN = "id long, category string, subject string, path string, present boolean"


@pytest.fixture
def images(tmp_path):
    root = tmp_path / "images"
    for i in range(12):
        folder = root / f"c{i % 2}" / f"s{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}.png").write_bytes(png(2, 2, b"%d" % i) if i else b"no picture")
    return root


def plan(spark, images):
    files = spark.createDataFrame([(i, f"c{i % 2}", f"s{i % 3}", f"c{i % 2}/s{i % 3}/{i}.png") for i in range(13)], "id long, category string, subject string, path string")
    there = stamps(spark, str(images)).select("path", F.lit(True).alias("present"))
    return files.join(there, "path", "left").select("id", "category", "subject", "path", F.coalesce("present", F.lit(False)).alias("present"))


def test_only_changed_and_due_files_are_read(spark, images, tmp_path):
    digests = Digests(spark, str(tmp_path / "digests"))
    assert digests.read().count() == 0 and digests.refreshes() == []
    first = digests.refresh(str(images), now=1000.0)
    want = {r.path: (r.sha256, r.corrupt) for r in pool.listing(spark, str(images)).collect()}
    assert {r.path: (r.sha256, r.corrupt) for r in first.collect()} == want and first.where("was_read").count() == 12
    assert first.where("corrupt").count() == 1
    # an unchanged file is not opened: this one could not be told apart by length and time
    quiet = images / "c1/s1/1.png"
    stat, data = quiet.stat(), quiet.read_bytes()
    quiet.write_bytes(bytes(len(data)))
    os.utime(quiet, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (images / "c0/s2/2.png").write_bytes(png(3, 3))
    (images / "c0/s1/4.png").unlink()
    (images / "c0/s0/new.png").write_bytes(png(4, 4))
    second = digests.refresh(str(images), max_age=5000.0, now=2000.0)
    assert {r.path for r in second.where("was_read").collect()} == {"c0/s2/2.png", "c0/s0/new.png"}
    assert second.count() == 12 and second.where("path = 'c1/s1/1.png'").first().sha256 == want["c1/s1/1.png"][0]
    assert {(r.folder, r.change) for r in changed(first, second).collect()} == {("", "other"), ("c0", "other"), ("c0/s0", "other"), ("c0/s1", "other"), ("c0/s2", "other")}
    tree = {r.folder: (r.files, r.bytes) for r in folders(second).collect()}
    assert tree[""] == (12, sum(f.stat().st_size for f in images.rglob("*.png"))) and tree["c1"][0] == 6
    third = digests.refresh(str(images), max_age=5000.0, now=6500.0)  # those of the first refresh are due
    assert third.where("was_read").count() == 10 and third.where("path = 'c1/s1/1.png'").first().corrupt
    assert len(digests.refreshes()) == 2
    assert {r.change for r in changed(second, second.limit(0)).collect()} == {"gone"} and changed(third, third).count() == 0


def test_a_refresh_that_was_cut_short_is_none(spark, images, tmp_path):
    digests = Digests(spark, str(tmp_path / "digests"))
    digests.refresh(str(images), now=1.0)
    last = digests.refresh(str(images), now=2.0)
    os.remove(tmp_path / "digests" / digests.refreshes()[-1] / "_SUCCESS")
    assert len(digests.refreshes()) == 1 and digests.read().where("was_read").count() == 12
    assert last.where("was_read").count() == 0


@pytest.mark.parametrize("mode", ["copy", "symlink"])
def test_published(spark, images, tmp_path, mode):
    dest = tmp_path / "out"
    for _ in range(2):  # what is there is replaced
        assert publication.published(plan(spark, images), str(images), str(dest), mode) == {"published": 12, "skipped": 0, "missing": 1, "subjects": 6}
        assert {str(f.relative_to(dest)): f.read_bytes() for f in dest.rglob("*.png")} == {str(f.relative_to(images)): f.read_bytes() for f in images.rglob("*.png")}
        assert sorted(os.listdir(dest)) == ["c0", "c1"]
    assert all(f.is_symlink() == (mode == "symlink") for f in dest.rglob("*.png"))


def test_published_by_uri(spark, images, tmp_path):
    dest = (tmp_path / "uri").as_uri()
    assert publication.published(plan(spark, images), images.as_uri(), dest)["published"] == 12
    with pytest.raises(ValueError, match="mode"):
        publication.stage(plan(spark, images), str(images), dest, "move")
    none = spark.createDataFrame([], PLAN)
    assert publication.published(none, str(images), dest) == {"published": 0, "skipped": 0, "missing": 0, "subjects": 0}


def test_a_failed_task_publishes_nothing(spark, images, tmp_path):
    dest = tmp_path / "out"
    fails = plan(spark, images).withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        publication.published(fails, str(images), str(dest))
    assert not list(dest.rglob("*.png")) and not [x for x in dest.glob("*") if (x / "journal").exists()]
    assert publication.recover(spark, str(dest), age=-1.0) == [] and not (dest.exists() and os.listdir(dest))


def test_a_lost_driver_is_made_good(spark, images, tmp_path):
    dest = tmp_path / "out"
    run = publication.stage(plan(spark, images), str(images), str(dest), run="r1")
    assert not list(dest.glob("c*"))
    staged = sorted(f for f in dest.rglob("*") if f.is_file() and f.parent.name not in ("logs", ".staging-r1"))
    assert len(staged) == 12
    log = spark.read.parquet(*map(str, (dest / ".staging-r1/logs").glob("*.parquet"))).where("result = 'published'").first()
    (dest / log.place).parent.mkdir(parents=True)
    os.replace(dest / ".staging-r1" / log.staged, dest / log.place)  # moved before the driver was lost
    assert publication.recover(spark, str(dest)) == [run]
    assert len(list(dest.rglob("*.png"))) == 12 and sorted(os.listdir(dest)) == ["c0", "c1"]
    assert publication.recover(spark, str(dest)) == []
