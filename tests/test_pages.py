"""Pages by cursor equal the lists, and read what they show."""

import random

import pytest

from provlake.operators import catalog
from provlake.operators.pages import Listing
from provlake.schema import PHOTOGRAPHS, SUBJECTS
from provlake.state import Store
from tests.test_catalogue import photo


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    r = random.Random(5)
    subjects = spark.createDataFrame([(i, f"S{i}", r.choice(["identity", "wardrobe"]), None, None, None, None) for i in range(1, 8)], SUBJECTS)
    rows = [photo(i, r.choice([1, 1, 1, *range(2, 10)]), category=r.choice(["identity", "wardrobe"]), status=r.choice(["complete"] * 4 + ["failed"]), licence=r.choice(["CC0", "PD"])) for i in range(1, 201)]
    out = Store(spark, str(tmp_path_factory.mktemp("pages") / "s"), 2)
    out.commit(subjects, spark.createDataFrame(rows, PHOTOGRAPHS))
    return out


@pytest.mark.parametrize("filters", [{}, {"status": None, "licences": ["PD"]}, {"category": "Wardrobe", "subject": "S1"}, {"subject": "nobody"}])
def test_pages_equal_the_list(store, filters):
    listing = Listing.of(store, rows=40)
    want = [r.id for r in catalog.list_photographs(store.read("photographs"), store.read("subjects"), **filters).collect()]
    got, after = [], None
    while True:
        page = listing.page(25, after, **filters)
        rows = page.rows.collect()
        got += [r.id for r in rows]
        assert page.total.first().n == len(want) and page.rows.columns == list(catalog.WIRE)
        if page.cursor is None:
            break
        assert len(rows) == 25
        after = page.cursor
    assert got == want


def test_a_late_page_reads_its_range(spark, store, tmp_path):
    import shutil

    listing = Listing.of(store, rows=40)
    assert len(listing.ranges) >= 4 and sum(r["n"] for r in listing.ranges) == catalog.photo_scan(store.read("photographs"), store.read("subjects")).count()
    last = listing.ranges[-1]
    want = [r.id for r in listing.page(3, [last[c] for c in ("category", "subject", "id")], status=None).rows.collect()]
    shutil.copytree(listing.path, tmp_path / "copy")
    for r in listing.ranges[:-1]:
        shutil.rmtree(tmp_path / f"copy/rows/part={r['part']}")  # what the page does not need
    rest = Listing(spark, str(tmp_path / "copy"))
    assert [r.id for r in rest.page(3, [last[c] for c in ("category", "subject", "id")], status=None).rows.collect()] == want and len(want) == 3
    with pytest.raises(ValueError, match="limit"):
        listing.page(501)


def test_a_listing_stays_with_its_version(store):
    before = Listing.of(store).page(5, status=None)
    at = store.version()
    store.commit_changes(store.spark.createDataFrame([], SUBJECTS), store.spark.createDataFrame([photo(900, 1)], PHOTOGRAPHS))
    assert Listing.of(store, at).page(5, status=None).total.first().n == before.total.first().n
    assert Listing.of(store).page(5, status=None).total.first().n == before.total.first().n + 1


def test_ranges_go_by_rows_not_by_ids(spark, tmp_path):
    out = Store(spark, str(tmp_path / "s"), 2)
    ids = [*range(1, 61), *range(10**9, 10**9 + 60)]
    out.commit(spark.createDataFrame([(1, "S1", "identity", None, None, None, None)], SUBJECTS), spark.createDataFrame([photo(i, 1) for i in ids], PHOTOGRAPHS))
    listing = Listing.of(out, rows=40)
    assert [r["n"] for r in listing.ranges] == [40, 40, 40]
    page = listing.page(50)
    assert [r.id for r in page.rows.collect()] == ids[:50] and page.total.first().n == 120
    assert [r.id for r in listing.page(50, page.cursor).rows.collect()] == ids[50:100]
