"""A search by pages that is stopped and started again."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from provlake.acquire import acquire_stream
from provlake.sources import archive
from provlake.state import Store
from tests.test_pictures import png


class Archive(BaseHTTPRequestHandler):
    """Three pages for a subject; from `broken` requests on, searches fail."""

    asked, broken = [], 1 << 30

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        if "gsrsearch" in q and len(self.asked) >= Archive.broken:
            self.send_error(404)
            return
        self.send_response(200)
        self.end_headers()
        if "gsrsearch" not in q:
            self.wfile.write(png(3, 2, self.path.encode()))
            return
        name, at = q["gsrsearch"].split()[0], int(q.get("gsroffset", 0))
        self.asked.append((name, at))
        url = lambda i: f"http://127.0.0.1:{self.server.server_port}/{name}{i}.png"
        info = lambda i: [{"url": url(i), "mime": "image/png", "extmetadata": {"LicenseShortName": {"value": "CC0"}}}]
        body = {"query": {"pages": {str(i): {"title": f"File:{name}", "imageinfo": info(i)} for i in (at, at + 1)}}}
        self.wfile.write(json.dumps(body | ({"continue": {"gsroffset": at + 50, "continue": "-||"}} if at < 100 else {})).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    server = HTTPServer(("127.0.0.1", 0), Archive)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Archive.asked, Archive.broken = [], 1 << 30
    yield f"http://127.0.0.1:{server.server_port}/search"
    server.shutdown()


def test_offsets(site):
    options = {"url": site, "subjects": json.dumps([{"subject": n, "category": "identity", "query": n} for n in ("Ann", "Bob")]), "limit": "130", "rate": "1000", "pages": "2"}
    reader, at, seen = archive.PagesReader(options), None, []
    at = reader.initialOffset()
    while True:
        rows, after = reader.read(at)
        rows = list(rows)
        if not rows:
            break
        assert list(archive.PagesReader(options).readBetweenOffsets(at, json.loads(json.dumps(after)))) == rows  # a replay asks the same again
        seen += [r[1:5] for r in rows]
        at = after
    assert seen == [(n, "identity", i, p) for i, n in enumerate(("Ann", "Bob")) for p in range(3)] and at == {"turn": 2, "page": 0, "more": {}}
    short = archive.PagesReader(options | {"limit": "40"})
    assert len(list(short.read(short.initialOffset())[0])) == 2 and short.read(short.initialOffset())[1]["turn"] == 2  # one page each


def test_a_stopped_search_goes_on(spark, site, tmp_path):
    home = str(tmp_path / "h")
    run = lambda: acquire_stream(spark, home, site, category="identity", limit=150, rate=1000, pages=4)
    Archive.broken = 4
    query = run()
    with pytest.raises(Exception):  # noqa: B017 - the second micro-batch can't be read
        query.processAllAvailable()
    query.stop()
    store = Store(spark, f"{home}/metadata")
    assert len(Archive.asked) == 4 and store.read("photographs").count() == 8 and store.stream("commons search")["batch"] == 0
    Archive.broken = 1 << 30
    query = run()
    query.processAllAvailable()
    query.stop()
    assert sorted(Archive.asked) == sorted((n, at) for n in ("Albert", "Marie", "Mark") for at in (0, 50, 100))  # each page once
    rows = store.read("photographs").collect()
    assert len(rows) == 18 and {r.status for r in rows} == {"complete"} and sorted(r.id for r in rows) == list(range(1, 19))
    assert len(list((tmp_path / "h/images/identity").rglob("*.png"))) == 18 and store.read("subjects").where("birth_year is not null").count() == 3
