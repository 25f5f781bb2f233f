import hashlib
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from provlake.sources.fetch import TooLarge, download, fetch, land

BODY = bytes(range(256)) * 1000


class Files(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/gone.png":
            self.send_error(404)
            return
        start = int(self.headers.get("Range", "bytes=0-").split("=")[1].rstrip("-"))
        if start >= len(BODY):
            self.send_error(416)
            return
        self.send_response(206 if start and self.path != "/whole.png" else 200)
        self.end_headers()
        self.wfile.write(BODY if self.path == "/whole.png" else BODY[start:])

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def site():
    server = HTTPServer(("127.0.0.1", 0), Files)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_download_goes_on_where_it_stopped(site, tmp_path):
    part = tmp_path / "x.part"
    for name in ("a.png", "whole.png"):  # a server without ranges sends all of it again
        for held in (b"", BODY[:777], BODY):
            part.write_bytes(held)
            download(f"{site}/{name}", str(part))
            assert part.read_bytes() == BODY
    part.unlink()
    with pytest.raises(TooLarge):
        download(f"{site}/a.png", str(part), max_bytes=len(BODY) - 1)
    assert not part.exists()
    download(f"{site}/a.png", str(part), max_bytes=len(BODY))


def test_fetch_and_land(spark, site, tmp_path):
    rows = [(i, "loc", f"{site}/{n}.png", 5) for i, n in enumerate(["a", "b", "gone"])]
    df = spark.createDataFrame(rows, "seq long, source string, remote_url string, size long")
    for _ in range(2):  # a second run reads what the first one left
        got = {r.seq: r for r in fetch(df, str(tmp_path / "cache"), rate=1000, base=0.01).collect()}
        assert got[0].sha256 == got[1].sha256 == hashlib.sha256(BODY).hexdigest() and got[0].size == len(BODY)
        assert "404" in got[2].failure and got[2].sha256 is None and got[2].size is None
    capped = fetch(df.where("seq = 0"), str(tmp_path / "other"), max_bytes=10, rate=1000).first()
    assert (capped.failure, capped.sha256) == ("size_cap", None)
    whole = fetch(df.where("seq = 0"), str(tmp_path / "pictures"), rate=1000, pictures=True).first()
    assert (whole.failure, whole.sha256, whole.width) == ("decode:no picture", None, None) and not list((tmp_path / "pictures").iterdir())
    files = spark.createDataFrame([(1, got[0].cached, "identity", "Ann", "a.png")], "id long, cached string, category string, subject string, filename string")
    for _ in range(2):
        assert [tuple(r) for r in land(files, str(tmp_path / "images")).collect()] == [(1, "identity/Ann/a.png")]
    assert (tmp_path / "images/identity/Ann/a.png").read_bytes() == BODY


def test_lanes_share_a_rate_and_hand_it_over(tmp_path):
    """Four lanes on one clock: together they keep the rate, and the last one gets all of it."""
    from provlake.sources.fetch import Lane

    now, taken, left = [0.0] * 4, [], [2, 2, 2, 12]  # each task's own time; the one that is behind goes first

    def lane(i):
        return Lane(str(tmp_path / "lanes"), i, 4, 2.0, 4, 1.0, lambda: now[i], lambda s: now.__setitem__(i, now[i] + s))

    lanes = [lane(i) for i in range(4)]
    while any(left):
        i = min((k for k in range(4) if left[k]), key=lambda k: now[k])
        lanes[i].take()
        taken.append((now[i], i))
        left[i] -= 1
        if not left[i]:
            lanes[i].end()
    times = sorted(t for t, _ in taken)
    assert all(len([t for t in times if a <= t < a + 5]) <= 2 * 5 + 4 for a in times)  # the rate and its burst
    last = sorted(t for t, i in taken if i == 3)
    assert last[1] - last[0] > 1.9 and 0.45 < last[-1] - last[-2] < 0.55


def test_one_source_is_fetched_by_several_tasks(spark, site, tmp_path):
    from pyspark.sql import functions as F

    rows = [(i, "loc", f"{site}/{i}.png") for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, source string, remote_url string")
    got = fetch(df, str(tmp_path / "cache"), rate=1000, base=0.01, lanes=4).withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 40 and len({r.task for r in got}) > 1 and {r.sha256 for r in got} == {hashlib.sha256(BODY).hexdigest()}


def test_megapixel_cap(spark, tmp_path):
    """What the cap does to files that are there already, as after a fetch."""
    import numpy as np

    from provlake.functions.pictures import examined
    from tests.test_pictures import filtered, jpeg

    rows = [(1, "loc", "http://x/big.png", filtered(np.full((40, 60, 3), 7), [0] * 40, 2)), (2, "loc", "http://x/big.jpg", jpeg(300, 200)), (3, "loc", "http://x/small.jpg", jpeg(3, 2))]
    df = spark.createDataFrame([r[:3] for r in rows], "seq long, source string, remote_url string")
    (tmp_path / "cache").mkdir()
    for _, source, url, data in rows:
        (tmp_path / "cache" / f"{source}-{hashlib.sha1(url.encode()).hexdigest()}{url[-4:]}").write_bytes(data)
    for _ in range(2):  # the second time the scaled file is there
        got = {r.seq: r for r in fetch(df, str(tmp_path / "cache"), pictures=True, max_megapixels=0.0006).collect()}
        assert (got[1].width, got[1].height, got[1].failure) == (30, 20, None) and len(got[1].phash) == 16
        assert (got[2].failure, got[2].sha256, got[2].width) == ("megapixel_cap", None, None) and (got[3].width, got[3].height, got[3].phash) == (3, 2, None)
        data = open(got[1].cached, "rb").read()
        assert examined(data) == (30, 20) and hashlib.sha256(data).hexdigest() == got[1].sha256 and len(data) == got[1].size
