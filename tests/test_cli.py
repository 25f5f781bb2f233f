import io

from provlake import cli
from provlake.state import Store
from tests.test_catalogue import CANDIDATE, candidate
from tests.test_pictures import png


def test_commands(spark, tmp_path):
    def run(*argv):
        out = io.StringIO()
        assert cli.main(["--home", str(tmp_path / "home"), *argv], spark, out) == 0
        return out.getvalue()

    assert run("stats").splitlines()[0].startswith("photographs\t\t0") and not (tmp_path / "home").exists()
    spark.createDataFrame([candidate(1), candidate(2, licence="no")], CANDIDATE).write.parquet(str(tmp_path / "c"))
    assert run("fetch", str(tmp_path / "c")).split() == ["complete", "1", "quarantined", "1"]
    assert run("list").splitlines()[0] == "1 photographs"
    assert run("list", "--status", "", "--licence", ",").splitlines()[0] == "2 photographs"
    assert run("subjects") == run("people") == "Ann_B\tidentity\t1\n"
    folder = tmp_path / "home/images/identity/Ann_B"
    folder.mkdir(parents=True)
    (folder / "other.jpg").write_bytes(b"x")
    assert run("verify", "--repair") == "ok=0 missing=1 corrupt=0 mismatch=0\n"
    assert run("list").splitlines()[0] == "0 photographs"
    assert run("export", "--dest", str(tmp_path / "out")) == "published=0 skipped=0 missing=0 subjects=0\n"
    assert len(run("plan").splitlines()) == 12


def test_budget_from_the_environment():
    assert cli.max_total_bytes({}) == 40 * 1024**3
    assert cli.max_total_bytes({"PROVLAKE_MAX_GB": "0"}) == 0
    assert cli.max_total_bytes({"PROVLAKE_MAX_GB": " 1.5 "}) == 3 * 1024**3 // 2


def test_run_from_search_to_pool(spark, tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Archive(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            if not self.path.startswith("/search"):
                self.wfile.write(png(3, 2, self.path.encode()))
                return
            name = parse_qs(urlparse(self.path).query)["gsrsearch"][0].split()[0]
            info = lambda n, licence: [{"url": f"http://127.0.0.1:{server.server_port}/{n}", "mime": "image/png", "extmetadata": {"LicenseShortName": {"value": licence}}}]
            pages = {"1": {"title": "File:1900", "imageinfo": info(f"{name}.png", "CC0")}, "2": {"title": "File:b", "imageinfo": info(f"{name}2.png", "CC BY")}, "3": {"title": "File:c", "imageinfo": info("same.png?" + name, "PD")}}
            self.wfile.write(json.dumps({"query": {"pages": pages}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Archive)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def run(*argv):
        out = io.StringIO()
        cli.main(["--home", str(tmp_path / "h"), *argv], spark, out)
        return out.getvalue().split()

    from provlake.acquire import acquire

    done = acquire(spark, str(tmp_path / "h"), f"http://127.0.0.1:{server.server_port}/search", category="identity", rate=1000)
    assert sorted(tuple(r) for r in done.groupBy("outcome").count().collect()) == [("complete", 6), ("quarantined", 3)]
    assert run("verify") == ["ok=6", "missing=0", "corrupt=0", "mismatch=0"]
    assert run("list", "--subject", "Mark_Twain")[0] == "2"
    store = Store(spark, str(tmp_path / "h/metadata"))
    assert {(r.width, r.height) for r in store.read("photographs").where("status = 'complete'").collect()} == {(3, 2)}
    again = acquire(spark, str(tmp_path / "h"), f"http://127.0.0.1:{server.server_port}/search", category="identity", rate=1000)
    assert again.count() == 0 and run("stats")[:2] == ["by_category", "identity"]  # all is settled
    server.shutdown()


def test_migration_moves_files_and_old_versions_go(spark, tmp_path):
    def run(*argv):
        out = io.StringIO()
        assert cli.main(["--home", str(tmp_path / "home"), *argv], spark, out) == 0
        return out.getvalue()

    people = "id long, name string, wikidata_id string, birth_year int, death_year int, occupation string"
    photos = "id long, person_id long, source string, source_url string, licence string, remote_url string, file_size long, filename string, sha256 string, status string"
    spark.createDataFrame([(1, "Ann_B", None, 1900, None, None)], people).write.parquet(str(tmp_path / "people"))
    spark.createDataFrame([(4, 1, "loc", "s", "CC0", "https://a/4.png", 3, "x.png", None, "complete"), (5, 1, "loc", "s", "CC0", "https://a/5.png", None, None, None, "pending")], photos).write.parquet(str(tmp_path / "photos"))
    folder = tmp_path / "home/images/Ann_B"
    folder.mkdir(parents=True)
    (folder / "x.png").write_bytes(png())
    old = ["migrate", str(tmp_path / "people"), str(tmp_path / "photos")]
    assert run(*old) == "moved=1\n" and (tmp_path / "home/images/identity/Ann_B/x.png").read_bytes() == png()
    assert run("verify") == "ok=1 missing=0 corrupt=0 mismatch=0\n"
    assert run(*old) == "moved=0\n" and run("list").splitlines()[0] == "1 photographs"
    assert run("expire") == "removed=0\n" and run("expire", "--age=-1") == "removed=1\n" and run("list", "--status", "").splitlines()[0] == "2 photographs"
    lines = run("curated", "--category", "identity").splitlines()
    assert lines[0].split("\t")[:3] == ["Albert_Einstein", "identity", "1879-1955"] and len(lines) == 3
    assert run("curated", "--category", "concept").splitlines()[0].split("\t")[2:] == ["?", "?", "Art Nouveau poster illustration"]
