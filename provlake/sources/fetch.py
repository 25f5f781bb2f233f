"""Fetching candidates' bytes inside tasks, and landing what the ingest accepted in the pool."""

from __future__ import annotations

import hashlib
import os
import time
import uuid
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pictures import NoPicture, capped, examined, phash
from ..functions.text import cache_key
from .archive import Bucket, fetched

_CHUNK = 1 << 16


class TooLarge(Exception):
    pass


def download(url: str, part: str, max_bytes: int = 0, timeout: float = 60.0) -> None:
    """Bring `part` up to the whole content of `url`: what it holds is kept if the server takes ranges.

    `max_bytes` 0 is no limit; beyond it TooLarge is raised and nothing stays.
    """
    held = os.path.getsize(part) if os.path.exists(part) else 0
    request = Request(url, headers={"User-Agent": "provlake"} | ({"Range": f"bytes={held}-"} if held else {}))
    try:
        reply = urlopen(request, timeout=timeout)
    except HTTPError as e:
        if e.code == 416 and held:  # nothing is missing
            return
        raise
    with reply, open(part, "ab" if held and reply.status == 206 else "wb") as out:
        size = out.tell()
        while chunk := reply.read(_CHUNK):
            size += len(chunk)
            if 0 < max_bytes < size:
                break
            out.write(chunk)
    if 0 < max_bytes < size:
        os.remove(part)
        raise TooLarge


class Lane:
    """The rate of a source over the tasks that fetch from it: each has its share, and those that are done leave theirs to the others.

    A lane that is done leaves a mark in `place`, a folder that all tasks see; the others look for marks
    once every `every` seconds. The shares never add up to more than the rate; a lane that has no
    candidates at all keeps its own.
    """

    def __init__(self, place: str, lane: int, lanes: int, rate: float, burst: int = 4, every: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.place, self.lane, self.lanes, self.rate, self.every, self.clock = place, lane, lanes, rate, every, clock
        self.bucket = Bucket(rate / lanes, max(1, burst // lanes), clock, sleep)
        self.seen = clock()
        if os.path.exists(self._mark(lane)):  # of a task that runs again
            os.remove(self._mark(lane))

    def take(self) -> None:
        if self.clock() - self.seen >= self.every:
            self.seen = self.clock()
            done = sum(os.path.exists(self._mark(i)) for i in range(self.lanes) if i != self.lane)
            self.bucket.rate = max(self.rate / (self.lanes - done), 0.01)
        self.bucket.take()

    def _mark(self, lane: int) -> str:
        return os.path.join(self.place, f"lane-{lane}")

    def end(self) -> None:
        os.makedirs(self.place, exist_ok=True)
        open(self._mark(self.lane), "w").close()


def lanes_of(cache: str) -> str:
    """Where the marks of the lanes are; they are of no use once a fetch is done."""
    return cache.rstrip("/") + ".lanes"


def fetch(candidates: DataFrame, cache: str, max_bytes: int = 0, rate: float = 2.0, burst: int = 4, retries: int = 4, base: float = 0.5, pictures: bool = False, lanes: int = 4, max_megapixels: float = 0) -> DataFrame:
    """`candidates` with sha256, size, failure and the file below `cache` that has the bytes.

    A source's candidates are dealt by their urls to `lanes` tasks, which share the source's `rate`; `cache`
    is a folder that all of them see. Files are named by source and url: a task that runs again
    goes on where the first one stopped. With `pictures` bytes that are no whole picture are the failure
    `decode:...`, width and height are the files', and PNG files have their phash. Of those with more than
    `max_megapixels` (0: no limit) a PNG is scaled down to that, and what is told is the new file's,
    but for the phash; other formats, for which there is no codec, are the failure `megapixel_cap`.
    """
    url = F.col("remote_url")
    rows = candidates.withColumn("cached", F.concat(F.lit(cache.rstrip("/") + "/"), cache_key(F.col("source"), url))).withColumn("_lane", F.pmod(F.hash(url), F.lit(lanes)))
    run_id = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(cache, exist_ok=True)
        mine: dict[tuple[str, int], Lane] = {}
        for frame in frames:
            found = []
            for source, url, path, lane in zip(frame["source"], frame["remote_url"], frame["cached"], frame["_lane"]):
                try:
                    if not os.path.exists(path):
                        key = source, int(lane)
                        if key not in mine:
                            mine[key] = Lane(os.path.join(lanes_of(cache), run_id, hashlib.sha1(str(source).encode()).hexdigest()), key[1], lanes, rate, burst)
                        mine[key].take()
                        fetched(lambda: download(url, path + ".part", max_bytes) or b"", retries, base)  # noqa: B023
                        os.replace(path + ".part", path)
                    told = (None, None, None)
                    if pictures:
                        with open(path, "rb") as f:
                            data = f.read()
                        told = (*examined(data), phash(data))
                        if max_megapixels > 0 and (told[0] or 0) * (told[1] or 0) > max_megapixels * 1e6:
                            small = capped(data, max_megapixels)
                            if small is None:
                                found.append((None, None, "megapixel_cap", None, None, None))
                                continue
                            with open(path + ".capped", "wb") as f:
                                f.write(small[0])
                            os.replace(path + ".capped", path)
                            told = (*small[1:], told[2])
                    with open(path, "rb") as f:
                        digest = hashlib.file_digest(f, "sha256").hexdigest()
                    found.append((digest, os.path.getsize(path), None, *told))
                except NoPicture as e:
                    os.remove(path)
                    found.append((None, None, f"decode:{e}", None, None, None))
                except TooLarge:
                    found.append((None, None, "size_cap", None, None, None))
                except Exception as e:  # noqa: BLE001 - any fault of one url is that candidate's outcome
                    found.append((None, None, str(e), None, None, None))
            done = pd.DataFrame(found, columns=["sha256", "size", "failure", "width", "height", "phash"], index=frame.index)
            sizes = {c: done[c].astype("Int64").fillna(frame[c].astype("Int64")) if c in frame else done[c].astype("Int64") for c in made if c in ("width", "height")}
            more = {"phash": done["phash"].astype(object).where(done["phash"].notna(), None)} if pictures else {}
            yield frame.drop(columns="_lane").assign(sha256=done["sha256"], size=done["size"].astype("Int64"), failure=done["failure"], **sizes, **more)
        for lane in mine.values():
            lane.end()

    made = {"sha256": "string", "size": "long", "failure": "string"} | ({"width": "int", "height": "int", "phash": "string"} if pictures else {})
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields} | made
    given = [c for c in rows.columns if c not in made or c in ("width", "height")]
    order = [*(c for c in given if c != "_lane"), *(c for c in made if c not in given)]
    schema = ", ".join(f"`{c}` {types[c]}" for c in order)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, or small candidates are put together in one task
    return rows.select(*given).repartition(tasks, "source", "_lane").mapInPandas(lambda frames: (f[order] for f in run(frames)), schema)


def land(landed: DataFrame, images: str) -> DataFrame:
    """Move the files of `landed` (id, cached, category, subject, filename) into the pool; (id, path) of each.

    A rename within one file system, so a reader sees a whole file or none, and a repeated move finds its work done.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            paths = ["/".join(x) for x in zip(frame["category"], frame["subject"], frame["filename"])]
            for cached, path in zip(frame["cached"], paths):
                dest = os.path.join(images, path)
                os.makedirs(os.path.dirname(dest), exist_ok=True)
                if os.path.exists(cached):
                    os.replace(cached, dest)
                elif not os.path.exists(dest):
                    raise FileNotFoundError(cached)
            yield pd.DataFrame({"id": frame["id"], "path": paths})

    return landed.select("id", "cached", "category", "subject", "filename").mapInPandas(run, "id long, path string")
